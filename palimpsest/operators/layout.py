"""Page layout: region boxes and hulls, reading order, column clustering, point-in-box and nearest joins, quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.geometry import center_x, points_box, polyline_length

BINS = 40
#: Widths of the cells that boxes are cut into: 1, 4 ... 4096 pixels; wider boxes take more of the widest.
LEVELS = 7


def region_boxes(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., x1, y1, x2, y2, lines): the union of the lines' boxes."""
    return lines.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("lines"))


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the hull, counter-clockwise by mathematical axes from the smallest point, none on an edge."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(some: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _half_hull(points: Column) -> Column:
    """Monotone chain over points struct<x,y>, each x once, in the order in which they come: what a point's line of sight
    passes goes, which is all behind the last corner that turns left towards it."""
    part = lambda p, k: p[k].cast("bigint")

    def turns_left(a: Column, b: Column, p: Column) -> Column:
        return (part(b, "x") - part(a, "x")) * (part(p, "y") - part(a, "y")) > (part(b, "y") - part(a, "y")) * (part(p, "x") - part(a, "x"))

    def added(chain: Column, p: Column) -> Column:
        good = F.filter(F.sequence(F.lit(1), F.size(chain)), lambda i: (i == 1) | turns_left(F.get(chain, i - 2), F.get(chain, i - 1), p))
        return F.concat(F.slice(chain, 1, F.array_max(good)), F.array(p))

    start = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.size(points)), start, added)


def region_hulls(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., hull): convex hull of the lines' boxes, as convex_hull gives it. For each x only the lowest and highest corner
    can be on the hull, so those are what the regions' groups hold; the chains along both are SQL functions."""
    sides = lines.select(*by, F.explode(F.array(F.struct(F.col("x1").alias("x"), "y1", "y2"), F.struct(F.col("x2").alias("x"), "y1", "y2"))).alias("s")).select(*by, "s.*")
    reduced = sides.groupBy(*by, "x").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    held = reduced.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y1").cast("int").alias("y1"), F.col("y2").cast("int").alias("y2")))).alias("_s"))
    at = lambda side: F.transform("_s", lambda s: F.struct(s["x"].alias("x"), s[side].alias("y")))
    hull = F.array_distinct(F.concat(_half_hull(at("y1")), _half_hull(F.reverse(at("y2")))))
    return held.select(*by, hull.alias("hull"))


def column_histogram(lines: DataFrame, page: str, page_width: Column, bins: int = BINS) -> DataFrame:
    """(page, bin, n): line centres by equal bins over the page's width, clamped to the outer bins."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(center_x(F.col("x1"), F.col("x2")) / (page_width / bins)))).cast("int")
    return lines.groupBy(page, at.alias("bin")).agg(F.count("*").alias("n"))


def nearest_index(value: Column, centers: Column) -> Column:
    """Index of the nearest of an array of centres, ties to the smaller index; null for none."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(value - c).alias("d"), i.alias("i"))))["i"]


def columns_of_lines(lines: DataFrame, page: str, page_width: Column, most: int = 4) -> DataFrame:
    """Adds column: the nearest column centre (middle of a peak of the histogram) to the line's centre."""
    from palimpsest.operators.sequences import peaks

    most = min(8, max(1, most))
    widths = lines.groupBy(page).agg(F.max(page_width).alias("_w"))
    found = peaks(column_histogram(lines, page, page_width), page, most=most).join(widths, page)
    centers = found.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", ((F.col("bin") + 0.5) * F.col("_w") / BINS).cast("int").alias("c")))), lambda x: x["c"]).alias("_centers"))
    return lines.join(centers, page, "left").withColumn("column", nearest_index(center_x(F.col("x1"), F.col("x2")), F.col("_centers"))).drop("_centers")


def order_columns(lines: DataFrame, page: str) -> DataFrame:
    """Adds region (col_N, columns left to right by mean centre) and line_number within it, top to bottom."""
    mean = lines.groupBy(page, "column").agg(F.avg(center_x(F.col("x1"), F.col("x2"))).alias("_cx"))
    ranked = mean.withColumn("_rank", F.row_number().over(Window.partitionBy(page).orderBy("_cx", "column"))).drop("_cx")
    number = F.row_number().over(Window.partitionBy(page, "column").orderBy("y1", "x1", "line_id"))
    return lines.join(ranked, [page, "column"]).withColumn("region", F.concat(F.lit("col_"), F.col("_rank").cast("string"))).withColumn("line_number", number).drop("_rank")


def _pieces(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """array<struct<level,cell>>: the whole numbers low to high as few cells of widths 1, 4, 16 ...: of each width those that
    no wider cell holds."""
    first = [F.ceil(low / 4**k) for k in range(levels)]
    end = [F.floor((high + 1) / 4**k) for k in range(levels)]

    def level(k: int) -> Column:
        cells = F.when(first[k] < end[k], F.sequence(first[k], end[k] - 1)).otherwise(F.array().cast("array<bigint>"))
        if k + 1 < levels:
            wider = first[k + 1] < end[k + 1]
            cells = F.filter(cells, lambda c: ~(wider & (c >= first[k + 1] * 4) & (c < end[k + 1] * 4)))
        return F.transform(cells, lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell")))

    return F.flatten(F.array(*map(level, range(levels))))


def region_of_lines(lines: DataFrame, regions: DataFrame, page: str, default: str = "r_1") -> DataFrame:
    """Adds region_id: the first region (by region_idx, then region_id) whose box holds the line's centre, or the default.

    No line meets all regions of its page: a box is cut by both axes into cells of widths 1, 4, 16 ..., some hundred at most for
    a box of a page, and of each cell only the first region stays. A centre lies in one cell of each pair of widths, so it
    asks for LEVELS squared cells by an equi-join. Equal boxes are cut once, equal centres ask once."""
    at = lines.withColumn("_cx", center_x(F.col("x1"), F.col("x2"))).withColumn("_cy", center_x(F.col("y1"), F.col("y2")))
    boxes = regions.where("region_idx is not null").select(page, "region_idx", "region_id", *[f(c).cast("bigint").alias(f"_{c}") for f, c in ((F.ceil, "x1"), (F.ceil, "y1"), (F.floor, "x2"), (F.floor, "y2"))])
    boxes = boxes.groupBy(page, "_x1", "_y1", "_x2", "_y2").agg(F.min(F.struct("region_idx", "region_id")).alias("_r"))
    cut = boxes.select(page, "_r", F.explode(_pieces(F.col("_x1"), F.col("_x2"))).alias("_x"), "_y1", "_y2").select(page, "_r", "_x", F.explode(_pieces(F.col("_y1"), F.col("_y2"))).alias("_y"))
    cells = cut.groupBy(page, "_x", "_y").agg(F.min("_r").alias("_r"))
    asked = lambda c: F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(c) / 4**k).alias("cell")) for k in range(LEVELS)]))
    centers = at.select(page, "_cx", "_cy").distinct()
    asks = centers.withColumn("_x", asked("_cx")).withColumn("_y", asked("_cy"))
    hits = asks.join(cells, [page, "_x", "_y"]).groupBy(page, "_cx", "_cy").agg(F.min("_r")["region_id"].alias("_region"))
    rest = [c for c in lines.columns if c not in (page, "line_id")]
    return at.join(hits, [page, "_cx", "_cy"], "left").select(page, "line_id", *rest, F.coalesce("_region", F.lit(default)).alias("region_id"))


def order_regions(regions: DataFrame, order: DataFrame, page: str = "page") -> DataFrame:
    """(page, region_id, position from 0): regions in the order of their references (page, region_id, order_idx), then
    those without any in document order (region_idx). References to no region are dropped, repeated ones repeat."""
    referred = order.join(regions, [page, "region_id"]).select(page, "region_id", F.lit(0).alias("late"), F.col("order_idx").alias("at"), F.col("ref_idx").alias("then"))
    rest = regions.join(order.select(page, "region_id").distinct(), [page, "region_id"], "left_anti").select(page, "region_id", F.lit(1).alias("late"), F.col("region_idx").alias("at"), F.lit(0).alias("then"))
    position = F.row_number().over(Window.partitionBy(page).orderBy("late", "at", "then")) - 1
    return referred.unionByName(rest).select(page, "region_id", position.alias("position"))


def spatial_order(regions: DataFrame, page: str = "page") -> DataFrame:
    """(page, region_id, position): by the first point's y, regions without points last, then in document order."""
    position = F.row_number().over(Window.partitionBy(page).orderBy(F.coalesce(F.get("coords", 0)["y"].cast("double"), F.lit(float("inf"))), "region_idx")) - 1
    return regions.select(page, "region_id", position.alias("position"))


def order_lines(lines: DataFrame, page: str = "page") -> DataFrame:
    """Adds position: by the regions' reading order index or else top, then the lines' index or else top."""
    keys = [F.coalesce("region_order", "region_y"), F.col("region_idx"), F.coalesce("line_order", "y1"), F.col("line_idx")]
    return lines.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy(*keys)) - 1)


def segmentation_quality(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., regions, lines, mean_line_height, height_variance, baseline_ratio): population variance; the ratio is the
    mean of baseline length over box width where there are two points and a width. Zeros where nothing counts."""
    height = (F.col("y2") - F.col("y1")).cast("double")
    ratio = F.when((F.size("baseline") >= 2) & (F.col("x2") > F.col("x1")), polyline_length(F.col("baseline")) / (F.col("x2") - F.col("x1")))
    return lines.groupBy(*by).agg(F.count_distinct("region_id").alias("regions"), F.count("*").alias("lines"), F.coalesce(F.avg(height), F.lit(0.0)).alias("mean_line_height"), F.coalesce(F.var_pop(height), F.lit(0.0)).alias("height_variance"), F.coalesce(F.avg(ratio), F.lit(0.0)).alias("baseline_ratio"))


def tall_enough(lines: DataFrame, least: int) -> DataFrame:
    return lines.where(F.col("y2") - F.col("y1") >= least)


def segmented_pages(lines: DataFrame, page: str, page_width: Column, most_columns: int = 4, least_height: int = 10) -> DataFrame:
    """Lines of classical segmentation with their columns as regions, in reading order; small lines are dropped."""
    return order_columns(columns_of_lines(tall_enough(lines, least_height), page, page_width, most_columns), page)


def segmented_regions(lines: DataFrame, page: str, page_width: Column, most_columns: int = 4, least_height: int = 10) -> DataFrame:
    """(page, region, x1, y1, x2, y2, lines, hull): the columns of segmented_pages as regions with box and convex hull."""
    found = segmented_pages(lines, page, page_width, most_columns, least_height)
    return region_boxes(found, page, "region").join(region_hulls(found, page, "region"), [page, "region"])


def choose_mode(neural: DataFrame, classical: DataFrame, page: str, least_lines: int = 3) -> DataFrame:
    """Neural lines of the pages where there are at least least_lines of them, classical ones of the others; adds mode."""
    enough = neural.groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_lines).select(page)
    good = neural.join(enough, page, "left_semi").withColumn("mode", F.lit("neural"))
    return good.unionByName(classical.join(enough, page, "left_anti").withColumn("mode", F.lit("classical")), allowMissingColumns=True)


def boxes_of_points(lines: DataFrame, points_col: str = "coords") -> DataFrame:
    return lines.withColumn("_b", points_box(F.col(points_col))).select("*", "_b.*").drop("_b")


def regions_by_id(lines: DataFrame, page: str = "page") -> DataFrame:
    """Adds region (r_1, r_2 ... in the order of the region ids as texts) and line_number within it, top to bottom."""
    ids = lines.select(page, "region_id").distinct()
    ranked = ids.withColumn("region", F.concat(F.lit("r_"), F.row_number().over(Window.partitionBy(page).orderBy("region_id")).cast("string")))
    number = F.row_number().over(Window.partitionBy(page, "region_id").orderBy("y1", "x1", "line_id"))
    return lines.join(ranked, [page, "region_id"]).withColumn("line_number", number)


def grouped_regions(lines: DataFrame, page: str, page_width: Column, most_columns: int = 4, least_height: int = 8, crowded: int = 30) -> DataFrame:
    """Lines that a model found (region_id as region_of_lines or region_key give it; null: one region) as regions in order: adds
    region (r_1, r_2 ... by the region ids as texts) and line_number, top to bottom. Where all lines of a page are in one
    region and there are `crowded` or more, as when two pages were taken for one, its columns are the regions. Small
    lines are dropped."""
    kept = tall_enough(lines, least_height).withColumn("region_id", F.coalesce(F.col("region_id").cast("string"), F.lit("r_1")))
    single = kept.groupBy(page).agg(F.count("*").alias("_n"), F.min("region_id").alias("_first"), F.max("region_id").alias("_last"))
    single = single.where((F.col("_n") >= crowded) & (F.col("_first") == F.col("_last"))).select(page)
    columns = columns_of_lines(kept.join(single, page, "left_semi"), page, page_width, most_columns)
    columns = columns.withColumn("region_id", F.concat(F.lit("col_"), F.col("column").cast("string"))).drop("column")
    return regions_by_id(columns.unionByName(kept.join(single, page, "left_anti")), page)


def region_key(kind: Column, number: Column) -> Column:
    """type_number of a region that a model found, col_number where it has no type."""
    return F.concat(F.coalesce(kind, F.lit("col")), F.lit("_"), number.cast("string"))


def segmentation_summary(quality: DataFrame) -> DataFrame:
    """One row of segmented pages (lines, seconds, fallback): pages, mean seconds and lines, and how many fell back."""
    return quality.agg(F.count("*").alias("pages"), F.avg("seconds").alias("avg_seconds"), F.avg("lines").alias("avg_lines"), F.count_if("fallback").alias("fallbacks"))


def height_ranges(images: DataFrame, before: str = "height_before", after: str = "height_after") -> DataFrame:
    """One row: images, and the least and largest height before and after a change."""
    return images.agg(F.count("*").alias("images"), *[f(c).alias(f"{n}_{c}") for c in (before, after) for n, f in (("min", F.min), ("max", F.max))])
