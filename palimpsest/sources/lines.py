"""Line tables from parsed layout pages, under the rules of the different data set builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import box_points, parse_points, parse_points_flat, parse_points_tolerant, points_box, reading_order_index
from palimpsest.functions.text import strip
from palimpsest.operators.layout import order_regions, spatial_order


def exploded_lines(pages: DataFrame, nested_twice: bool = False) -> DataFrame:
    """A row per line with its page's path and size. nested_twice lists lines of nested regions under the outer region
    too, as tools that search all descendants do."""
    lines = pages.select("path", "image_name", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "regions", F.explode("lines").alias("l")).select("*", "l.*").drop("l")
    if not nested_twice:
        return lines.drop("regions")
    parent = F.get(F.filter("regions", lambda r: r["region_id"] == F.col("region_id")), 0)["parent_id"]
    outer = lines.withColumn("region_id", parent).where("region_id is not null")
    return lines.unionByName(outer).drop("regions")


def _with_box(lines: DataFrame, points: Column) -> DataFrame:
    out = lines.withColumn("coords", points).where("coords is not null and size(coords) > 0").withColumn("_b", points_box(F.col("coords"))).select("*", "_b.*").drop("_b")
    return out.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1"), "baseline": parse_points_tolerant(F.col("baseline"))})


def page_lines(pages: DataFrame, least_width: int = 20) -> DataFrame:
    """Lines of PAGE with coordinates, visible text and at least the width; text is stripped."""
    lines = exploded_lines(pages).withColumn("text", strip(F.col("text"))).where("text <> ''")
    return _with_box(lines, parse_points(F.col("points"))).where(F.col("width") >= least_width)


def page_lines_with_blank_text(pages: DataFrame) -> DataFrame:
    """Lines of PAGE with coordinates and a text element, which may be blank; no least width."""
    return _with_box(exploded_lines(pages).withColumn("text", strip(F.col("text"))).where("text is not null"), parse_points(F.col("points")))


def polygon_lines(pages: DataFrame, least_width: int = 20, least_height: int = 10) -> DataFrame:
    """Lines of PAGE with at least three valid points, a least width and height; malformed points are skipped."""
    lines = _with_box(exploded_lines(pages), parse_points_tolerant(F.col("points")))
    return lines.where((F.size("coords") >= 3) & (F.col("width") >= least_width) & (F.col("height") >= least_height))


def alto_lines(pages: DataFrame, least_width: int = 20) -> DataFrame:
    """Lines of ALTO with text and at least the width: the polygon if it has three points, else the box."""
    whole = lambda c: F.col(c).cast("int")
    box = box_points(whole("hpos"), whole("vpos"), (F.col("hpos") + F.col("w")).cast("int"), (F.col("vpos") + F.col("h")).cast("int"))
    polygon = parse_points_flat(F.col("points"))
    points = F.when(F.size(polygon) >= 3, polygon).when(F.col("hpos").isNotNull() & F.col("vpos").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull(), box)
    return _with_box(exploded_lines(pages).where("text <> ''"), points).where(F.col("width") >= least_width)


def guided_lines(pages: DataFrame, pad: int = 5) -> DataFrame:
    """Lines of PAGE with coordinates in reading order (custom indices, else positions), boxes padded within the page."""
    from palimpsest.functions.geometry import padded_box
    from palimpsest.operators.layout import order_lines

    order = F.transform("regions", lambda r: F.struct(r["region_id"].alias("id"), reading_order_index(r["custom"]).alias("o"), points_box(parse_points_tolerant(r["points"]))["y1"].alias("y")))
    regions = pages.select("path", F.explode(order).alias("r")).select("path", F.col("r.id").alias("region_id"), F.col("r.o").alias("region_order"), F.col("r.y").alias("region_y"))
    lines = _with_box(exploded_lines(pages), parse_points_tolerant(F.col("points"))).withColumn("line_order", reading_order_index(F.col("custom")))
    ordered = order_lines(lines.join(regions, ["path", "region_id"], "left"), "path")
    padded = padded_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.coalesce("page_width", "x2"), F.coalesce("page_height", "y2"), pad)
    return ordered.withColumn("padded", padded)


def region_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("path").alias("page"), F.explode("regions").alias("r")).select("page", "r.*").withColumn("coords", parse_points_tolerant(F.col("points")))


def page_texts(pages: DataFrame) -> DataFrame:
    """(path, text): the lines by region in reading order, or by position where a page has no valid order; each line
    ends with a line feed, missing text is an empty line, a page without regions an empty text."""
    order = pages.select(F.col("path").alias("page"), "region_order").where(F.size("region_order") > 0)
    bad = order.where(F.exists("region_order", lambda r: r["order_idx"].isNull())).select("page")
    good = order.join(bad, "page", "left_anti")
    regions = region_rows(pages)
    ordered = order_regions(regions.join(good.select("page"), "page", "left_semi"), good.select("page", F.explode("region_order").alias("o")).select("page", "o.*"))
    placed = ordered.unionByName(spatial_order(regions.join(good.select("page"), "page", "left_anti")))
    lines = pages.select(F.col("path").alias("page"), F.explode("lines").alias("l")).select("page", "l.region_id", "l.line_idx", strip(F.coalesce("l.text", F.lit(""))).alias("text"))
    rows = placed.join(lines, ["page", "region_id"]).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("position", "line_idx", "text"))).alias("rows"))
    text = F.concat_ws("", F.transform("rows", lambda x: F.concat(x["text"], F.lit("\n"))))
    return pages.select(F.col("path").alias("page")).join(rows, "page", "left").select(F.col("page").alias("path"), F.coalesce(text, F.lit("")).alias("text"))


def corpus_lines(pages: DataFrame) -> DataFrame:
    """(path, line_idx, text) of all lines with text, for language models; pages with errors give none."""
    lines = pages.where("error is null").select("path", F.posexplode("lines").alias("line_idx", "l"))
    return lines.select("path", "line_idx", strip(F.col("l.text")).alias("text")).where("text <> ''")
