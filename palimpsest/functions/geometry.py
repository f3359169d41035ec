"""Page geometry as column expressions: points are array<struct<x:int,y:int>>, boxes have corners x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:int,y:int>>"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def _whole(number: Column) -> Column:
    """A number in text, cut towards zero; null if it is none."""
    return number.try_cast("double").cast("int")


def parse_points(text: Column) -> Column:
    """'x,y x,y' of whole numbers; null as a whole if a point is malformed."""
    points = F.transform(_tokens(text), lambda t: F.struct(F.get(F.split(t, ","), 0).try_cast("int").alias("x"), F.get(F.split(t, ","), 1).try_cast("int").alias("y")))
    good = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(good, points).cast(POINTS)


def parse_points_tolerant(text: Column) -> Column:
    """'x,y x,y' with fractions cut off; malformed points are skipped."""
    points = F.transform(_tokens(text), lambda t: F.struct(_whole(F.get(F.split(t, ","), 0)).alias("x"), _whole(F.get(F.split(t, ","), 1)).alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).cast(POINTS)


def parse_points_flat(text: Column) -> Column:
    """'x,y x,y' or 'x y x y'; an odd number of flat values is null."""
    t = _tokens(text)
    flat = F.transform(F.sequence(F.lit(0), F.size(t) - 2, F.lit(2)), lambda i: F.struct(_whole(F.get(t, i)).alias("x"), _whole(F.get(t, i + 1)).alias("y")))
    none = F.array().cast(POINTS)
    return F.when(F.size(t) == 0, none).when(F.contains(F.get(t, 0), F.lit(",")), parse_points_tolerant(text)).when(F.size(t) % 2 == 0, flat.cast(POINTS))


def points_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(p["x"], F.lit(","), p["y"])), " ")


def points_box(points: Column) -> Column:
    """The bounding box; zeros for no points."""
    side = lambda f, k: F.coalesce(f(F.transform(points, lambda p: p[k])), F.lit(0))
    return F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))


def box_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box's corners, clockwise from the top left."""
    return F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def center_x(x1: Column, x2: Column) -> Column:
    return F.floor((x1 + x2) / 2)


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 5) -> Column:
    """Grown by pad on each side, within the page."""
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x1 - pad).alias("x1"), F.greatest(zero, y1 - pad).alias("y1"), F.least(width, x2 + pad).alias("x2"), F.least(height, y2 + pad).alias("y2"))


def resized_width(width: Column, height: Column, target: Column, multiply_first: bool = False, most: int = 10_000) -> Column:
    """Width at the target height, cut to a whole number, from 1 to most. The two orders of the multiplication can
    differ by a pixel: target * (width / height), or width * target / height."""
    exact = width * target / height if multiply_first else target * (width / height)
    return F.least(F.lit(most), F.greatest(F.lit(1), exact.cast("int")))


def limited_size(width: Column, height: Column, most: int) -> Column:
    """Both sides scaled down so that neither is above most."""
    long = F.greatest(width, height)
    scale = lambda side: F.when(long > most, F.greatest(F.lit(1), (side * (F.lit(most) / long)).cast("int"))).otherwise(side)
    return F.struct(scale(width).alias("width"), scale(height).alias("height"))


def reading_order_index(custom: Column) -> Column:
    """N of 'readingOrder {index:N;}'; null without one."""
    return F.when(F.contains(custom, F.lit("readingOrder")), F.regexp_extract(custom, r"index:([^;]*);", 1).try_cast("int"))


def rotated_points(points: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """Turned around a centre, fractions cut off."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(points, lambda p: F.struct((c * (p["x"] - cx) - s * (p["y"] - cy) + cx).cast("int").alias("x"), (s * (p["x"] - cx) + c * (p["y"] - cy) + cy).cast("int").alias("y")))


def tightened_points(points: Column, top: Column, bottom: Column, pad: int = 10) -> Column:
    """Points above the polygon's middle go to the ink's top less pad (0 at least), the others to its bottom plus pad,
    unless that saves no more than 5 pixels of height."""
    box = points_box(points)
    middle, old = (box["y1"] + box["y2"]) / 2, box["y2"] - box["y1"]
    up, down = F.greatest(F.lit(0), top - pad), bottom + pad
    moved = F.transform(points, lambda p: F.struct(p["x"].alias("x"), F.when(p["y"] < middle, up).otherwise(down).cast("int").alias("y")))
    return F.when(old <= (down - up) + 5, points).otherwise(moved)


def is_worth_writing(old_height: Column, new_height: Column) -> Column:
    return new_height < 0.9 * old_height


def polyline_length(points: Column) -> Column:
    """Length along the points; 0 for fewer than two."""
    pairs = F.when(F.size(points) > 1, F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.sqrt((b["x"] - a["x"]).cast("double") ** 2 + (b["y"] - a["y"]).cast("double") ** 2)))
    return F.coalesce(F.aggregate(pairs, F.lit(0.0), lambda total, d: total + d), F.lit(0.0))


def baseline_angle(points: Column) -> Column:
    """Degrees of the least-squares line's slope; 0 for fewer than two points and for vertical lines."""
    n = F.size(points).cast("double")
    total = lambda f: F.aggregate(F.transform(points, lambda p: f(p["x"].cast("double"), p["y"].cast("double"))), F.lit(0.0), lambda a, b: a + b)
    sx, sy, sxy, sxx = total(lambda x, y: x), total(lambda x, y: y), total(lambda x, y: x * y), total(lambda x, y: x * x)
    spread = n * sxx - sx * sx
    return F.when((n >= 2) & (spread != 0), F.degrees(F.atan((n * sxy - sx * sy) / spread))).otherwise(F.lit(0.0))
