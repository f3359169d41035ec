"""Pairing files, lines and transcriptions: priority joins, ordinal joins, missing and finished sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "JPG", "JPEG", "PNG", "TIF")


def path_parts(path: Column) -> Column:
    """struct<dir,name,stem,ext> of a path."""
    name = F.substring_index(path, "/", -1)
    folder = F.left(path, F.greatest(F.lit(0), F.length(path) - F.length(name) - 1))
    stem = F.regexp_extract(name, r"^(.+?)(?:\.([^.]*))?$", 1)
    return F.struct(folder.alias("dir"), name.alias("name"), stem.alias("stem"), F.regexp_extract(name, r"^.+\.([^.]*)$", 1).alias("ext"))


def _whole(parts: list[Column]) -> Column:
    """Key columns as one text, null if any is null."""
    return F.when(~F.array_contains(F.array(*[c.isNull() for c in parts]), F.lit(True)), F.to_json(F.array(*[c.cast("string") for c in parts])))


def first_match(left: DataFrame, right: DataFrame, key: str, alternatives: Sequence[tuple[list[Column], list[Column]]], value: str, ties: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Adds value and priority from the first alternative that finds a row: each is a list of key columns of left and
    one of right. Among equal priorities the smallest by `ties`, then by value, wins. One equi-join over the
    alternatives, in which a row of right stands once for each way to take its keys, and a partial aggregation by left's
    key. Both joins are of shuffled rows: keys made up from a narrow table's numbers are many times what Spark takes the table
    to be, and would be sent whole to every task."""
    ways = [str(rs) for _, rs in alternatives]
    probe = [F.struct(F.lit(i).alias("priority"), F.lit(ways.index(ways[i])).alias("way"), _whole(ls).alias("on")) for i, (ls, _) in enumerate(alternatives)]
    own = [F.struct(F.lit(i).alias("way"), _whole(rs).alias("on")) for i, (_, rs) in enumerate(alternatives) if ways.index(ways[i]) == i]
    probes = left.select(F.col(key).alias("_key"), F.explode(F.array(*probe)).alias("_p")).select("_key", "_p.*").where("`on` is not null")
    found = right.select(F.explode(F.array(*own)).alias("_p"), F.col(value), *[F.col(t).alias(f"_t{t}") for t in ties]).select("_p.*", value, *[f"_t{t}" for t in ties]).where("`on` is not null")
    best = probes.join(found.hint("merge"), ["way", "on"]).groupBy("_key").agg(F.min(F.struct("priority", *[f"_t{t}" for t in ties], value)).alias("_b"))
    joined = left.join(best.hint("merge"), F.col(key) == F.col("_key"), how)
    return joined.withColumn(value, F.col(f"_b.{value}")).withColumn("priority", F.col("_b.priority")).drop("_key", "_b")


def extension_rank(ext: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """Position among the extensions, null for others."""
    at = F.array_position(F.array(*map(F.lit, extensions)), ext)
    return F.when(at > 0, at)


def xml_with_images(xml: DataFrame, images: DataFrame) -> DataFrame:
    """(xml_path, image_path, priority): for each XML file the image of its stem in its folder, or in the parent if that
    is called page; the first extension wins. XML without an image is left out."""
    x = xml.select(F.col("path").alias("xml_path"), path_parts(F.col("path")).alias("p"))
    parent = F.when(F.substring_index(F.col("p.dir"), "/", -1) == "page", F.regexp_replace(F.col("p.dir"), "/?page$", ""))
    i = images.select(F.col("path").alias("image_path"), path_parts(F.col("path")).alias("i")).withColumn("rank", extension_rank(F.col("i.ext"))).where("rank is not null")
    own = ([F.col("p.dir"), F.col("p.stem")], [F.col("i.dir"), F.col("i.stem")])
    above = ([parent, F.col("p.stem")], [F.col("i.dir"), F.col("i.stem")])
    return first_match(x, i, "xml_path", [own, above], "image_path", ["rank"], "inner").select("xml_path", "image_path", "priority")


def alto_with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(xml_path, image_path, priority) for parsed pages (path, image_name): the image named in the file in the same folder,
    else the image of the file's own stem there, else that in the parent of a page folder. Files without one are left out."""
    x = pages.select(F.col("path").alias("xml_path"), path_parts(F.col("path")).alias("p"), path_parts(F.trim("image_name"))["stem"].alias("named"))
    parent = F.when(F.substring_index(F.col("p.dir"), "/", -1) == "page", F.regexp_replace(F.col("p.dir"), "/?page$", ""))
    i = images.select(F.col("path").alias("image_path"), path_parts(F.col("path")).alias("i")).withColumn("rank", extension_rank(F.col("i.ext"))).where("rank is not null")
    at = [F.col("i.dir"), F.col("i.stem")]
    ways = [([F.col("p.dir"), F.when(F.col("named") != "", F.col("named"))], at), ([F.col("p.dir"), F.col("p.stem")], at), ([parent, F.col("p.stem")], at)]
    return first_match(x, i, "xml_path", ways, "image_path", ["rank"], "inner").select("xml_path", "image_path", "priority")


def xml_with_named_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(xml_path, image_path, error) for parsed pages (path, image_name, error): the image that the file names; the error
    says what is missing: the page, the name or the image."""
    x = pages.select(F.col("path").alias("xml_path"), "image_name", F.col("error").alias("_broken"))
    i = images.groupBy(path_parts(F.col("path"))["name"].alias("image_name")).agg(F.min("path").alias("image_path"))
    error = F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(F.coalesce("image_name", F.lit("")) == "", "no image name").when(F.col("image_path").isNull(), F.concat(F.lit("no image "), F.col("image_name")))
    return x.join(i.hint("merge"), "image_name", "left").select("xml_path", F.when(F.col("_broken").isNull(), F.col("image_path")).alias("image_path"), error.alias("error"))


def images_with_xml(images: DataFrame, xml: DataFrame, xml_folder: str | None = None, suffix: str = ".xml") -> DataFrame:
    """(image_path, xml_path or null, priority): the XML of an image's stem in a given folder, else beside it, else in
    its page folder."""
    i = images.select(F.col("path").alias("image_path"), path_parts(F.col("path")).alias("p"))
    x = xml.select(F.col("path").alias("xml_path"), path_parts(F.col("path")).alias("x"))
    name = F.concat(F.col("p.stem"), F.lit(suffix))
    places = [*([F.lit(xml_folder)] if xml_folder else []), F.col("p.dir"), F.concat(F.col("p.dir"), F.lit("/page"))]
    return first_match(i, x, "image_path", [([place, name], [F.col("x.dir"), F.col("x.name")]) for place in places], "xml_path").select("image_path", "xml_path", "priority")


def by_ordinal(left: DataFrame, right: DataFrame, page: str, idx: str, strict: bool = False) -> DataFrame:
    """Rows of both sides with equal page and index; strict: only pages whose sides have equally many rows."""
    if strict:
        n = left.groupBy(page).agg(F.count("*").alias("_n")).join(right.groupBy(page).agg(F.count("*").alias("_m")), page).where("_n = _m").select(page)
        left = left.join(n, page, "left_semi")
    return left.join(right, [page, idx])


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def finished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs with an output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_semi")


def upserted(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, by `order`, of both; for equal orders the change wins."""
    both = store.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = [c for c in store.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("_row"))
    return latest.select(key, "_row.*").select(store.columns)
