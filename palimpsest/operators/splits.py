"""Deterministic train and validation splits and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: Column, seed: str = "") -> Column:
    """Hash by which rows are put in a fixed, arbitrary order."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def _cut(keys: DataFrame, rank: int, enough: int = 10_000) -> tuple[str, str]:
    """The rank-th smallest (h, k) of keys, found by counting hash beginnings, three more digits a round, so that no
    sort sees all rows and what comes to the driver is bounded."""
    prefix, below = "", 0
    while True:
        at = len(prefix) + 3
        rows = keys.where(F.startswith("h", F.lit(prefix))).groupBy(F.left("h", F.lit(at)).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for p, n in rows:
            if below + n >= rank:
                if n <= enough or at >= 32:
                    own = keys.where(F.startswith("h", F.lit(p))).orderBy("h", "k").limit(rank - below).collect()
                    return own[-1][0], own[-1][1]
                prefix = p
                break
            below += n


def train_val_split(rows: DataFrame, key_col: str, train_ratio: float = 0.8, seed: str = "") -> DataFrame:
    """Adds split: the first floor(n * train_ratio) rows in hash order are 'train', the others 'val'. Rows with equal
    keys stay together on the side of the first of them. Null keys go to 'val'."""
    keyed = rows.withColumn("_k", F.col(key_col).cast("string")).withColumn("_h", order_hash(F.col(key_col), seed))
    keys = keyed.where("_k is not null").select(F.col("_h").alias("h"), F.col("_k").alias("k"))
    wanted = int(rows.count() * train_ratio)
    if not wanted:
        return rows.withColumn("split", F.lit("val"))
    h, k = _cut(keys, min(wanted, keys.count()))
    inside = F.col("_h").isNotNull() & (F.struct("_h", "_k") <= F.struct(F.lit(h), F.lit(k)))
    return keyed.withColumn("split", F.when(inside, "train").otherwise("val")).drop("_k", "_h")


def split_by_group(rows: DataFrame, group_col: str, train_ratio: float = 0.8, seed: str = "") -> DataFrame:
    """Adds split so that a group (a page, a source) is on one side: by the first 32 bits of its hash."""
    share = F.conv(F.left(order_hash(F.col(group_col), seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(share < train_ratio, "train").otherwise("val"))


def dataset_info(rows: DataFrame, page_col: str, width: Column, height: Column, **settings: object) -> DataFrame:
    """One row: num_train, num_val, total_lines, avg_line_width, avg_line_height, pages_processed and the settings."""
    info = rows.agg(
        F.count_if(F.col("split") == "train").alias("num_train"), F.count_if(F.col("split") == "val").alias("num_val"), F.count("*").alias("total_lines"),
        F.avg(width).alias("avg_line_width"), F.avg(height).alias("avg_line_height"), F.count_distinct(page_col).alias("pages_processed"),
    )
    return info.withColumns({name: F.lit(value) for name, value in settings.items()})


def random_subset(rows: DataFrame, key_col: str, most: int = 1000, part: int = 10, seed: str = "") -> DataFrame:
    """min(most, n // part) rows in hash order."""
    n = min(most, rows.count() // part)
    return rows.orderBy(order_hash(F.col(key_col), seed), key_col).limit(n)


def first_pages(files: DataFrame, most: int, path_col: str = "path") -> DataFrame:
    """The first `most` files by path, before any is read."""
    return files.orderBy(path_col).limit(most)


def padded_widths(lines: DataFrame, batch_size: int, order: str = "number", width: str = "width") -> DataFrame:
    """Adds batch (lines in order, batch_size to each), padded_width (the batch's largest) and padding. Batches are numbered
    by ranges of `order`, a dense number from 0."""
    batched = lines.withColumn("batch", F.floor(F.col(order) / batch_size))
    return batched.withColumn("padded_width", F.max(width).over(Window.partitionBy("batch"))).withColumn("padding", F.col("padded_width") - F.col(width))
