"""Running totals of streamed results: partial aggregates of each batch, merged on reading.

A total is a set of aggregates by keys that can be merged: counts and sums by addition, extremes as such, means as sums and
counts. Each batch of a stream writes its partial rows under its number, so that a batch which runs again replaces what it
wrote, and the totals hold each line once. Reading groups the partial rows again. fold() puts old batches together, so that
what is read grows with the keys and not with the age of the stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.text import char_count, error_type


@dataclass(frozen=True)
class Total:
    """partial: aggregates over a batch's rows by the keys, which are named expressions; merge: how two of them are one, the
    sum unless said otherwise; finish: from merged rows to the rows that are wanted; where: rows that count."""

    name: str
    keys: dict[str, Column]
    partial: dict[str, Column]
    merge: dict[str, Callable] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows
    where: Column | None = None

    def rows(self, batch: DataFrame) -> DataFrame:
        counted = batch if self.where is None else batch.where(self.where)
        keyed = counted.withColumns({f"_key_{k}": c for k, c in self.keys.items()})
        found = keyed.groupBy(*[f"_key_{k}" for k in self.keys]).agg(*[c.alias(name) for name, c in self.partial.items()])
        return found.withColumnsRenamed({f"_key_{k}": k for k in self.keys})

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[self.merge.get(c, F.sum)(c).alias(c) for c in self.partial])


def page_totals(page: str = "page", text: str = "text", confidence: str = "confidence") -> Total:
    """The rows of page_summary: by page, line_count, char_count, avg_confidence."""
    mean = F.when(F.col("confidences") > 0, F.col("confidence_sum") / F.col("confidences"))
    return Total(
        "pages", {page: F.col(page)},
        {"line_count": F.count(F.lit(1)), "char_count": F.sum(char_count(F.col(text))), "confidence_sum": F.coalesce(F.sum(confidence), F.lit(0.0)), "confidences": F.count(confidence)},
        finish=lambda rows: rows.select(page, "line_count", "char_count", mean.alias("avg_confidence")),
    )


def error_totals(error: str = "error") -> Total:
    """The rows of error_breakdown: error_type, n, of the rows with an error."""
    return Total("errors", {"error_type": error_type(F.col(error))}, {"n": F.count(F.lit(1))}, finish=lambda rows: rows.orderBy(F.desc("n"), "error_type"), where=F.col(error).isNotNull())


def source_totals(source: str = "line_source") -> Total:
    """The row of source_counters: xml_used, xml_failed, auto_seg."""
    names = ("xml_used", "xml_failed", "auto_seg")
    nothing = lambda rows: rows.select(*[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return Total("sources", {}, {n: F.count_if(F.col(source) == n) for n in names}, finish=nothing)


def dataset_totals(page: str, width: Column, height: Column, **settings: object) -> Total:
    """The row of dataset_info for lines with a split: what is counted by page is merged, so pages count once."""

    def info(rows: DataFrame) -> DataFrame:
        whole = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_train", "num_val", "total_lines")], *[(F.sum(f"{c}_sum") / F.sum(f"{c}s")).alias(f"avg_line_{c}") for c in ("width", "height")], F.count(F.col(page)).alias("pages_processed"))
        return whole.withColumns({name: F.lit(value) for name, value in settings.items()})

    sizes = {k: v for name, c in (("width", width), ("height", height)) for k, v in ((f"{name}_sum", F.coalesce(F.sum(c.cast("double")), F.lit(0.0))), (f"{name}s", F.count(c)))}
    counts = {"num_train": F.count_if(F.col("split") == "train"), "num_val": F.count_if(F.col("split") == "val"), "total_lines": F.count(F.lit(1))}
    return Total("dataset", {page: F.col(page)}, counts | sizes, finish=info)


def _parts(spark: SparkSession, folder: str, begin: str) -> list[int]:
    """The numbers of finished tables named begin=number in a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{begin}="))


def _tables(spark: SparkSession, folder: str) -> tuple[list[str], list[int]]:
    """What counts: the last fold and the batches behind it; and those batches' numbers."""
    folds = _parts(spark, folder, "upto")
    later = [n for n in _parts(spark, folder, "batch") if not folds or n > folds[-1]]
    return [*[f"{folder}/upto={n}" for n in folds[-1:]], *[f"{folder}/batch={n}" for n in later]], later


def add_batch(batch: DataFrame, number: int, totals: list[Total], out: str) -> None:
    """Writes a batch's partial rows of each total under out/<name>/batch=<number>, in place of what a first try wrote."""
    held = batch.persist()
    try:
        for total in totals:
            total.rows(held).write.mode("overwrite").parquet(f"{out}/{total.name}/batch={number}")
    finally:
        held.unpersist()


def keep_totals(results: DataFrame, totals: list[Total], out: str, checkpoint: str) -> StreamingQuery:
    """Adds what has come of a stream of results to the totals, then stops."""
    write = lambda batch, number: add_batch(batch, number, totals, out)
    return results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_total(spark: SparkSession, total: Total, out: str) -> DataFrame | None:
    """The total of all batches so far; None before the first."""
    paths, _ = _tables(spark, f"{out}/{total.name}")
    return total.finish(total.merged(spark.read.parquet(*paths))) if paths else None


def fold(spark: SparkSession, total: Total, out: str, keep: int = 1) -> int:
    """Puts all batches but the last `keep` into one table, and deletes them; the last may run again, so at least that one
    stays. Readers see either the batches or the new table. How many batches went."""
    folder = f"{out}/{total.name}"
    paths, later = _tables(spark, folder)
    gone = later[: len(later) - max(1, keep)]
    if not gone:
        return 0
    old = [p for p in paths if "/upto=" in p] + [f"{folder}/batch={n}" for n in gone]
    total.merged(spark.read.parquet(*old)).write.mode("overwrite").parquet(f"{folder}/upto={gone[-1]}")
    for p in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
