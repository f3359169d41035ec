"""Watched folders and run logs as streams: the file source's checkpoint replaces looking for finished outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.transcribe import Transcriber, transcribe

LOG = "ts timestamp, model string, mode string, event string, prompt_tok int, cand_tok int, total_tok int, chars int"


def watched_files(spark: SparkSession, path: str, glob: str = "*", per_batch: int = 100) -> DataFrame:
    """(path, modificationTime, length, content) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(path)


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed layout pages of XML files as they arrive."""
    from palimpsest.sources.layout_xml import parse_pages

    return parse_pages(watched_files(spark, path, "*.xml"), "auto")


def transcribe_stream(lines: DataFrame, transcriber: Transcriber, out: str, checkpoint: str) -> StreamingQuery:
    """Transcribes what is there and has not been yet, then stops: results and errors are appended to two tables. A
    batch that is run again after a failure replaces its own folder, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        done = transcribe(batch, transcriber).persist()
        done.where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        done.where("error is not null").write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        done.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG).csv(path)


def usage_by_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """An extension: tokens by hour and model with a watermark; batch or stream."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "model").agg(F.count("*").alias("calls"), F.sum("total_tok").alias("total_tok"), F.sum(F.greatest(F.lit(0), F.col("total_tok") - F.col("prompt_tok") - F.col("cand_tok"))).alias("internal_tok"))


def run_until(query: StreamingQuery, stop: Callable[[], bool], every: float = 0.5) -> None:
    """Waits for a query, and stops it between batches once stop() is true."""
    while query.isActive:
        if query.awaitTermination(every):
            return
        if stop():
            query.stop()


def run_until_idle(query: StreamingQuery, every: float = 0.2) -> None:
    """Waits for a query until two batches have found nothing new, of which the first may be one that a restart repeats, and
    stops it; for queries with timers, which never run out of batches. An error of the query is raised."""

    def idle() -> bool:
        last = query.recentProgress[-2:]
        return len(last) == 2 and not any(p["numInputRows"] for p in last)

    run_until(query, idle, every)
    if query.exception():
        raise query.exception()
