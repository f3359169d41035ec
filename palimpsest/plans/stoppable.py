"""Batch transcription that can be stopped while it runs, and says how far it is.

Pages are dealt to waves by a hash; each wave is a Spark write of its own, so a finished wave's lines stay whatever happens
next. Jobs carry a tag. Once stop() is true the tag's jobs are interrupted, in the middle of a wave: its tasks end within
seconds, Python workers too, and what has no lines then is listed as stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import pairing, quality
from palimpsest.operators.transcribe import Transcriber, transcribe
from palimpsest.plans.jobs import page_text_of
from palimpsest.sources import sinks

#: What the failure list says of pages that were not done; fixed value.
STOPPED = "stopped"


@dataclass(frozen=True)
class Progress:
    """Waves that are written, all waves, and the finished and all tasks of the stages that run now."""

    waves_done: int
    waves: int
    tasks_done: int
    tasks: int


def _tasks(spark, group: str) -> tuple[int, int]:
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info and info.status == "RUNNING" else ():
            if found := tracker.getStageInfo(stage):
                done, total = done + found.numCompletedTasks, total + found.numTasks
    return done, total


def run_tagged(spark, work: Callable[[], None], stop: Callable[[], bool], watch: Callable[[str], None] | None = None, every: float = 0.2) -> bool:
    """Runs work() in a thread whose jobs carry a tag and a group of their own, and interrupts them once stop() is true; an
    error of the work is raised, unless it was stopped. watch gets the group now and then. Whether it ran to its end."""
    tag, errors, stopped = f"palimpsest-{uuid.uuid4().hex}", [], False

    def run() -> None:
        spark.sparkContext.setJobGroup(tag, "stoppable batch", interruptOnCancel=True)
        spark.sparkContext.addJobTag(tag)
        try:
            work()
        except Exception as e:  # noqa: BLE001  raised below
            errors.append(e)
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    while thread.is_alive():
        thread.join(every)
        if watch:
            watch(tag)
        if thread.is_alive() and (stopped or stop()):
            stopped = True
            spark.sparkContext.cancelJobsWithTag(tag)
    if errors and not stopped:
        raise errors[0]
    return not (stopped and errors)


def run_batch_until(work: DataFrame, transcriber: Transcriber, out: str, stop: Callable[[], bool], done: DataFrame | None = None, waves: int = 16, on_progress: Callable[[Progress], None] | None = None, every: float = 0.2, **about: object) -> DataFrame:
    """run_batch that ends early once stop() is true. Lines (page, line_id, line_idx, content) of pages that are not done are
    transcribed in waves; texts, page summaries and failures of all finished waves are written, pages of others are failures
    with the error `stopped`. on_progress gets a Progress every few tenths of a second. Returns one row with both counts; a
    page that was stopped counts as failed once, a failed line each."""
    spark = work.sparkSession
    todo = pairing.pending(work, done, "page") if done is not None else work
    dealt = todo.withColumn("_wave", F.pmod(F.xxhash64("page"), F.lit(waves)).cast("int"))
    schema = transcribe(todo, transcriber).schema
    written, halt = [0], threading.Event()

    def run() -> None:
        for wave in range(waves):
            if halt.is_set():
                raise InterruptedError
            sinks.write_lines_parquet(transcribe(dealt.where(F.col("_wave") == wave).drop("_wave"), transcriber), f"{out}/lines/wave={wave}")
            written[0] += 1

    def stops() -> bool:
        if stop():
            halt.set()
        return halt.is_set()

    def watch(group: str) -> None:
        if on_progress:
            on_progress(Progress(written[0], waves, *_tasks(spark, group)))

    run_tagged(spark, run, stops, watch, every)
    # Of an interrupted wave no file is committed; one that had begun leaves an empty folder at most.
    results = spark.read.schema(schema).parquet(*[f"{out}/lines/wave={k}" for k in range(written[0])]) if written[0] else spark.createDataFrame([], schema)
    left = dealt.where(F.col("_wave") >= written[0]).select("page").distinct()
    missing = left.select("page", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema[1:] if f.name != "error"], F.lit(STOPPED).alias("error"))
    every_line = results.unionByName(missing.select(*schema.names))
    good = results.where("error is null")
    sinks.write_pages(page_text_of(good), f"{out}/transcriptions", "page", "text")
    sinks.write_summary(quality.page_summary(good, "page"), every_line.where("error is not null"), out, **about)
    return quality.success_counts(every_line)
