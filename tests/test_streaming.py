"""Streams that keep a state or stop by themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import api_log, quality, splits
from palimpsest.streaming import answers, ingest, totals

EVENTS = "call string, seq bigint, text string, prompt_tok bigint, cand_tok bigint, total_tok bigint, last boolean"


def answer_rows(seed, calls=40):
    rng, rows = random.Random(seed), []
    for c in range(calls):
        n = rng.randint(1, 9)
        for k in range(n):
            text = rng.choice([None, "", " ", "\u00a0", "word ", "x"]) if rng.random() < 0.7 else None
            usage = (10, rng.choice([None, 0, 3]), rng.choice([12, 40, 90])) if rng.random() < 0.6 else (rng.choice([None, 5]), None, None)
            rows.append((f"c{c}", 10 * k + rng.randint(0, 9), text, *usage, k == n - 1))
    return rows


def outcomes(spark, folder, out, checkpoint, **how):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(folder)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    return answers.live_outcomes(stream, **how).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


@pytest.mark.parametrize("early_exit", [True, False])
def test_live_outcomes_are_those_of_the_finished_log(spark, tmp_path, early_exit):
    rows = answer_rows(5)
    log = spark.createDataFrame(rows, EVENTS)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    how = {"last": "last", "budget": 100, "early_exit": early_exit, "wait_seconds": 3600}
    for start in (0, 45):  # the second time from the checkpoint
        for at in (start, start + 20, start + 30):
            log.where((F.col("seq") >= at) & (F.col("seq") < {0: 20, 20: 30, 30: 45, 45: 65, 65: 75, 75: 1000}[at])).orderBy(F.rand(1)).coalesce(1).write.mode("append").json(folder)
            time.sleep(0.02)
        ingest.run_until_idle(outcomes(spark, folder, out, checkpoint, **how))
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()), key=str)
    want = sorted(map(tuple, api_log.stream_outcomes(log, budget=100, early_exit=early_exit).collect()), key=str)
    assert got == want and {r[1] for r in got} >= {"reasoning abort", "fallback", "early exit" if early_exit else "full"}


def test_answers_that_break_off_end_by_the_timer(spark, tmp_path):
    rows = [("a", 0, "half an ", 1, 1, 1, False), ("a", 1, "answer", None, None, None, None), ("b", 0, None, 7, 1, 8, False)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(str(tmp_path / "in"))
    query = outcomes(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), budget=100, early_exit=False, wait_seconds=1)
    end = time.time() + 60
    while time.time() < end and query.isActive:
        time.sleep(0.5)
        if list((tmp_path / "out").glob("batch=*/*.parquet")) and spark.read.parquet(str(tmp_path / "out")).count() == 2:
            break
    query.stop()
    got = sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())
    assert got == [("a", "full", "half an answer", 2), ("b", "fallback", "", 1)]


RESULTS = "page string, text string, confidence double, error string, line_source string, split string, w int, h int"


def result_rows(seed, n):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick("a", "b", "c", None), pick("text", "", None, "two\nlines"), pick(0.5, 0.25, None, 1.0), pick(None, "E: x", "E: y", "other " * 20), pick("xml_used", "auto_seg", None), pick("train", "val"), pick(1, 20, None), rng.randint(1, 9)) for _ in range(n)]


def test_totals_equal_those_of_all_rows_at_any_time(spark, tmp_path):
    kinds = [totals.page_totals(), totals.error_totals(), totals.source_totals(), totals.dataset_totals("page", F.col("w"), F.col("h"), target=64)]
    out, batches = str(tmp_path / "out"), [spark.createDataFrame(result_rows(k, 20 * k), RESULTS) for k in range(5)]

    def check(upto):
        rows = spark.createDataFrame([r for k in range(upto) for r in result_rows(k, 20 * k)], RESULTS)
        want = [quality.page_summary(rows, "page"), quality.error_breakdown(rows.where("error is not null")), quality.source_counters(rows), splits.dataset_info(rows, "page", F.col("w"), F.col("h"), target=64)]
        for kind, own in zip(kinds, want, strict=True):
            got = totals.read_total(spark, kind, out)
            shown = lambda df: sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df.select(*own.columns).collect())  # noqa: E731, B023
            assert shown(got) == shown(own), (kind.name, upto)

    assert totals.read_total(spark, kinds[0], out) is None
    for k, batch in enumerate(batches):
        totals.add_batch(batch, k, kinds, out)
        if k in (0, 2):
            totals.add_batch(batch, k, kinds, out)  # runs again
        check(k + 1)
        if k == 2:
            assert [totals.fold(spark, kind, out) for kind in kinds] == [2] * 4 and totals.fold(spark, kinds[0], out) == 0
            check(k + 1)
            totals.add_batch(batch, k, kinds, out)  # the last one, behind the fold
            check(k + 1)
    assert totals.fold(spark, kinds[0], out) == 2
    check(5)


def test_totals_of_a_stream_over_several_runs(spark, tmp_path):
    kind, (folder, out, checkpoint) = totals.page_totals(), (str(tmp_path / x) for x in ("in", "out", "cp"))
    every = []
    for k in range(3):
        rows = result_rows(10 + k, 40)
        every += rows
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").json(folder)
        totals.keep_totals(spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).json(folder), [kind], out, checkpoint).awaitTermination()
        got = {r.page: (r.line_count, r.char_count) for r in totals.read_total(spark, kind, out).collect()}
        want = {r.page: (r.line_count, r.char_count) for r in quality.page_summary(spark.createDataFrame(every, RESULTS), "page").collect()}
        assert got == want
