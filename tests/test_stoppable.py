"""Batches that are stopped in the middle of a job."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.plans.stoppable import STOPPED, run_batch_until, run_tagged


def slow(seconds):
    class Slow:
        name, by_page = "slow", False

        def load(self):
            pass

        def predict(self, lines):
            time.sleep(seconds)
            return pd.DataFrame({"text": [c.decode() for c in lines["content"]], "confidence": [1.0] * len(lines)})

    return Slow()


@pytest.fixture
def work(spark):
    rows = [(f"p{k}", f"l{i}", i, f"text {k} {i}".encode()) for k in range(40) for i in range(3)]
    return spark.createDataFrame(rows, "page string, line_id string, line_idx int, content binary").repartition(4)


def failures(spark, out):
    return {r.page: r.error for r in spark.read.option("header", "true").csv(f"{out}/failures.csv").collect()}


def test_a_stopped_batch_ends_soon_and_keeps_its_pages(spark, work, tmp_path):
    out, seen, since = str(tmp_path / "out"), [], []

    def stop():
        if seen and seen[-1].waves_done >= 2 and not since:
            since.append(time.time())
        return bool(since) and time.time() - since[0] > 1  # in the middle of a wave that takes long

    class Turning:
        """The first waves take no time, later ones a minute."""

        name, by_page = "turning", False

        def load(self):
            pass

        def predict(self, lines):
            if not set(lines["page"]) <= quick:
                time.sleep(60)
            return pd.DataFrame({"text": [c.decode() for c in lines["content"]], "confidence": [1.0] * len(lines)})

    waves = {r.page: r.w for r in work.select("page", F.pmod(F.xxhash64("page"), F.lit(4)).cast("int").alias("w")).distinct().collect()}
    quick = {p for p, w in waves.items() if w < 2}
    counts = run_batch_until(work, Turning(), out, stop, waves=4, on_progress=seen.append).first()
    assert since and time.time() - since[0] < 20
    left = {p for p, w in waves.items() if w >= 2}
    assert failures(spark, out) == dict.fromkeys(left, STOPPED) and 0 < len(left) < 40
    texts = {r.page: r.value for r in spark.read.text(f"{out}/transcriptions", wholetext=True).collect()}
    assert set(texts) == quick and all(texts[p].strip() == "\n".join(f"text {p[1:]} {i}" for i in range(3)) for p in quick)
    assert (counts.succeeded, counts.failed) == (3 * len(quick), len(left))
    assert any(p.tasks > 0 for p in seen) and seen[-1].waves == 4

    done = spark.createDataFrame([(p,) for p in quick], "page string")
    again = run_batch_until(work, slow(0), str(tmp_path / "rest"), lambda: False, done=done, waves=3).first()
    assert (again.succeeded, again.failed) == (3 * len(left), 0)


def test_a_batch_that_nobody_stops(spark, work, tmp_path):
    counts = run_batch_until(work, slow(0), str(tmp_path / "out"), lambda: False, waves=2).first()
    assert (counts.succeeded, counts.failed) == (120, 0) and failures(spark, str(tmp_path / "out")) == {}
    none = run_batch_until(work.limit(0), slow(0), str(tmp_path / "none"), lambda: False, waves=2).first()
    assert (none.succeeded, none.failed) == (0, 0)
    at_once = run_batch_until(work, slow(60), str(tmp_path / "once"), lambda: True, waves=2).first()
    assert (at_once.succeeded, at_once.failed) == (0, 40)


def test_errors_of_the_work_are_raised(spark):
    def fails():
        raise ValueError("own error")

    with pytest.raises(ValueError, match="own error"):
        run_tagged(spark, fails, lambda: False)
    assert run_tagged(spark, lambda: spark.range(10).count(), lambda: False)
    began = time.time()
    assert not run_tagged(spark, lambda: spark.range(1 << 40).select(F.sum(F.sqrt(F.sqrt("id")))).collect(), lambda: time.time() - began > 2)
    assert time.time() - began < 20
