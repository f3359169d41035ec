"""Arrow files of many record batches, read by several tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.plans import jobs
from palimpsest.sources import files, sinks
from palimpsest.sources.arrow_files import ArrowReader, Blocks, _listed, read_arrow_blocks


def batches(n, rows, first=0):
    return [pa.record_batch({"i": pa.array(range(first + k * rows, first + (k + 1) * rows), pa.int64()), "t": pa.array([None if k % 7 == 3 else f"text {k}" * 3] * rows, pa.string()), "l": pa.array([[k, None], None] * (rows // 2), pa.list_(pa.int32()))}) for k in range(n)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, new, own in (("a.arrow", pa.ipc.new_file, batches(40, 50)), ("deep/b.feather", pa.ipc.new_file, batches(3, 20, 2000)), ("c.ipc", pa.ipc.new_stream, batches(5, 10, 3000))):
        with new(str(tmp_path / "in" / name), own[0].schema) as w:
            for b in own:
                w.write_batch(b)
    (tmp_path / "in/none.arrow").write_bytes(b"")
    (tmp_path / "in/other.txt").write_text("no")
    return str(tmp_path / "in")


def test_batches_are_read_by_several_tasks(spark, folder):
    got = read_arrow_blocks(spark, folder, task_bytes=20_000)
    assert got.rdd.getNumPartitions() > 5 and got.columns == ["i", "t", "l"]
    want = files.read_arrow(spark, folder)
    assert got.count() == 2000 + 60 + 50 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert read_arrow_blocks(spark, f"file:{folder}/a.arrow").count() == 2000
    with pytest.raises(Exception, match="no Arrow files"):
        read_arrow_blocks(spark, f"{folder}/nothing").count()


def test_columns_are_left_unread(spark, folder):
    got = read_arrow_blocks(spark, folder, ["l", "i"])
    assert got.columns == ["l", "i"] and got.agg(F.sum("i")).first()[0] == sum([*range(2060), *range(3000, 3050)])
    assert read_arrow_blocks(spark, folder, ["t"]).where("t is null").count() == 50 * 6 + 10


def test_a_task_holds_a_batch_at_a_time(tmp_path):
    """200 batches of 2 MB, in tasks of 20 MB: what is held at a time stays near one batch."""
    name = str(tmp_path / "big.arrow")
    with pa.ipc.new_file(name, pa.schema([("x", pa.int64()), ("y", pa.int64())])) as w:
        for k in range(200):
            w.write_batch(pa.record_batch({"x": pa.array(range(k, k + 128_000), pa.int64()), "y": pa.nulls(128_000, pa.int64())}))
    reader = ArrowReader(_listed(f"file://{name}"), ["x"], 20_000_000)
    parts = reader.partitions()
    assert 15 < len(parts) < 30 and parts[0] == Blocks(f"file://{name}", 0, parts[0].last) and parts[-1].last == 200
    before, most, rows = pa.total_allocated_bytes(), 0, 0
    for part in parts:
        for batch in reader.read(part):
            rows += batch.num_rows
            most = max(most, pa.total_allocated_bytes() - before)
    assert rows == 200 * 128_000 and most < 10_000_000


def test_split_of_large_arrow_files(spark, folder, tmp_path):
    counts = jobs.arrow_split(spark, folder, str(tmp_path / "out"), F.col("i"))
    assert counts == {"train": 1688, "val": 422}
    assert {n: read_arrow_blocks(spark, str(tmp_path / "out" / n)).count() for n in counts} == counts
    assert sinks.ARROW_MARK  # the streams that the split wrote have this between messages
