"""Steps that large tables need: no Python call for each group, no work that grows with the square of a page, shared folders."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.operators import layout
from palimpsest.sources import sinks

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_hulls_are_sql_and_follow_the_plain_chain(spark):
    rng = random.Random(5)
    rows, corners = [], {}
    for page in range(120):
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            x, y = rng.randint(-50, 900), rng.randint(-50, 900)
            w, h = rng.choice([0, 3, 40]), rng.choice([0, 0, 9, 70])
            x, y = (x, 7) if page % 10 == 0 else (5, y) if page % 10 == 1 else (x, y)
            w, h = (w, 0) if page % 10 == 0 else (0, h) if page % 10 == 1 else (w, h)
            rows.append((page, x, y, x + w, y + h))
            corners.setdefault(page, []).extend([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    hulls = layout.region_hulls(spark.createDataFrame(rows, "page int, x1 int, y1 int, x2 int, y2 int"), "page")
    assert {r.page: [tuple(p) for p in r.hull] for r in hulls.collect()} == {k: layout.convex_hull(v) for k, v in corners.items()}
    assert "Pandas" not in plan_of(hulls) and "Python" not in plan_of(hulls)
    assert hulls.schema["hull"].dataType.simpleString() == "array<struct<x:int,y:int>>"


@pytest.mark.parametrize("name", ["page_parquet_chars", "page_xml_files"])
def test_files_go_to_the_shared_folder_on_a_cluster(spark, monkeypatch, name):
    """spark.checkpoint.dir without a scheme, as a cluster's sessions may have it, is shared all the same."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert "//" not in spark.conf.get("spark.checkpoint.dir") and __spark_entry__.queries()[name](spark, SF).count() > 0


def test_files_go_to_stores_that_only_spark_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./out", tmp_path.as_uri())
    rows = spark.createDataFrame([("a b.xml", "x\ny"), ("p=1%41é.xml", ""), ("c.xml", None)], "name string, text string").repartition(2)
    for _ in range(2):
        assert sinks.write_files(rows, "viewfs://files/out/page", "name", "text") == 3
    found = {f.name: f.read_bytes() for f in (tmp_path / "page").iterdir() if f.suffix == ".xml"}
    assert found == {"a b.xml": b"x\ny\n", "p=1%41é.xml": b"\n", "c.xml": b"\n"}


def test_regions_of_lines_on_a_crowded_page(spark):
    """Four thousand lines and regions of one page, against a plain search; the lines' rows don't meet the regions'."""
    rng = random.Random(8)
    regions = [(1, f"r{i}", i // 2, *(x := sorted(rng.choices(range(-40, 5000), k=2))), *(y := sorted(rng.choices(range(0, 300), k=2)))) for i in range(400)]
    regions = [(p, n, i, x1 + 0.5 * (i % 3), y1 * 1.0, x2 * 1.0, y2 + 0.25) for p, n, i, x1, x2, y1, y2 in regions]
    regions += [(1, "over all", 900, -50.0, -50.0, 20000.0, 400.0), (1, "turned", 0, 90.0, 0.0, 10.0, 300.0), (2, "other", 0, 0.0, 0.0, 9000.0, 900.0), (1, "no number", None, 0.0, 0.0, 9000.0, 900.0)]
    lines = [(1, i, x, y, x + 3, y + 5) for i, (x, y) in enumerate((rng.randint(-60, 5100), rng.randint(-20, 320)) for _ in range(4000))] + [(None, 5000, 1, 1, 2, 2), (1, 5001, 21000, 10, 21002, 12), (1, 5002, 19990, 10, 19992, 12)]
    box = lambda kind: ", ".join(f"{c} {kind}" for c in ("x1", "y1", "x2", "y2"))
    found = layout.region_of_lines(spark.createDataFrame(lines, f"page int, line_id int, {box('int')}"), spark.createDataFrame(regions, f"page int, region_id string, region_idx int, {box('double')}"), "page")
    assert found.columns == ["page", "line_id", "x1", "y1", "x2", "y2", "region_id"]
    got = {r.line_id: r.region_id for r in found.collect()}
    for page, n, x1, y1, x2, y2 in lines:
        cx, cy = (x1 + x2) // 2, (y1 + y2) // 2
        hits = [(i, name) for p, name, i, a, b, c, d in regions if p == page and i is not None and a <= cx <= c and b <= cy <= d]
        assert got[n] == (min(hits)[1] if hits else "r_1"), n
    joins = [x for x in plan_of(found).splitlines() if "Join" in x]
    assert len(got) == len(lines) and joins and not [x for x in joins if "=" in x.replace("==", "")]


def test_equal_centres_ask_once(spark):
    """A hundred times the lines and regions in the same places: what is joined stays as it was."""
    part = spark.range(20_000).selectExpr("1 AS page", "id AS line_id", "int(id % 20) AS x1", "0 AS y1", "int(id % 20) + 2 AS x2", "4 AS y2")
    regions = spark.range(20_000).selectExpr("1 AS page", "string(id) AS region_id", "id AS region_idx", "int(id % 5) AS x1", "0 AS y1", "int(id % 5) + 9 AS x2", "9 AS y2")
    found = layout.region_of_lines(part, regions, "page")
    got = found.groupBy("region_id").agg(F.count("*")).collect()
    assert {r[0]: r[1] for r in got} == {"0": 9000, "1": 1000, "2": 1000, "3": 1000, "4": 1000, "r_1": 7000}


@pytest.mark.parametrize("name", ["alto_image_pairs", "named_image_pairs", "priority_pairing"])
def test_pairs_are_not_sent_whole_to_every_task(spark, name):
    """Names made up from a narrow table's numbers: the sides' estimated sizes are far below what they are."""
    found = __spark_entry__.queries()[name](spark, SF)
    assert "BroadcastHashJoin" not in plan_of(found) and "SortMergeJoin" in plan_of(found)


def test_ways_with_the_same_right_keys_take_one_row_each(spark):
    from palimpsest.operators.pairing import first_match

    left = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "b", "a"), (4, "x", None)], "k int, s string, t string")
    right = spark.createDataFrame([("a", "A", 2), ("a", "A2", 1), ("b", "B", 1), (None, "N", 0), ("y", "x", 9)], "o string, v string, r int")
    ways = [([F.col("s")], [F.col("o")]), ([F.col("t")], [F.col("o")]), ([F.col("s")], [F.col("v")])]
    found = first_match(left, right, "k", ways, "v", ["r"])
    assert sorted((r.k, r.v, r.priority) for r in found.collect()) == [(1, "A2", 0), (2, "B", 1), (3, "B", 0), (4, "x", 2)]


def test_word_lists_are_made_once_and_compared_in_batches(spark):
    from palimpsest.functions import metrics

    space = "a b\x1cc d\x85e  f"
    rows = spark.createDataFrame([(space, "a b c d e f"), (None, "x y"), ("", None), (" w " * 700, "w v " * 350)], "r string, h string")
    found = rows.select(metrics.word_distance(F.col("r"), F.col("h")).alias("d"))
    assert [r.d for r in found.collect()] == [0, 2, 0, 350]
    assert "split" not in plan_of(found).replace("_word_distances", "")
