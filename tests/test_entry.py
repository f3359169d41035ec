import duckdb
import numpy as np
import pytest

import __spark_entry__
from palimpsest.functions import geometry
from palimpsest.operators import api_log
from palimpsest.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted(tuple(map(shown, r)) for r in got.select(*columns).collect())
    if name not in queries.SQL:
        assert ours
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert ours == theirs


def word_errors(a, b):
    """Levenshtein distance of two word lists, a row of the table at a time."""
    known = {w: i for i, w in enumerate({*a, *b})}
    b = np.array([known[w] for w in b])
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != known[w]))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def test_wer_by_source_takes_whole_lines(spark):
    table = str.maketrans("aeiou", "eioua")
    found = {}
    for r in queries.table(spark, SF, "documents").select("source", "text").collect():
        for line in (r.text or "").split("\n"):
            if words := line.split():
                d = word_errors(words, [w.translate(table) for w in words])
                found.setdefault(r.source, []).append((d, d / len(words) * 100))
    got = {r.source: r for r in queries.wer_by_source(spark, SF).collect()}
    assert got.keys() == found.keys() and max(len(v) for v in found.values()) > 100
    for source, own in found.items():
        assert (got[source].lines, got[source].edits) == (len(own), sum(d for d, _ in own))
        assert got[source].wer == pytest.approx(sum(x for _, x in own) / len(own), abs=1e-6)


def test_cer_by_lang_takes_whole_lines(spark):
    table = str.maketrans("aeiou", "eioua")
    found = {}
    for r in queries.table(spark, SF, "documents").select("lang", "text").collect():
        for line in (r.text or "").split("\n"):
            if line.strip():
                found.setdefault(r.lang, []).append((word_errors(line, line.translate(table)), len(line)))
    got = {r.lang: r for r in queries.cer_by_lang(spark, SF).collect()}
    assert got.keys() == found.keys() and max(n for own in found.values() for _, n in own) > 5000
    for lang, own in found.items():
        edits = sum(d for d, _ in own)
        assert (got[lang].lines, got[lang].edits) == (len(own), edits)
        assert got[lang].cer == pytest.approx(sum(d / n * 100 for d, n in own) / len(own), abs=1e-5)
        assert got[lang].micro_cer == pytest.approx(edits / sum(n for _, n in own), abs=1e-6)


def hull_corners(points):
    """Corners by wrapping: from a corner to the point that has no other to its right, the farthest of equal directions."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    corner, out = points[0], set()
    while corner not in out:
        out.add(corner)
        best = next(p for p in points if p != corner)
        for p in points:
            cross = (best[0] - corner[0]) * (p[1] - corner[1]) - (best[1] - corner[1]) * (p[0] - corner[0])
            far = (p[0] - corner[0]) ** 2 + (p[1] - corner[1]) ** 2 > (best[0] - corner[0]) ** 2 + (best[1] - corner[1]) ** 2
            if p != corner and (cross < 0 or cross == 0 and far):
                best = p
        corner = best
    return out


def test_region_hulls_against_wrapping(spark):
    boxes = {}
    for r in queries._boxes(spark, SF).collect():
        boxes.setdefault(r.page, []).extend([(r.x1, r.y1), (r.x2, r.y1), (r.x2, r.y2), (r.x1, r.y2)])
    got = {r.page: [(p.x, p.y) for p in r.hull] for r in queries.region_hulls(spark, SF).collect()}
    assert got.keys() == boxes.keys()
    for page, corners in got.items():
        assert set(corners) == hull_corners(boxes[page]) and len(corners) == len(set(corners))


def test_diff_operations_cost_the_distance(spark):
    ops = queries.diff_operations(spark, SF).collect()
    far = {r.item_id: r.d for r in queries.table(spark, SF, "benchmark").selectExpr("item_id", "levenshtein(text, translate(text, 'aeiou', 'eioua')) AS d").collect()}
    assert {r.item_id: sum(o.op != "equal" for o in r.operations) for r in ops} == far


def test_chunks_with_several_and_missing_overlaps(spark):
    chunks = [("a", 0, "one two"), ("a", 1, "two three"), ("a", 2, "three four"), ("b", 1, "yy"), ("b", 0, "xx"), ("c", 0, "aba"), ("c", 1, "aba"), ("c", 2, "never"), ("d", 0, None), ("d", 1, "late"), ("e", 0, "x" * 300), ("e", 1, "x" * 250)]
    got = {r.k: (r.text, r.used) for r in api_log.joined_chunks(spark.createDataFrame(chunks, "k string, chunk int, text string"), "k").collect()}
    assert got == {"a": ("one two three four", 3), "b": ("xxyy", 2), "c": ("aba", 1), "d": ("late", 2), "e": ("x" * 350, 2)}


def test_reading_order_attributes(spark):
    cases = [("readingOrder {index:7;}", 7), ("structure {type:x;} readingOrder {index: 12 ;}", 12), ("readingOrder {index:3;} readingOrder {index:4;}", 3), ("readingOrder {}", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.o for r in df.select("i", geometry.reading_order_index(df.c).alias("o")).collect()}
    assert got == {i: o for i, (_, o) in enumerate(cases)}


def test_diff_operations_take_whole_texts(spark):
    texts = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    assert max(map(len, texts.values())) > 80
    got = {r.item_id: r.operations for r in queries.diff_operations(spark, SF).collect()}
    assert {i: "".join(o.reference for o in ops) for i, ops in got.items()} == texts
    assert all("".join(o.hypothesis for o in got[i]) == t.translate(str.maketrans("aeiou", "eioua")) for i, t in texts.items())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
