import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import confidence, geometry, metrics, text
from palimpsest.operators.layout import convex_hull


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("reference", "hypothesis", "expected"),
    [
        ("hello world", "hello world", (0, 0, 100)), ("test", "text", (25, 100, 75)), ("hello", "helo", (20, 100, 80)), ("и идѣше поутемь", "и идѣше поутемь", (0, 0, 100)),
        ("гредоущоу же ѥмоу", "гредоущом же ѥмоу", (100 / 17, 100 / 3, 1600 / 17)), ("", "", (0, 0, 100)), ("", "x", (100, 100, 0)), ("a", "bcd", (300, 100, 0)), (None, None, (0, 0, 100)),
    ],
)
def test_rates(spark, reference, hypothesis, expected):
    r, h = F.lit(reference).cast("string"), F.lit(hypothesis).cast("string")
    assert one(spark, metrics.cer(r, h), metrics.wer(r, h), metrics.match_percent(r, h)) == pytest.approx(expected)


def test_overall(spark):
    rows = spark.createDataFrame([("hello", "helo"), ("world", "world")], "reference string, hypothesis string")
    got = metrics.overall(rows).first()
    assert (got.cer, got.wer, got.match, got.micro_cer) == pytest.approx((10, 50, 90, 0.1))
    empty = metrics.overall(rows.limit(0)).first()
    assert (empty.cer, empty.wer, empty.match) == (0, 0, 100)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edit_operations_rebuild_both_texts(a, b):
    ops = metrics.edit_operations(a, b)
    assert "".join(r for _, r, _ in ops) == a
    assert "".join(h for _, _, h in ops) == b
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(last + (x != y), d[j] + 1, d[j - 1] + 1)
    assert sum(op != "equal" for op, _, _ in ops) == d[-1]


def whole_table(a, b):
    """The letters of edit_path, from a full table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in ((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = len(a), len(b), ""
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j, out = i - 1, j - 1, out + ("e" if a[i - 1] == b[j - 1] else "r")
        elif i and d[i][j] == d[i - 1][j] + 1:
            i, out = i - 1, out + "d"
        else:
            j, out = j - 1, out + "i"
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abcé", max_size=40))
def test_edit_path_goes_the_way_of_a_full_table(a, b):
    assert metrics.edit_path(a, b).decode() == whole_table(a, b)


def test_edit_path_of_long_texts_takes_little_memory():
    import random
    import tracemalloc

    rng = random.Random(3)
    a = "".join(rng.choices("abcdefgh ", k=30_000))
    b = "".join(c if rng.random() > 0.1 else rng.choice(["", "x", "yz"]) for c in a)
    tracemalloc.start()
    path = metrics.edit_path(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and len(path) - path.count(b"e") == metrics.sequence_distance(a, b)
    assert "".join(r for _, r, _ in metrics.edit_operations(a, b)) == a and "".join(h for *_, h in metrics.edit_operations(a, b)) == b


def test_diff_operations(spark):
    ops = one(spark, metrics.diff_operations(F.lit("cat"), F.lit("cut")))[0]
    assert [tuple(o) for o in ops] == [("equal", "c", "c"), ("replace", "a", "u"), ("equal", "t", "t")]


def test_points(spark):
    p = lambda c: c.cast("string")
    assert one(spark, p(geometry.parse_points_tolerant(F.lit("1.9,2 x,3 4,5"))), p(geometry.parse_points(F.lit("1.9,2"))), p(geometry.parse_points_flat(F.lit("1 2 3 4"))), geometry.parse_points_flat(F.lit("1 2 3")).isNull()) == ("[{1, 2}, {4, 5}]", None, "[{1, 2}, {3, 4}]", True)
    box = geometry.padded_box(F.lit(2), F.lit(3), F.lit(98), F.lit(49), F.lit(100), F.lit(50))
    assert tuple(one(spark, box)[0]) == (0, 0, 100, 50)
    tight = geometry.tightened_points(geometry.box_points(F.lit(0), F.lit(0), F.lit(9), F.lit(100)), F.lit(30), F.lit(60))
    assert [y for _, y in one(spark, tight)[0]] == [20, 20, 70, 70]
    assert one(spark, geometry.reading_order_index(F.lit("readingOrder {index:5;}")), geometry.reading_order_index(F.lit("structure {type:x;}"))) == (5, None)
    assert one(spark, geometry.polyline_length(geometry.parse_points(F.lit("0,0 3,4"))), geometry.baseline_angle(geometry.parse_points(F.lit("0,0 0,9")))) == (5.0, 0.0)


def test_text(spark):
    space = "  a\tb\x1c "
    assert one(spark, text.strip(F.lit(space)), text.words(F.lit(space)), text.lm_tokens(F.lit("ab c")), text.lm_tokens(F.lit(" \t"))) == ("a\tb", ["a", "b"], "a b <SPACE> c", None)
    assert one(spark, text.duration_text(F.lit(3723)), text.duration_text(F.lit(59)), text.padded_id(F.lit(7)), text.padded_id(F.lit(12345678))) == ("1h 2m 3s", "59s", "000007", "12345678")
    assert one(spark, text.error_type(F.lit("IOError: x")), text.error_type(F.lit("y" * 60)), text.usable_text(F.lit("NaN")), text.percent_text(F.lit(None).cast("double"))) == ("IOError", "y" * 50, ".", "N/A")


def test_confidence(spark):
    values = spark.createDataFrame([(0.5,), (87.0,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in values.select(confidence.normalised(F.col("v"))).collect()] == [0.5, 0.87, None, None]
    parts = confidence.spread_over_text(F.lit("abcdefg"), F.array(F.lit(0.5), F.lit(0.6), F.lit(0.7)))
    assert [p.part for p in one(spark, parts)[0]] == ["ab", "cd", "efg"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=30))
def test_hull_holds_all_points(points):
    hull = convex_hull(points)
    if len(hull) > 2:
        for x, y in points:
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(hull, hull[1:] + hull[:1], strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=40), st.lists(st.booleans(), min_size=40, max_size=40))
def test_edit_path_of_a_part_goes_the_way_of_a_full_table(a, kept):
    b = "".join(c for c, k in zip(a, kept, strict=False) if k)
    assert metrics.edit_path(a, b).decode() == whole_table(a, b) and metrics.edit_path(b, a).decode() == whole_table(b, a)


def test_edit_path_of_a_part_takes_no_columns(monkeypatch):
    monkeypatch.setattr(metrics, "_column", None)
    a = "some letters are gone, others stay where they were; " * 20_000
    b = a.replace("e", "")
    path = metrics.edit_path(a, b)
    assert len(path) == len(a) and path.count(b"e") == len(b) and metrics.edit_path(b, a) == path.replace(b"d", b"i")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcé😀", max_size=90), st.text("abcé\x00", max_size=90)), max_size=12))
def test_distances_side_by_side(pairs):
    assert metrics.distances(pairs) == [metrics.sequence_distance(a, b) for a, b in pairs]
    words = [(list(a), tuple(b)) for a, b in pairs]
    assert metrics.distances(words) == [metrics.sequence_distance(a, b) for a, b in words]


def test_distances_of_many_lengths_take_few_steps(monkeypatch):
    import random

    rng, steps = random.Random(2), []
    pairs = [("".join(rng.choices("abc \ud800", k=rng.choice([0, 1, 7, 8, 63, 64, 65, 300, 900]))), "".join(rng.choices("abcd", k=rng.randint(0, 400)))) for _ in range(300)] + [("ab" * 3000, "ba" * 3000)]
    whole = metrics._side_by_side
    monkeypatch.setattr(metrics, "_side_by_side", lambda own, letters: steps.append(len(own)) or whole(own, letters))
    assert metrics.distances(pairs) == [metrics.sequence_distance(a, b) for a, b in pairs]
    assert len(steps) < 40 and sum(steps) < 300
