"""Character models and dense numbers against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import language_model as lm
from palimpsest.operators.numbering import numbered
from palimpsest.plans import jobs
from palimpsest.sources import files, sinks


def plain_model(texts, order):
    """{gram: (count, probability)} and {context: share}, each worked out by itself."""
    rows = [lm.BEGIN + t + lm.END for t in ("".join(c for c in x if c not in "\x01\x02\x03").strip() for x in texts if x) if t]
    raw = Counter(r[i : i + n] for r in rows for n in range(1, order + 1) for i in range(len(r) - n + 1))
    before = defaultdict(set)
    for g in raw:
        before[g[1:]].add(g[0])
    counts = {g: c if len(g) == order or g[0] == lm.BEGIN else len(before[g]) for g, c in raw.items() if g != lm.BEGIN}
    cuts = {}
    for n in range(1, order + 1):
        t = [sum(len(g) == n and c == k for g, c in counts.items()) for k in (1, 2, 3, 4)]
        cuts[n] = (0.5, 1.0, 1.5)
        if all(t[:3]):
            y = t[0] / (t[0] + 2 * t[1])
            own = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3))
            cuts[n] = own if all(0 <= d <= k for k, d in enumerate(own, 1)) else cuts[n]
    follow = defaultdict(list)
    for g, c in counts.items():
        follow[g[:-1]].append(c)
    share = {h: sum(cuts[len(h) + 1][min(c, 3) - 1] for c in own) / sum(own) for h, own in follow.items()}
    known = len(follow[""]) + 1

    def p(g):
        if not g:
            return 1 / known
        return (counts[g] - cuts[len(g)][min(counts[g], 3) - 1]) / sum(follow[g[:-1]]) + share[g[:-1]] * p(g[1:])

    return {g: (c, p(g)) for g, c in counts.items()}, share, share[""] / known


def prose(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdeé😀", [9, 7, 5, 3, 2, 1, 1], k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model_equals_a_plain_version(spark, order):
    texts = [*prose(1, 120), None, "", "   ", "a", "a\x02b\x03 ", "ab"]
    counts = lm.adjusted_counts(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("n", F.lit(3)), order)
    model = {(r.n, r.gram): r for r in lm.kneser_ney(counts, order).collect()}
    want, share, even = plain_model(texts, order)
    assert {(r.n, r.gram): r["count"] for r in counts.collect()} == {(len(g), g): c for g, (c, _) in want.items()}
    assert set(model) == {(len(g), g) for g in want} | {(1, lm.UNKNOWN), (1, lm.BEGIN)}
    assert model[1, lm.UNKNOWN].logp == pytest.approx(math.log10(even)) and model[1, lm.BEGIN].logp == pytest.approx(lm.NEVER)
    for g, (_, p) in want.items():
        r = model[len(g), g]
        assert r.logp == pytest.approx(math.log10(p), abs=1e-9), g
        assert r.backoff == (pytest.approx(math.log10(share[g]), abs=1e-9) if g in share and len(g) < order else None), g


def score(model, history, char):
    """Log probability of a character by the ARPA rules."""
    if history + char in model:
        return model[history + char][0]
    if not history:
        return model[lm.UNKNOWN][0]
    return (model[history][1] or 0.0 if history in model else 0.0) + score(model, history[1:], char)


def test_probabilities_of_each_context_sum_to_one(spark):
    order = 4
    texts = prose(2, 200)
    rows = lm.kneser_ney(lm.adjusted_counts(spark.createDataFrame([(t,) for t in texts], "text string"), order), order).collect()
    model = {r.gram: (r.logp, r.backoff) for r in rows}
    alphabet = [g for g in model if len(g) == 1 and g != lm.BEGIN]
    contexts = ["", *[g for g in model if len(g) < order and g[-1] not in lm.END + lm.UNKNOWN], "zz", "a😀z"]
    assert len(contexts) > 100
    for h in contexts:
        assert sum(10 ** score(model, h, c) for c in alphabet) == pytest.approx(1.0, abs=1e-6), h


def test_perplexity_follows_the_arpa_rules(spark):
    order = 4
    model = lm.kneser_ney(lm.adjusted_counts(spark.createDataFrame([(t,) for t in prose(3, 60)], "text string"), order), order)
    known = {r.gram: (r.logp, r.backoff) for r in model.collect()}
    new = [("x", t) for t in prose(4, 30)] + [("y", "qq zebra"), ("y", ""), ("y", None), ("x", "a"), (None, "ab")]
    got = {r.k: r for r in lm.perplexity(spark.createDataFrame(new, "k string, text string"), model, "k", order=order).collect()}
    assert set(got) == {"x", "y", None}
    for key in got:
        logp = chars = unknown = 0
        for t in (lm.BEGIN + t.strip() + lm.END for k, t in new if k == key and t and t.strip()):
            for i in range(1, len(t)):
                logp += score(known, t[max(0, i - order + 1) : i], t[i])
                unknown += t[i] not in known
                chars += 1
        r = got[key]
        assert (r.chars, r.unknown) == (chars, unknown)
        assert r.logp == pytest.approx(logp) and r.perplexity == pytest.approx(10 ** (-logp / chars))
    assert got["y"].unknown > 0


def test_empty_corpora(spark):
    none = spark.createDataFrame([(None,), ("  ",)], "text string")
    assert lm.adjusted_counts(none, 3).count() == 0
    assert lm.kneser_ney(lm.adjusted_counts(none, 3), 3).count() == 0


def test_arpa_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab a\n\nba b\nabc\n")
    model = jobs.character_model(spark, str(tmp_path / "in"), str(tmp_path / "out"), "text", 3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/arpa").glob("part-*")))
    rows = text.split("\n")
    sizes = Counter(r.n for r in model.collect())
    assert rows[0] == "\\data\\" and rows[1:4] == [f"ngram {n}={sizes[n]}" for n in (1, 2, 3)] and rows[-2:] == ["\\end\\", ""]
    at, found = None, {}
    for row in rows[4:-2]:
        if row.startswith("\\"):
            at = int(row[1])
        elif row:
            p, gram, *backoff = row.split("\t")
            assert len(gram.split(" ")) == at and len(backoff) < 2
            found[gram] = (float(p), float(backoff[0]) if backoff else None)
    assert len(found) == sum(sizes.values()) and {"<s>", "</s>", "<unk>", "<SPACE>", "<s> a b", "b <SPACE>"} <= set(found)
    assert found["<s>"][0] == -99 and found["a b c"][1] is None and found["a b"][1] is not None


def test_numbers_are_dense(spark):
    n = numbered(spark.range(100).repartition(7).select((F.col("id") * 3).alias("o"), F.lit("x").alias("_place")), "o")
    assert all(r.o == 3 * r.number and r._place == "x" for r in n.collect()) and n.count() == 100
    assert numbered(spark.range(0), "id", first=5).collect() == []
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            many = spark.range(200_000).select(F.xxhash64("id").alias("o"), (F.col("id") % 3).alias("third")).withColumn("third", F.when(F.col("third") > 0, F.col("third")))
            got = numbered(many, "third", "o", first=1)
            assert got.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first() == (200_000, 200_000, 1, 200_000)
            pairs = got.alias("a").join(got.alias("b"), F.expr("a.number + 1 = b.number"))
            wrong = F.expr("struct(a.third is not null, a.third, a.o) > struct(b.third is not null, b.third, b.o)")
            assert pairs.count() == 199_999 and pairs.where(wrong).count() == 0
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbers_of_a_long_list_of_samples(spark, tmp_path):
    spark.range(120_000).select(F.format_string("img/%d.png", "id").alias("p"), F.col("id").cast("string").alias("t")).coalesce(1).write.csv(str(tmp_path / "list"))
    rows = files.read_pairs_csv(spark, str(tmp_path / "list")).withColumn("_order", F.monotonically_increasing_id())
    got = numbered(rows, "_order")
    assert got.where(F.col("text") != F.col("number").cast("string")).count() == 0 and got.count() == 120_000
    names = sinks.line_list_rows(got, "number")
    assert names.distinct().count() == 120_000 and names.where("value = 'images/119999.png 119999'").count() == 1


@pytest.mark.parametrize("order", [1, 3, 5, 9, 70])
def test_counts_of_pieces_are_those_of_texts(order, monkeypatch):
    """N-grams as numbers, in pieces of a few lines, against a plain count; of order nine and more some characters don't fit."""
    rng = random.Random(order)
    monkeypatch.setattr(lm, "PIECE", 300)
    texts = ["".join(rng.choices("abc d\0é😀" + ("".join(map(chr, range(300, 520))) if k % 3 == 0 else ""), k=rng.choice([0, 1, 2, 4, 30, 90]))) for k in range(200)] + [" \x01 ", "\x02a\x03 \x1c", " b c"]
    counts, want = lm._Counts(order), Counter()
    for t in map(lm.marked, texts):
        if t:
            counts.add(t)
            want.update(t[i : i + order] for i in range(len(t) - order + 1))
            want.update(t[:k] for k in range(2, min(order - 1, len(t)) + 1))
    got = Counter()
    for gram, n in zip(*counts.rows(), strict=True):
        got[gram] += n
    assert got == want
    assert [lm.marked(t) for t in texts[-3:]] == ["", "\x02a\x03", "\x02b c\x03"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 16, 21])
def test_counts_of_lines_longer_than_a_piece(order, piece, monkeypatch):
    """Lines cut into pieces lose no n-gram and gain none, also where pieces are counted in narrow and in wide numbers."""
    rng = random.Random(order * 100 + piece)
    monkeypatch.setattr(lm, "PIECE", piece)
    lines = [lm.BEGIN + "".join(rng.choices("ab é😀" + ("".join(map(chr, range(300, 400))) if k > 6 else ""), k=rng.choice([1, 2, 3, 9, 160]))) + lm.END for k in range(14)]
    counts, want = lm._Counts(order), Counter()
    assert [t for own in lm._pieces(lines) for t in own] == lines
    for own in lm._pieces(lines):
        counts.add(*own)
    for t in lines:
        want.update(t[i : i + order] for i in range(len(t) - order + 1))
        want.update(t[:k] for k in range(2, min(order - 1, len(t)) + 1))
    got = Counter()
    for gram, n in zip(*counts.rows(), strict=True):
        got[gram] += n
    assert got == want


def test_a_long_line_is_counted_in_little_memory():
    """A line of 8 million characters: beside its 4 bytes a character, what is held is some arrays of a piece."""
    import tracemalloc

    line = lm.BEGIN + "abcd efg" * 1_000_000 + lm.END
    counts = lm._Counts(4)
    tracemalloc.start()
    counts.add(line)
    counts.merge()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and dict(zip(*counts.rows(), strict=True))["abcd"] == 1_000_000
