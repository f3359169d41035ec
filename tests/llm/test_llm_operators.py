import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, html_extract, html_training, licenses, minhash, sentencepiece_codec, token_counts, topk, toxicity, url_filter, warc
from palimpsest.llm.common import Scratch, hash_words, words_of
from palimpsest.llm.queries import piece_model

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({"node": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5), "_text": F.lit("z"), "item_id": F.lit(7)}) if extra else df


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


# --- 1 licence scan


def test_licenses_against_brute_force(spark):
    rng = random.Random(1)
    notices = [t.text for t in licenses.TEMPLATES]
    texts = [None, "", " \n \n", "!!!", "Released under the MIT License", "released UNDER the mit\nlicense", "All rights reserved. All rights reserved."]
    for _ in range(60):
        words = rng.choice(notices).split()
        del words[rng.randrange(len(words))]
        texts.append("\n".join([prose(rng, rng.randint(1, 40)), " ".join(words), *[""] * rng.randint(0, 2), prose(rng, 5)]))
    texts += [f"{prose(rng, 30)}. {rng.choice(notices)}  {prose(rng, 20)}!\tEnd. " for _ in range(20)]
    got = sorted((r.doc_id, r.unit, r.unit_no, r.license_id, r.template, r.dice) for r in licenses.scan(docs_of(spark, texts, extra=True)).collect())
    want = []
    for i, text in enumerate(texts):
        parts = re.split(r"\n[ \t]*\n", text or "")
        marked = [x for x in re.sub("([.!?])[ \t]+", "\\1\x1e", text or "").split("\n") if "\x1e" in x]
        units = [("line", k, x) for k, x in enumerate((text or "").split("\n"))] + [("sentence", k, x) for k, x in enumerate(y for x in marked for y in x.split("\x1e"))] + [("paragraph", k, x) for k, x in enumerate(parts) if "\n" in x] + ([("document", 0, text)] if len(parts) > 1 else [])
        for (unit, k, piece), t in itertools.product(units, licenses.TEMPLATES):
            a, b = set(licenses.template_bigrams(piece)), set(licenses.template_bigrams(t.text))
            if a and (d := round(2 * len(a & b) / (len(a) + len(b)), 6)) >= 0.8:
                want.append((i, unit, k, t.license_id, t.name, d))
    assert got == sorted(want) and len(want) > 50 and {"line", "sentence", "paragraph", "document"} <= {w[1] for w in want}
    assert len({t.license_id for t in licenses.TEMPLATES}) > 15 and not licenses.COMMON & set(licenses.telling_words(licenses.TEMPLATES, 0.8))
    assert licenses.scan(docs_of(spark, [""]).limit(0)).count() == 0
    one = docs_of(spark, ["All rights reserved."]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [(r.doc_id, r.license_id) for r in licenses.scan(one.unionByName(one)).collect()] == [(None, "proprietary")] * 2


# --- 2 top-k


@pytest.mark.parametrize("scale", [1, 64])
def test_top_k_against_brute_force(spark, scale):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, rng.normal(size=8) * rng.choice([0.1, 1, 10]))) for _ in range(300)] + [[1.0] * 8] * 30
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [9.0] * 8), (420, []), (440, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("row", F.lit(1))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, scale=scale).orderBy("query_id", "rank").collect()]
    ints = np.floor(np.array(vectors) * scale).astype(np.int64)
    want = []
    for q in range(0, 330, 20):
        found = sorted((-int(ints[q] @ ints[c]), c) for c in range(330) if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("spread", "cells"), [(0.0, (64, 8, 16)), (1.5, (64, 8, 16)), (3.0, (1000, 30, 100))])
def test_top_k_over_many_cells(spark, monkeypatch, spread, cells):
    for name, size in zip(("CELL_CANDIDATES", "CELL_QUERIES", "LEAST_STRIP"), cells, strict=True):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(24)
    vectors = rng.normal(size=(900, 6)) * np.exp(rng.normal(size=(900, 1)) * spread)
    vectors[:40] = vectors[40:80]
    vectors[100:140] = 0
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)] + [(i, [float(i), 1.0]) for i in range(1000, 1061)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    ints = {i: [int(np.floor(x * 64)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 1061, 20):
        if q in ints:
            found = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:20]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    assert got == want


def test_strips_hold_all_classes():
    assert topk.strips_of({}, 10) == []
    assert topk.strips_of({3: 4, 9: 3, 8: 7, 1: 25, 0: 2}, 10) == [(8, 9, 1), (3, 3, 1), (1, 1, 3), (0, 0, 1)]


# --- 3 HTML


def test_extraction_on_held_out_layouts():
    chain, right, total = html_extract.default_chain(), 0, 0
    for page, main in html_training.labelled_pages(150, seed=77):
        blocks = html_extract.blocks_of(page)
        labels = html_extract.viterbi(chain, [html_extract.features(blocks)])[0]
        right += sum(int(b.text in main) == y for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total > 0.99


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    chain = html_extract.Chain(rng.normal(size=(len(html_extract.FEATURE), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [[list(rng.choice(50, 3)) for _ in range(n)] for n in (1, 4, 0, 7)]
    for page, got in zip(pages, html_extract.viterbi(chain, pages), strict=True):
        score = lambda ys, page=page: sum(chain.state[f, y].sum() for f, y in zip(page, ys, strict=True)) + sum(chain.move[a, b] for a, b in itertools.pairwise(ys)) + (chain.start[ys[0]] if ys else 0)
        assert list(got) == list(max(itertools.product((0, 1), repeat=len(page)), key=score) if page else [])


def test_blocks():
    page = '<html><head><title>t</title></head><body><script>if (a<b) "<p>";</script><p>a &amp; <b>b</b>\n c<br>d<p>e&nbsp;&eacute;<table><tr><td>x<td>y</table><!-- <p>no</p> --><a href="1 > 2">link</a> tail'
    assert [b.text for b in html_extract.blocks_of(page)] == ["a & b c d", "e é", "x", "y", "link tail"]
    assert html_extract.blocks_of("just text")[0].text == "just text"


def test_extract_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<nav><a href='/'>Home</a></nav>"), (4, "u", "<article><h1>T</h1><p>" + "Long text here, and more. " * 2000 + "</p></article>"), (4, "u", "<p")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.n_chars > 100): r for r in html_extract.extract(pages).collect()}
    assert got[1, False].text == "" and got[2, False].url is None and got[3, False].n_chars == 0
    assert got[4, True].text == "T\n" + ("Long text here, and more. " * 2000).strip()
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 4 decontamination


def naive_tiles(doc, item, least):
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for q, p in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_d and q + n not in marked_i:
                n += 1
            if n >= least and (best is None or n > best[0]):
                best = (n, q, p)
        if best is None:
            return out
        n, q, p = best
        marked_d.update(range(p, p + n))
        marked_i.update(range(q, q + n))
        out.append((p, q, n))


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        doc, item = [rng.choice("abc") for _ in range(rng.randint(0, 30))], [rng.choice("abc") for _ in range(rng.randint(3, 15))]
        (words, o) = hash_words([" ".join(doc), " ".join(item)])
        index = decontaminate.BenchmarkIndex([1], [words[o[1] :]], 3)
        runs = index.runs(words[: o[1]], block=rng.choice([1, 7, 1 << 18])).get(0, [])
        assert sorted(decontaminate.tile(runs, 3)) == sorted(naive_tiles(doc, item, 3))


def test_rolling_hashes_against_sums():
    rng = np.random.default_rng(19)
    for size, n in ((0, 5), (4, 5), (5, 5), (60, 5), (9, 1)):
        words = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        want = [sum(int(w) * pow(decontaminate._BASE, k) for k, w in enumerate(words[i : i + n])) % (1 << 64) for i in range(max(0, size - n + 1))]
        assert decontaminate.rolling_hashes(words, n).tolist() == want


def test_repeated_words_are_tiled_in_bounded_memory():
    import tracemalloc

    words, o = hash_words(["a " * 30_000, "a " * 150 + "b c d e f"])
    index = decontaminate.BenchmarkIndex([1], [words[o[1] :]], 5)
    tracemalloc.start()
    assert index.covered(words[: o[1]], 0.5) == [(1, 150 / 155, 150, 1, 150)]
    assert tracemalloc.get_traced_memory()[1] < 60e6


def test_both_paths_against_brute_force(spark):
    rng = random.Random(20)
    phrase = prose(rng, 8)
    items = [f"{phrase} {prose(rng, rng.randint(1, 30))}" if rng.random() < 0.7 else prose(rng, rng.randint(1, 12)) for _ in range(40)] + ["x y x y x y x y x y", "z " * 20]
    texts = [phrase, "x y " * 30, "z " * 12]
    for _ in range(60):
        parts = [phrase, prose(rng, rng.randint(0, 20))]
        for item in rng.sample(items, 2):
            w = item.split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a:] + w[:a] if rng.random() < 0.5 else w[: max(1, len(w) * 2 // 3)])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[3:6]
    want = []
    for (d, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = words_of(text), words_of(item)
        tiles = naive_tiles(a, b, min(5, len(b)))
        if sum(n for _, _, n in tiles) >= 0.5 * len(b):
            want.append((d, i, sum(n for _, _, n in tiles), len(tiles)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for most in (4_000_000, 0):
        got = sorted((r.doc_id, r.item_id, r.matched_words, r.tiles) for r in decontaminate.contaminated(docs_of(spark, texts), bench, most_seeds=most).collect())
        assert got == want and len(want) > 60


def test_decontamination(spark):
    rng = random.Random(5)
    item = prose(rng, 40).split()
    shuffled = " ".join(item[20:] + item[:20])
    texts = [prose(rng, 50) + " " + " ".join(item).upper() + ".", prose(rng, 10) + ", " + shuffled, prose(rng, 3000), " ".join(item[:15]) + " " + prose(rng, 9), None, "", "two words", shuffled]
    docs = docs_of(spark, texts, extra=True)
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "two words"), (3, None), (4, ""), (None, "x y z")], "item_id bigint, text string")
    for most in (4_000_000, 0):
        got = sorted((r.doc_id, r.item_id, round(r.coverage, 3), r.tiles) for r in decontaminate.contaminated(docs, bench, most_seeds=most).collect())
        assert got == [(0, 1, 1.0, 1), (1, 1, 1.0, 2), (6, 2, 1.0, 1), (7, 1, 1.0, 2)]
        clean = decontaminate.clean_documents(docs, bench, most_seeds=most)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


# --- 5 toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.withColumn("score", F.lit(1)), model).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
    assert all(0 <= r.score <= 1 for r in rows)


def test_nnpu_risk_against_numerical_gradients():
    rng = np.random.default_rng(22)
    n, n_pos, f = 14, 5, 6
    has = rng.random((n, f)) < 0.4
    rows, cols = np.nonzero(has)
    signs = set()
    for scale, prior in ((0.3, 0.2), (3.0, 0.2), (1.0, 0.7), (3.0, 0.8)):
        w = rng.normal(size=f + 1) * scale
        g = has @ w[:-1] + w[-1]
        loss = lambda x: np.log1p(np.exp(-x))
        toxic, rest, grad = toxicity.nnpu_risk(w, rows, cols, n_pos, n, prior, 0.01)
        assert toxic == pytest.approx(prior * loss(g[:n_pos]).mean()) and rest == pytest.approx(loss(-g[n_pos:]).mean() - prior * loss(-g[:n_pos]).mean())
        signs.add(rest >= 0)

        def stepped(v, sign=rest >= 0):
            a, b, _ = toxicity.nnpu_risk(v, rows, cols, n_pos, n, prior)
            return (a + b if sign else -b) + 0.005 * (v[:-1] ** 2).sum()

        for k in range(f + 1):
            e = np.eye(f + 1)[k] * 1e-5
            assert grad[k] == pytest.approx((stepped(w + e) - stepped(w - e)) / 2e-5, abs=1e-7)
    assert signs == {True, False}


def test_toxicity_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(23)
    bad = [f"{prose(rng, 5)} zzfoul {prose(rng, 5)}" for _ in range(40)]
    texts = bad + [prose(rng, 12) for _ in range(160)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 200, 2)], "doc_id bigint, toxic int")
    again = docs.where("doc_id in (0, 1)").withColumn("text", F.concat("text", F.lit(" other")))
    for _ in range(5):
        again = again.unionByName(again)
    model = toxicity.train(docs, labels)
    assert model.weights and toxicity.train(docs.unionByName(again), labels) == model
    assert len(toxicity._feature_lists(docs.limit(3), "text")) == 3
    long = docs_of(spark, ["clean " * 400_000 + "zzfoul", "clean " * 400_000], extra=True)
    assert [r.predicted for r in toxicity.score(long, model).orderBy("doc_id").collect()] == [1, 0]
    assert [r.doc_id for r in toxicity.keep_clean(long, model).collect()] == [1]


def test_toxicity_edge_cases(spark):
    docs = docs_of(spark, [None, "", "fine words", "fine words"], extra=True)
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0] * 4
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0
    held = docs.select("doc_id", toxicity.held_out().alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


# --- 6 token counts


def greedy(word, starting, going_on):
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (going_on if at else starting)), None)
        if end is None:
            return None
        at, count = end, count + 1
    return count


def test_longest_match_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        letters = "abc"[: rng.randint(1, 3)]
        starting, going_on = ({"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 8))} for _ in range(2))
        automaton = token_counts.LongestMatch(starting, going_on)
        for _ in range(30):
            word = "".join(rng.choices(letters, k=rng.randint(1, 14)))
            assert automaton.pieces(word) == greedy(word, starting, going_on)


def test_token_counts(spark):
    vocabulary = token_counts.piece_vocabulary(piece_model())
    texts = [None, "", "the the, tokens!", "日本 x", "a" * 5000]
    starting, going_on = map(set, vocabulary)
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts, extra=True).withColumns({"n_words": F.lit(9), "n_tokens": F.lit("x")}), vocabulary).collect()}
    for i, text in enumerate(texts):
        each = [greedy(w, starting, going_on) for w in re.findall(r"\w+|[^\w\s]", text or "")]
        assert (rows[i].n_words, rows[i].n_tokens, rows[i].n_unknown) == (len(each), sum(1 if n is None else n for n in each), each.count(None))
    twice = docs_of(spark, ["the the"]).unionByName(docs_of(spark, ["the the"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    assert sorted((str(r.doc_id), r.n_words) for r in token_counts.count_tokens(twice.unionByName(twice), vocabulary).collect()) == [("0", 2)] * 2 + [("None", 2)] * 2
    assert token_counts.count_tokens(twice.limit(0), vocabulary).count() == 0


# --- 7 near-duplicates


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(7)
    k, sets = 512, []
    for _ in range(6):
        e = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        sets.append((e, rng.integers(1, 6, len(e))))
    offsets = np.concatenate([[0], np.cumsum([len(e) for e, _ in sets])])
    signature = minhash.dart_signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(float), offsets, k)
    for i, j in itertools.combinations(range(6), 2):
        assert abs((signature[i] == signature[j]).mean() - minhash.weighted_jaccard(sets[i], sets[j])) < 4.5 * (0.25 / k) ** 0.5


def brute_classes(texts):
    words, o = hash_words(texts)
    sets = [minhash.weighted_shingles(words[a:b]) for a, b in itertools.pairwise(o)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] and texts[i] == texts[j] or len(sets[i][0]) and len(sets[j][0]) and minhash.weighted_jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "", "###", "###", "$$", "one", "One!", "one two", prose(rng, 6000)]
    for n in (8, 60, 200):
        base = prose(rng, n).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 60))):
                copy[rng.randrange(n)] = prose(rng, 1)
            texts.append(" ".join(copy))
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 30)}" for _ in range(20)] + [prose(rng, 50) for _ in range(20)] + [texts[9] + " end"]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, texts, extra=True)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = minhash.keep_one(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == DOCS.replace(",", "").split()[::2]


def test_near_duplicates_edge_cases(spark):
    docs = docs_of(spark, ["same text here"] * 2 + [None])
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "same text here", "en", "s", 1)], DOCS))
    got = sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_duplicates(twice).collect())
    assert got == [("0", "0")] * 2 + [("1", "0")] * 2 + [("2", "2")] * 2 + [("None", "0")]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_to_ordinary_members_of_the_head_component(spark):
    rng = random.Random(12)

    def changed(words, at):
        return [prose(rng, 1) if i in at else w for i, w in enumerate(words)]

    texts, chains = [], []
    for _ in range(2):
        base = prose(rng, 200).split()
        texts += [" ".join(changed(base, range(rng.randrange(15), 200, 15))) for _ in range(80)]
        chains.append([base, middle := changed(base, range(10, 190, 45)), changed(middle, range(30, 190, 45))])
    texts += [" ".join(chain[i]) for i in (2, 1, 0) for chain in chains]
    prints = minhash.fingerprints(docs_of(spark, texts), "doc_id", "text", minhash.BANDS, minhash.ROWS)
    nodes = prints.select(F.col("doc_id").alias("node"), "n", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("keys"), "sketch")
    roots = minhash.linked_roots(nodes, docs_of(spark, texts).select(F.col("doc_id").alias("node"), "text"), Scratch(spark, "t"))
    got = {r.node: r.root for r in roots.collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert len(set(got.values())) == 162


def test_a_large_bucket_of_boilerplate(spark):
    rng = random.Random(15)
    text, rare = prose(rng, 120), prose(rng, 30)
    texts = [f"{text} {prose(rng, 60)}" for _ in range(300)] + [f"{text} {prose(rng, 25)}" for _ in range(60)] + [f"{text} {rare}" + f" {prose(rng, 1)}" * (i % 4) for i in range(40)]
    texts += [f"{t} {prose(rng, 6)}" for t in texts[5:300:50]] + ["four words are few", "word " * 40, "word " * 45]
    prints = minhash.fingerprints(docs_of(spark, texts), "doc_id", "text", minhash.BANDS, minhash.ROWS)
    nodes = prints.select(F.col("doc_id").alias("node"), "n", F.array(F.lit(1).cast("bigint")).alias("keys"), "sketch")
    roots = minhash.linked_roots(nodes, docs_of(spark, texts).select(F.col("doc_id").alias("node"), "text"), Scratch(spark, "t"))
    got = {r.node: r.root for r in roots.collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert 300 < len(set(got.values())) < 390


def test_prefix_pairs_miss_no_link(spark):
    rng = random.Random(16)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.choice([4, 9, 40, 90])).split() * rng.choice([1, 1, 2])
        texts += [" ".join(w if rng.random() > 0.02 else prose(rng, 1) for w in base[: len(base) - rng.randint(0, 2)]) for _ in range(8)]
    sets = [minhash.weighted_shingles(w) for w in (hash_words([t])[0] for t in texts)]
    for root in (lambda i: i, lambda i: i % 3):
        rows = [(i, root(i), int(c.sum())) for i, (_, c) in enumerate(sets)]
        shingles = spark.createDataFrame([(i, [int(x) for x in h.view(np.int64)], [int(x) for x in c]) for i, (h, c) in enumerate(sets)], "node bigint, shingles array<bigint>, counts array<int>")
        found = minhash.prefix_pairs(spark.createDataFrame(rows, "node bigint, root bigint, n int"), shingles, Scratch(spark, "t"))
        got = {(r.a, r.b) for r in found.collect() if minhash.weighted_jaccard(sets[r.a], sets[r.b]) >= 0.8}
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if root(i) != root(j) and minhash.weighted_jaccard(sets[i], sets[j]) >= 0.8}
        assert got == want and want


def test_one_of_each_class_stays_of_repeated_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f!"), (None, "a b c d e f"), (None, "x y z"), (None, "x y z"), (4, None), (4, None), (5, "g h"), (5, "i j"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class_id", F.lit("clash"))
    kept = minhash.keep_one(docs)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(2, "A b c d e f!"), (None, "x y z"), (4, None), (4, None), (5, "g h"), (5, "i j"), (6, "")]))
    assert kept.columns == docs.columns


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102)] + [(1000, i) for i in range(1001, 1400)], "a bigint, b bigint")
    got = {r.node: r.root for r in minhash.components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)} | {i: 1000 for i in range(1000, 1400)}


# --- 8 SentencePiece


def test_codec_against_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = random.Random(9)
    texts = [None, "", "", " ", "  a  b", "  a  b", "▁x ▁▁y", "l\n\n m\n", "\t\r\n", "日本語 ünï 🎉", " " * 70, "a" * 3000, "\x00a", "<s> <unk> <0x41>", "1234 5"]
    texts += ["".join(rng.choices("the tion aé\n▁ 日1,", k=rng.randint(1, 200))) for _ in range(300)]
    rows = sentencepiece_codec.encode_documents(docs_of(spark, texts, extra=True), piece_model(), check="texts", with_ids=True, with_text=True).collect()
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        back = library.decode(ids)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), back)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(docs_of(spark, [""]).limit(0), piece_model()).count() == 0


def test_cache_is_bounded_by_characters():
    with open(piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read(), young=5_000)
    rng = random.Random(21)
    for _ in range(60):
        words = {" " + "".join(rng.choices("theaion", k=rng.choice([3, 8, 400, 2000]))) for _ in range(30)}
        known = codec.learn(words, True)
        assert words <= known.keys()
        for w in codec.long:
            del codec.new[w]
        codec.long = []
        assert sum(map(len, codec.new)) == codec.size and max(map(len, codec.new | codec.old)) <= 100
        assert sum(map(len, codec.new)) + sum(map(len, codec.old)) < 2 * 5_000 + 2 * 30 * 10


def test_codec_holds_decoding_against_the_library():
    with open(piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read())
    codec.surface[codec.agenda("▁the")[0]] = b" thy"
    with pytest.raises(AssertionError, match="differ"):
        codec.learn({" the"}, True)


def test_both_agendas_agree():
    with open(piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read())
    rng = random.Random(10)
    for _ in range(2000):
        word = "".join(rng.choices("▁theaionrs", k=rng.randint(1, 40)))
        assert codec._short(word) == codec._long(word)


def test_words_are_encoded_side_by_side(monkeypatch):
    with open(piece_model(), "rb") as f:
        codec = sentencepiece_codec.PieceCodec(f.read())
    rng = random.Random(22)
    words = {"".join(rng.choices(" theaionrs", k=rng.randint(0, 3))) + "".join(rng.choices("theaionrsTHEé日1,.-", k=rng.randint(1, 45))) for _ in range(5000)} | {"\n", " ", "   ", "a", " " * 48}
    own = {w: codec.agenda(w.replace(" ", "▁")) for w in words}
    odd = {" 🎉🎉x\x00", "b" * 49, " " + "the" * 40}
    known = dict(codec.learn(words | odd, True))
    assert all(known[w][0] == ",".join(map(str, own[w] if w in own else codec.agenda(w.replace(" ", "▁")))) for w in words | odd)
    monkeypatch.setattr(codec, "agenda", lambda text: pytest.fail(text) if text != "\n" else [codec.bytes[10]])
    codec.new, codec.long = {}, []
    assert {w: known[w] for w in words} == {w: codec.learn(words, True)[w] for w in words}


# --- 9 WARC


def test_warc_round_trip(spark, tmp_path):
    odd = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, "http://a/b c\n", "x" * 200), (2, "u", "x" * 200), (None, None, "x" * 200), (3, None, None), (4, "", ""), (5, "https://ü.org/p?q#f", odd), (5, "https://ü.org/p?q#f", odd), (6, "z", odd), (7, "s", "y" * 99), (8, "s", "y" * 99), (9, "l", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("first", F.lit(1))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_captures(pages).collect())
    size = lambda h: len((h or "").encode())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {2: 1, 6: 5}
    assert got == sorted((i or 0, size(h), digest(h), "revisit" if i in first else "response", first.get(i)) for i, _, h in rows)
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows) == records.select("record_id").distinct().count()
    named = records.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    assert named.join(records.where("record_type = 'response'"), "record_id").count() == named.count() == 2
    import gzip
    import zlib

    files = list((tmp_path / "w").glob("*.warc.gz"))
    data = b"".join(f.read_bytes() for f in files)
    assert files and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 3 * len(rows)
    members = []
    while data:
        one = zlib.decompressobj(31)
        members.append(one.decompress(data))
        data = one.unused_data
    assert sorted(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in members if m) == [True] * 3 * len(rows)
    payloads = sorted(bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect())
    assert payloads == sorted(h or "" for i, _, h in rows if i not in first)
    capture = warc.assemble(records).where("response.target_uri like '%org%'").first()
    assert capture.request.fields["host"] == "ü.org" and capture.metadata[0].fields["page_id"] == "5"
    assert warc.page_captures(pages.limit(0)).count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip

    def record(kind, own, block, *more):
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    data = [record("warcinfo", "i", b"software: x\r\n"), record("request", "q", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", http), record("response", "r", b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n\r\nbody", http, "WARC-Concurrent-To: <q>"), record("metadata", "m", b"k: v\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <r>"), record("metadata", "lost", b"", "WARC-Concurrent-To: <none>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    got = warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert len(got) == 1 and (got[0].request.record_id, [m.record_id for m in got[0].metadata], bytes(got[0].response.payload)) == ("<q>", ["<m>"], b"body")
    assert got[0].response.fields["a"] == "b c"
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse_archive(data[0][:-8]))
    with pytest.raises(ValueError, match="no WARC record at byte"):
        list(warc.parse_archive(data[0] + b"junk"))
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.parse_archive(gzip.compress(data[2])[:-20]))


def test_archives_are_read_in_pieces():
    import gzip

    rng = random.Random(25)
    blocks = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 70_000, 200_000]))) for _ in range(12)]
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: " + str(len(b)).encode() + b"\r\n\r\n" + b + b"\r\n\r\n" for b in blocks]
    for content in (b"".join(records), gzip.compress(b"".join(records)), b"".join(gzip.compress(r) + b"\0" * (i % 3) for i, r in enumerate(records)), b"".join(gzip.compress(r) + warc.EMPTY_MEMBER for r in records)):
        assert [block for _, block in warc.parse_archive(content)] == blocks
    many = gzip.compress(records[0]) * 20_000
    assert sum(1 for _ in warc.parse_archive(many)) == 20_000


def test_several_requests_of_a_capture(spark):
    def row(kind, own, beside=()):
        return (kind, own, list(beside), None, None, None, None, 0, "", {}, b"")

    rows = [row("response", "r"), row("request", "q2", ["r"]), row("request", "q1", ["r"]), row("metadata", "m", ["r"]), row("request", None, ["r"]), row("response", None)]
    got = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert got["r"].request.record_id == "q1" and [q.record_id for q in got["r"].requests] == ["q1", "q2"] and [m.record_id for m in got["r"].metadata] == ["m"]
    assert got[None].requests is None and warc.assemble(spark.createDataFrame([], warc.RECORDS)).count() == 0


# --- 10 URL filter


def judged(url, rules=url_filter.RULES):
    """host, path and the longest fitting rule, written out plainly."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.split("[?#]", rest, maxsplit=1)[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.text)) if fit else None


def test_rules_against_brute_force(spark):
    urls = [None, "", "x", "HTTP://Ex.ORG:80/a", "https://Example.ORG/en/1x#q", "a://b://c", "x://É.com/fr/", "y://notorg/", "z://org/", "http://h.example.org?x=/", "http://a.org\n/b/", "s://w.com/de/?q"]
    urls += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit("clash")})
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, url in enumerate(urls):
        host, path, rule = judged(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None), url
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_markov_models():
    rng = random.Random(11)
    good, bad = (["".join(rng.choices(w, k=4)) for _ in range(400)] for w in (["news/", "story/", "art/"], ["promo?", "win$", "ad&"]))
    a, b = url_filter.MarkovModel(4).fit(good[:300]), url_filter.MarkovModel(4).fit(bad[:300])
    letters = {c for u in good + bad for c in u} | {"$"}
    assert sum(a.probability("new", c) for c in letters) + (256 - len(letters)) * a.probability("new", "\0") == pytest.approx(1)
    model, known = url_filter.UrlModel(a, b), {}
    model.threshold = url_filter.calibrate([(model.score(u, known), y) for us, y in ((good[:300], True), (bad[:300], False)) for u in us])
    assert all(model.score(u, known) >= model.threshold for u in good[300:]) and all(model.score(u, known) < model.threshold for u in bad[300:])


def test_url_models_learn_from_all_urls(spark):
    rng = random.Random(13)
    urls = [f"http://{rng.choice('abc')}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'é'])}/{rng.randrange(10**7)}" for _ in range(30_000)]
    rows = list(enumerate(urls + [None, "", urls[0]]))
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(got) == len(rows)
    labelled = {u: rule.verdict for u in set(urls) if (rule := judged(u)[2])}
    assert min(list(labelled.values()).count(v) for v in ("allow", "block")) > 6000 / 2 and len(labelled) > 12_000
    held = {r.url for r in spark.createDataFrame([(u,) for u in labelled], "url string").where("pmod(xxhash64(url), 4) = 0").collect()}
    model, known = url_filter.UrlModel(*(url_filter.MarkovModel().fit([u for u, v in labelled.items() if v == verdict and u not in held]) for verdict in ("allow", "block"))), {}
    model.threshold = url_filter.calibrate([(model.score(u, known), labelled[u] == "allow") for u in held])
    for i, url in rows:
        if not judged(url)[2]:
            score = model.score(url or "", known)
            assert got[i].score == pytest.approx(score, abs=1e-9)
            assert abs(score - model.threshold) < 1e-9 or got[i].verdict == ("allow" if score >= model.threshold else "block")


def test_very_long_urls(spark):
    rng = random.Random(26)
    urls = ["http://a.org/" + "x" * 100_000, "http://b.net/" + "y/" * 30_000, "http://c.com/de/" + "z" * 20_000, "http://d.net/é🎉"] + [f"http://{rng.choice('abc')}.com/{rng.choice(['fr', 'de'])}/{i}" for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(urls + urls[1:2])), "page_id bigint, url string").collect()
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows)).collect()}
    assert len(got) == len(urls) + 1 and got[0].verdict == "allow" and got[2].verdict == "block"
    assert got[1].score == got[len(urls)].score and got[1].verdict in ("allow", "block")


def test_calibration_against_brute_force(spark):
    rng = random.Random(14)
    for n in (0, 1, 2, 9, 400):
        rows = [(rng.randrange(-9, 60) / 10, rng.random() < 0.5) for _ in range(n)]
        rows += [(s + 2, True) for s, _ in rows[: n // 2]]
        got = url_filter.calibrated(spark.createDataFrame(rows, "score double, accepted boolean"), Scratch(spark, "t"))
        assert got == pytest.approx(url_filter.calibrate(rows), abs=1e-9)


def test_words():
    assert words_of(None) == [] and words_of("A-b_1 É") == ["a", "b_1", "é"]


# --- 3 HTML, whole pages

WRITTEN_BY_HAND = [
    (
        """<!doctype html><html><head><title>Tides | The Daily</title></head><body><header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav></header>
        <div id="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><main><article><h1>How tides &amp; moons work</h1><p>The moon pulls the sea towards it, and the sea answers twice a day, in every harbour.</p>
        <p>Let <math><mi>g</mi></math> be the pull, which <object>falls off</object> with the square of the distance between both bodies.</p></article></main>
        <section class="comments"><h2>Comments</h2><p>Great read, thanks!</p></section><footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>""",
        ["How tides & moons work", "The moon pulls the sea towards it, and the sea answers twice a day, in every harbour.", "Let g be the pull, which falls off with the square of the distance between both bodies."],
    ),
    (
        """<body><nav><a href="/">Home</a> <a href="/x">Posts</a></nav><article class="post"><h1>Bread at home</h1><p>Mix the flour, the water and the salt, and wait until the dough has doubled in size.</p><div class="ad">Sponsored: buy our ovens now!</div>
        <p>Bake it for forty minutes, turn it once, and let it cool on a rack before you cut it.</p><form><label>Your email</label><input name="e"><button>Subscribe</button></form></article><aside><ul><li><a href="/r">Related: cakes</a></li></ul></aside></body>""",
        ["Bread at home", "Mix the flour, the water and the salt, and wait until the dough has doubled in size.", "Bake it for forty minutes, turn it once, and let it cool on a rack before you cut it."],
    ),
]


def plain_article(page):
    """The blocks inside <article>, by patterns that suit the generated tables only."""
    import html

    inner = "".join(re.findall(r"(?s)<article[^>]*>(.*?)</article>", page or ""))
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td|section|figure)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_main_text_of_whole_pages(spark):
    pages = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(WRITTEN_BY_HAND)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(len(got))] == ["\n".join(main) for _, main in WRITTEN_BY_HAND]
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert texts == {r.page_id: plain_article(r.html) for r in table.collect()}


def test_long_and_broken_pages_take_linear_time():
    import time

    began = time.time()
    long = ["<a " * 350_000, "<div>" * 200_000, "<a \">\" " * 150_000 + ">", "<p><table><td>" + "<div>" * 200_000, "<script></script " * 60_000, "<!" * 500_000, "<ul><li>x" * 50_000, "&#" + "9" * 100_000 + ";"]
    blocks = [html_extract.blocks_of(page) for page in long]
    assert [len(b) for b in blocks] == [1, 0, 0, 0, 1, 1, 50_000, 1] and blocks[-1][0].text == "�"
    chain = html_extract.Chain()
    some = html_extract.best_labels(chain, [html_extract.emissions(chain, blocks[6])] + [np.zeros((3, 2))] * 255)
    assert [len(y) for y in some] == [50_000] + [3] * 255
    assert time.time() - began < 60


def test_grouped_decoding_equals_decoding_one_by_one():
    rng = np.random.default_rng(17)
    chain = html_extract.Chain(rng.normal(size=(len(html_extract.FEATURE), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [rng.normal(size=(int(n), 2)) for n in rng.integers(0, 40, 60)]
    alone = [html_extract.best_labels(chain, [e])[0] for e in pages]
    for cells in (1, 50, 400, 65_536):
        assert all((a == b).all() for a, b in zip(alone, html_extract.best_labels(chain, pages, cells), strict=True))


def test_tag_ends_against_a_plain_scan():
    rng = random.Random(18)
    for _ in range(500):
        page = "".join(rng.choices("ab \"'>", k=rng.randint(0, 25)))
        places, ends = html_extract.tag_ends(page)
        for k, at in enumerate(places):
            quote, end = "", -1
            for i in range(at, len(page)):
                if quote:
                    quote = "" if page[i] == quote else quote
                elif page[i] == ">":
                    end = i
                    break
                elif page[i] in "\"'":
                    quote = page[i]
            assert ends[k] == end
