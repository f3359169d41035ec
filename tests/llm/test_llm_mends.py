"""Bounds of caches, column names that clash, ids that are null, long templates, how many pairs the bounds leave."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, html_extract, licenses, minhash, sentencepiece_codec, topk, toxicity
from palimpsest.llm.common import WordHashes
from palimpsest.llm.queries import piece_model

DOCS = "doc_id bigint, text string"


def test_most_pairs_go_before_their_last_stage():
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(size=(3000, 64)) * rng.uniform(4, 9, 64)).astype(np.int64)
    ids, passed = np.arange(3000), []
    got = topk.search(vectors[:150], ids[:150], vectors, ids, 20, passed=passed)
    scores = vectors[:150] @ vectors.T
    for k in range(150):
        order = [j for j in np.lexsort((ids, -scores[k])) if j != k][:20]
        assert got[2][got[0] == k].tolist() == order and got[1][got[0] == k].tolist() == scores[k, order].tolist()
    assert passed[0] == 150 * 3000 and passed[1] <= passed[0] and all(a >= b for a, b in zip(passed[1:], passed[2:]))
    assert passed[-1] < 0.3 * passed[0]


@pytest.mark.parametrize("gathered", [0.0, 1.0])
def test_sums_of_blocks_and_of_pairs_give_the_same(monkeypatch, gathered):
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(size=(800, 24)) * np.geomspace(40, 1, 24)).astype(np.int64)
    ids, passed = np.arange(800), []
    want = topk.search(vectors[:50], ids[:50], vectors, ids, 5, block=128)
    monkeypatch.setattr(topk, "GATHERED", gathered)
    got = topk.search(vectors[:50], ids[:50], vectors, ids, 5, block=128, passed=passed)
    assert all((a == b).all() for a, b in zip(got, want)) and passed[-1] < passed[1] < passed[0]


def test_a_licence_of_thousands_of_words_is_a_template(spark):
    words = [f"w{k}" for k in range(6000)]
    long = licenses.Template("X", "text", " ".join(words))
    near = words[:200] + ["other"] + words[700:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:2000])), (4, "All rights reserved.")], DOCS)
    got = {(r.doc_id, r.license_id, r.template): r.dice for r in licenses.scan(docs, [*licenses.TEMPLATES, long]).collect()}
    a, b = ({*zip(w, w[1:])} for w in (words, near))
    assert got == {(1, "X", "text"): 1.0, (2, "X", "text"): round(2 * len(a & b) / (len(a) + len(b)), 6), (4, "proprietary", "reserved"): 1.0}


def test_caches_keep_no_long_words():
    hashes, features = WordHashes(most=10), toxicity.WordFeatures({}, most=10)
    for k in range(200):
        for word in (f"{k}" * 20_000, f"{k}"):
            assert hashes[word] == WordHashes()[word] and features[word] == ()
    assert all(len(w) <= 100 for cache in (hashes, features) for w in cache) and len(hashes) <= 10
    html_extract._own_kept.cache_clear()
    long = ' class="nav" style="' + "x" * 100_000 + '"'
    assert html_extract._own("div", long) == html_extract._own("div", ' class="nav"') and html_extract._own_kept.cache_info().currsize == 1


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "a", 1, 2, 3), (2, text, "b", 4, 5, 6), (3, "something else", "c", 7, 8, 9)]
    docs = spark.createDataFrame(rows, f"{DOCS}, __gone string, __row int, __ROW_ int, __class int")
    assert sorted(map(tuple, minhash.keep_one(docs).collect())) == [rows[0], rows[2]]
    twice = docs.unionByName(docs)
    got = minhash.keep_one(twice)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    bench = spark.createDataFrame([(7, " ".join(f"word{k}" for k in range(10, 30)))], "item_id bigint, text string")
    for most in (4_000_000, 0):
        clean = decontaminate.clean_documents(docs, bench, most_seeds=most)
        assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [rows[2]]


def test_null_ids(spark):
    pages = spark.createDataFrame([(None, "u", "<article><p>Some words of an article, that go on for a while.</p></article>"), (None, None, None)], "page_id bigint, url string, html string")
    assert sorted(str(r.page_id) + str(r.n_chars > 0) for r in html_extract.extract(pages).collect()) == ["NoneFalse", "NoneTrue"]
    docs = spark.createDataFrame([(None, "some text"), (None, None), (None, "some text")], DOCS)
    encoded = sentencepiece_codec.encode_documents(docs, piece_model()).collect()
    assert [r.doc_id for r in encoded] == [None] * 3 and sorted(r.n_tokens > 0 for r in encoded) == [False, True, True]
    model = toxicity.ToxicityModel(-1.0, {}, 0.1)
    scored = toxicity.score(docs, model).collect()
    assert [(r.doc_id, r.held_out, r.predicted) for r in scored] == [(None, False, 0)] * 3
    assert all(r.score == pytest.approx(1 / (1 + math.e)) for r in scored)


def test_scores_are_the_logistic_of_summed_weights(spark):
    """A plain version of a score, and a fit that sees all features of the unlabelled texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    assert len(model.weights) > 10
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        own = set(toxicity.text_features(r.text).tolist())
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-model.bias - sum(w for f, w in model.weights.items() if f in own))), abs=1e-12)
    hidden = toxicity.held_out("doc_id")
    good = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~hidden)
    share = good.agg(F.avg("toxic")).first()[0]
    toxic = {r.doc_id for r in good.where("toxic = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.where(~hidden).orderBy("doc_id").collect()}
    assert len(toxic) < 3000 and len(texts) < 9000
    whole = toxicity.fit_nnpu([toxicity.text_features(texts[i]) for i in texts if i in toxic], [toxicity.text_features(t) for t in texts.values()], share)
    assert whole.weights.keys() == model.weights.keys() and json.dumps(sorted(whole.weights)) == json.dumps(sorted(model.weights))
    assert all(whole.weights[f] == pytest.approx(w, abs=1e-6) for f, w in model.weights.items())
