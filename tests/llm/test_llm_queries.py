import duckdb
import pytest

import corpus_pipeline
from palimpsest.llm import decontaminate, minhash, queries, toxicity

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, (tuple(r) for r in rel.fetchall())))


def test_contracts(spark):
    found = queries.queries()
    columns = {
        "op2_exact_top_k": "query_id bigint rank int vec_id bigint score bigint", "op3_html_extraction": "page_id bigint url string text string n_chars bigint", "op5_toxicity": "doc_id bigint held_out boolean score double predicted int",
        "op8_sentencepiece": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string", "op9_warc": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
        "op10_url_filter": "page_id bigint host string path string rule string verdict string", "op11_line_dedup": "doc_id bigint n_lines bigint n_dropped bigint kept_sha256 string",
        "op12_fill_in_middle": "doc_id bigint n bigint form string prefix_chars bigint middle_chars bigint output_sha256 string restored_sha256 string",
        "op13_conversation_repair": "conv_id bigint gaps bigint blank bigint duplicate bigint truncated bigint illegal bigint cost bigint audit string repaired_sha256 string",
    }
    assert len(found) == 13
    for name, wanted in columns.items():
        have = dict(found[name](spark, SF).dtypes)
        w = wanted.split()
        assert all(have[c] == kind for c, kind in zip(w[::2], w[1::2], strict=True)), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet")
    labels, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    rest = docs.where(~docs.doc_id.isin(*bad))
    one = {r.class_id for r in minhash.near_duplicates(rest).collect()}
    rest = rest.where(rest.doc_id.isin(*one))
    leaks = {r.doc_id for r in decontaminate.contaminated(rest, bench).collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    assert got == one - leaks and bad and leaks and len(one) < rest.count() + len(bad)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert all(f(spark, docs.limit(0), "/root/testdata/sf0.01").columns == docs.columns for _, f in corpus_pipeline.STAGES[:3])
