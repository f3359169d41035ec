"""The library's operators applied to the driver's tables, and the same in SQL.

Each query is a function of (spark, sf_dir); SQL[name] is its statement for DuckDB over views named like the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import confidence, geometry, metrics, text
from palimpsest.operators import api_log, language_model, layout, lines, numbering, pairing, quality, sequences, splits, training_log, vocabulary
from palimpsest.plans import jobs
from palimpsest.session import new_folder, written
from palimpsest.sources import layout_xml, sinks
from palimpsest.sources import lines as xml_lines
from palimpsest.streaming import answers, ingest, totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The oracle's edit distance counts bytes, so a pair's characters are mapped to ASCII first.
def _lev(a: str, b: str) -> str:
    known = f"list_distinct(string_split({a} || {b}, ''))"
    ascii_of = lambda s: f"array_to_string([chr(CAST(33 + list_position({known}, c) AS INTEGER)) FOR c IN string_split({s}, '') IF c <> ''], '')"
    return f"CAST(levenshtein({ascii_of(a)}, {ascii_of(b)}) AS BIGINT)"


_SPLIT_LINES = "SELECT {keep}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM {table}"
_LINES = "SELECT * FROM (" + _SPLIT_LINES + ") WHERE trim(line) <> ''"
_HYP = "translate({}, 'aeiou', 'eioua')"


def _document_lines(spark: SparkSession, sf_dir: str, *keep: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    docs = table(spark, sf_dir, name)
    return docs.select(id_col, *keep, F.posexplode(F.split("text", "\n")).alias("line_idx", "line")).where(text.has_text(F.col("line")))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a small file gives fewer tasks than there are cores, ahead of work that costs far more
    than the rows' way; larger inputs, which have more tasks, stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@query()
def cer_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of whole lines against a hypothesis with shifted vowels, by language: mean of lines, and micro.
    The oracle takes more than ten minutes for the distances of whole lines, so there is no SQL."""
    r = F.col("line")
    pairs = _spread(_document_lines(spark, sf_dir, "lang")).select("lang", r.alias("reference"), F.translate(r, "aeiou", "eioua").alias("hypothesis"))
    counted = pairs.select("lang", metrics.edit_distance(F.col("reference"), F.col("hypothesis")).alias("d"), F.length("reference").alias("n"))
    rated = counted.withColumn("cer", metrics.rate(F.col("d"), F.col("n")))
    return rated.groupBy("lang").agg(F.count("*").alias("lines"), F.round(F.avg("cer"), 6).alias("cer"), F.sum("d").alias("edits"), F.round(F.sum("d") / F.sum("n"), 6).alias("micro_cer"))


@query()
def wer_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of whole lines, by source. The oracle's distance is of bytes, of which there are too few for the
    words of long lines, so there is no SQL."""
    r = F.col("line")
    pairs = _spread(_document_lines(spark, sf_dir, "source")).select("source", r.alias("r"), F.translate(r, "aeiou", "eioua").alias("h"))
    counted = pairs.select("source", metrics.word_distance(F.col("r"), F.col("h")).alias("d"), F.size(text.words(F.col("r"))).alias("n"))
    rated = counted.withColumn("wer", metrics.rate(F.col("d"), F.col("n")))
    return rated.groupBy("source").agg(F.count("*").alias("lines"), F.round(F.avg("wer"), 6).alias("wer"), F.sum("d").alias("edits"))


@query(f"""
WITH p AS (SELECT item_id, text AS r, {_HYP.format("text")} AS h FROM benchmark),
m AS (SELECT item_id, round((greatest(len(r), len(h)) - {_lev("r", "h")}) / greatest(len(r), len(h)) * 100.0, 6) AS match_percent FROM p)
SELECT CAST(row_number() OVER (ORDER BY match_percent DESC, item_id) AS INTEGER) AS rank, item_id, match_percent FROM m ORDER BY match_percent DESC, item_id LIMIT 20
""")
def match_percent_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty items that match their hypothesis best."""
    r = F.col("text")
    m = table(spark, sf_dir, "benchmark").select("item_id", F.round(metrics.match_percent(r, F.translate(r, "aeiou", "eioua")), 6).alias("match_percent"))
    top = m.orderBy(F.desc("match_percent"), "item_id").limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("match_percent"), "item_id")).alias("rank"), "item_id", "match_percent")


@query(f"SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, md5(line) AS line_md5, len(line) AS chars FROM ({_LINES.format(keep='doc_id', table='documents')})")
def line_number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text and their numbers."""
    found = lines.text_lines(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "line_idx", F.md5("text").alias("line_md5"), F.length("text").cast("bigint").alias("chars"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) AS turns FROM conversations GROUP BY conv_id")
def page_text_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page's lines in order."""
    turns = table(spark, sf_dir, "conversations")
    pages = lines.page_text(turns, "conv_id", "turn")
    return pages.join(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), "conv_id").select("conv_id", F.md5("text").alias("text_md5"), "turns")


_CHARS = "SELECT {keep}, unnest(string_split(text, '')) AS ch FROM {table}"


@query(f"""
WITH c AS (SELECT DISTINCT ch FROM ({_CHARS.format(keep="doc_id", table="documents")}) WHERE ch NOT IN ('', ' '))
SELECT 0 AS rank, '<SPACE>' AS symbol UNION ALL SELECT CAST(row_number() OVER (ORDER BY ch) AS INTEGER), ch FROM c
""")
def charset_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by code point, the space token first."""
    return vocabulary.sorted_charset(table(spark, sf_dir, "documents"))


@query(f"SELECT lang, ch, count(*) AS n FROM ({_CHARS.format(keep='lang', table='documents')}) WHERE ch <> '' GROUP BY lang, ch")
def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.char_counts(table(spark, sf_dir, "documents"), "text", "lang")


@query("""
WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM benchmark),
g AS (SELECT ch, count(*) AS n, min(item_id * 1000000 + pos) AS first FROM c WHERE ch <> '' GROUP BY ch)
SELECT CAST(row_number() OVER (ORDER BY n DESC, first) - 1 AS INTEGER) AS rank, CASE WHEN ch = ' ' THEN '<SPACE>' ELSE ch END AS symbol, n FROM g
""")
def vocab_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by frequency, ties by first occurrence."""
    return vocabulary.frequency_vocabulary(table(spark, sf_dir, "benchmark"), "item_id")


@query(f"""
WITH v AS (SELECT DISTINCT ch, true AS known FROM ({_CHARS.format(keep="item_id", table="benchmark")})),
c AS (SELECT lang, ch, count(*) AS n FROM ({_CHARS.format(keep="lang", table="documents")}) WHERE ch <> '' GROUP BY lang, ch)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN known IS NULL AND ch <> ' ' THEN n ELSE 0 END) AS BIGINT) AS unknown,
       round(sum(CASE WHEN known IS NULL AND ch <> ' ' THEN n ELSE 0 END) / sum(n), 6) AS rate
FROM c LEFT JOIN v USING (ch) GROUP BY lang
""")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents that the benchmark's vocabulary lacks."""
    vocab = vocabulary.char_counts(table(spark, sf_dir, "benchmark")).select(F.col("ch").alias("symbol"))
    return vocabulary.unknown_rate(table(spark, sf_dir, "documents"), vocab, "lang").withColumn("rate", F.round("rate", 6))


@query("""
SELECT item_id, md5(array_to_string([CASE WHEN c BETWEEN 'a' AND 'z' THEN CAST(ascii(c) - 96 AS VARCHAR) WHEN c = ' ' THEN '27' ELSE '0' END FOR c IN string_split(text, '') IF c <> ''], ',')) AS indices_md5,
       len(text) AS n FROM benchmark
""")
def char_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as vocabulary indices, unknown characters 0."""
    known = F.map_from_arrays(F.array(*[F.lit(chr(97 + i)) for i in range(26)], F.lit("<space>")), F.array(*[F.lit(i + 1) for i in range(27)]))
    indices = vocabulary.char_indices(F.col("text"), known)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(F.transform(indices, lambda i: i.cast("string")), ",")).alias("indices_md5"), F.size(indices).cast("bigint").alias("n"))


@query(f"""
SELECT item_id, CAST(line_idx AS INTEGER) AS line_idx, array_to_string([CASE WHEN c = ' ' THEN '<SPACE>' ELSE c END FOR c IN string_split(trim(line), '') IF c <> ''], ' ') AS tokens
FROM ({_LINES.format(keep="item_id", table="benchmark")})
""")
def char_lm_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as character tokens for a language model."""
    return vocabulary.lm_corpus(lines.text_lines(table(spark, sf_dir, "benchmark"), "item_id"), "text", "item_id", "line_idx")


@query(f"""
WITH l AS ({_LINES.format(keep="item_id", table="benchmark")}), n AS (SELECT unnest([1, 2, 3, 4, 5]) AS n)
SELECT n, gram, count(*) AS count FROM (SELECT n, unnest([substr(line, i, n) FOR i IN range(1, len(line) - n + 2)]) AS gram FROM l, n WHERE len(line) >= n) GROUP BY n, gram
""")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of character n-grams up to five."""
    return vocabulary.ngram_counts(lines.text_lines(table(spark, sf_dir, "benchmark"), "item_id"))


def _char_lm_sql(order: int, source: str) -> str:
    """WITH parts that end in a view m (n, gram, count, p, share) of a character model over lines of a table."""
    size = "length(gram)"
    levels = [f"a{order} AS (SELECT gram, count FROM raw WHERE {size} = {order})"]
    for n in range(order - 1, 0, -1):
        levels.append(f"a{n} AS (SELECT substr(gram, 2) AS gram, count(*) AS count FROM a{n + 1} GROUP BY 1 UNION ALL SELECT gram, count FROM raw WHERE {size} = {n})")
    rated = ["p1 AS (SELECT gram, count, (count - d[least(count, 3)]) / (SELECT total FROM u) + (SELECT even FROM u) AS p, CAST(NULL AS VARCHAR) AS context, CAST(NULL AS DOUBLE) AS share FROM a1, (SELECT d FROM cuts WHERE n = 1) UNION ALL SELECT chr(1), NULL, even, NULL, NULL FROM u)"]
    for n in range(2, order + 1):
        sums = f"SELECT left(gram, {n - 1}) AS context, sum(count) AS total, (count(*) FILTER (count = 1) * any_value(d[1]) + count(*) FILTER (count = 2) * any_value(d[2]) + count(*) FILTER (count > 2) * any_value(d[3])) / sum(count) AS share FROM a{n}, (SELECT d FROM cuts WHERE n = {n}) GROUP BY 1"
        rated.append(f"s{n} AS ({sums}), p{n} AS (SELECT a{n}.gram, a{n}.count, (a{n}.count - d[least(a{n}.count, 3)]) / s{n}.total + s{n}.share * p{n - 1}.p AS p, s{n}.context, s{n}.share FROM a{n} JOIN s{n} ON left(a{n}.gram, {n - 1}) = s{n}.context JOIN p{n - 1} ON substr(a{n}.gram, 2) = p{n - 1}.gram, (SELECT d FROM cuts WHERE n = {n}))")
    model = " UNION ALL ".join(f"SELECT {n} AS n, p{n}.gram, p, s.share FROM p{n} LEFT JOIN s{n + 1} s ON s.context = p{n}.gram" if n < order else f"SELECT {n}, gram, p, NULL FROM p{n}" for n in range(1, order + 1))
    fallback = ", ".join(map(str, language_model.FALLBACK))
    return f"""
l AS (SELECT chr(2) || trim(line) || chr(3) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {source}) WHERE trim(line) <> ''),
raw AS (SELECT gram, count(*) AS count FROM (
    SELECT unnest([substr(line, i, {order}) FOR i IN range(1, length(line) - {order} + 2)]) AS gram FROM l
    UNION ALL SELECT unnest([left(line, k) FOR k IN range(2, least({order - 1}, length(line)) + 1)]) FROM l) GROUP BY gram),
{", ".join(levels)},
t AS (SELECT n, count(*) FILTER (count = 1) AS t1, count(*) FILTER (count = 2) AS t2, count(*) FILTER (count = 3) AS t3, count(*) FILTER (count = 4) AS t4
      FROM ({" UNION ALL ".join(f"SELECT {n} AS n, count FROM a{n}" for n in range(1, order + 1))}) GROUP BY n),
y AS (SELECT n, CASE WHEN t1 > 0 AND t2 > 0 AND t3 > 0 THEN [1 - 2 * (t1 / (t1 + 2 * t2)) * t2 / t1, 2 - 3 * (t1 / (t1 + 2 * t2)) * t3 / t2, 3 - 4 * (t1 / (t1 + 2 * t2)) * t4 / t3] END AS d FROM t),
cuts AS (SELECT n, CASE WHEN d[1] BETWEEN 0 AND 1 AND d[2] BETWEEN 0 AND 2 AND d[3] BETWEEN 0 AND 3 THEN d ELSE [{fallback}] END AS d FROM y),
u AS (SELECT sum(count) AS total, (count(*) FILTER (count = 1) * any_value(d[1]) + count(*) FILTER (count = 2) * any_value(d[2]) + count(*) FILTER (count > 2) * any_value(d[3])) / sum(count) / (count(*) + 1) AS even FROM a1, (SELECT d FROM cuts WHERE n = 1)),
{", ".join(rated)},
m AS ({model} UNION ALL SELECT 1, chr(2), 1e-99, share FROM s2 WHERE context = chr(2))"""


@query(f"WITH {_char_lm_sql(5, 'documents')} SELECT n, gram, CAST(count AS BIGINT) AS count FROM ({' UNION ALL '.join(f'SELECT {n} AS n, gram, count FROM a{n}' for n in range(1, 6))})")
def char_lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted counts of a character model of order five over all lines of documents."""
    return language_model.adjusted_counts(lines.text_lines(table(spark, sf_dir, "documents"), "doc_id"), 5)


@query(f"WITH {_char_lm_sql(4, 'documents')} SELECT n, gram, round(log10(p), 6) AS logp, round(log10(share), 6) AS backoff FROM m")
def char_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character model of order four over all lines of documents."""
    found = language_model.adjusted_counts(lines.text_lines(table(spark, sf_dir, "documents"), "doc_id"), 4)
    return language_model.kneser_ney(found, 4).select("n", "gram", F.round("logp", 6).alias("logp"), F.round("backoff", 6).alias("backoff"))


@query(f"""
WITH {_char_lm_sql(3, "benchmark")},
g AS (SELECT lang, gram, count(*) AS c FROM (SELECT lang, unnest([line[greatest(1, i - 2):i] FOR i IN range(2, length(line) + 1)]) AS gram FROM (
    SELECT lang, chr(2) || trim(line) || chr(3) AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')) GROUP BY 1, 2),
r AS (SELECT g.lang, g.c, m1.p IS NULL AS unknown, CASE WHEN length(g.gram) = 3 AND m3.p IS NOT NULL THEN log10(m3.p)
        ELSE CASE WHEN length(g.gram) = 3 THEN coalesce(log10(b2.share), 0) ELSE 0 END + CASE WHEN m2.p IS NOT NULL THEN log10(m2.p)
        ELSE coalesce(log10(b1.share), 0) + coalesce(log10(m1.p), (SELECT log10(p) FROM m WHERE n = 1 AND gram = chr(1))) END END AS logp
    FROM g LEFT JOIN m m3 ON m3.gram = g.gram AND m3.n = 3 LEFT JOIN m b2 ON b2.gram = left(g.gram, 2) AND b2.n = 2 AND length(g.gram) = 3
    LEFT JOIN m m2 ON m2.gram = right(g.gram, 2) AND m2.n = 2 LEFT JOIN m b1 ON b1.gram = left(right(g.gram, 2), 1) AND b1.n = 1 LEFT JOIN m m1 ON m1.gram = right(g.gram, 1) AND m1.n = 1)
SELECT lang, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(CASE WHEN unknown THEN c ELSE 0 END) AS BIGINT) AS unknown, round(sum(c * logp), 4) AS logp, round(pow(10, -sum(c * logp) / sum(c)), 6) AS perplexity FROM r GROUP BY lang
""")
def char_lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a character model of the benchmark's lines foretells the documents' lines, by language."""
    model = written(language_model.kneser_ney(language_model.adjusted_counts(lines.text_lines(table(spark, sf_dir, "benchmark"), "item_id"), 3), 3), "model")
    found = language_model.perplexity(_document_lines(spark, sf_dir, "lang"), model, "lang", order=3, text_col="line")
    return found.withColumns({"logp": F.round("logp", 4), "perplexity": F.round("perplexity", 6)})


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS number FROM lineitem")
def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all orders, numbered without gaps."""
    return numbering.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")

@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split FROM documents
""")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly floor(0.8 n) rows by hash order."""
    return splits.train_val_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT source, CASE WHEN CAST('0x' || left(md5(source), 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM documents GROUP BY source")
def split_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources on one side."""
    return splits.split_by_group(table(spark, sf_dir, "documents").select("source"), "source").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT source, n_chars, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split FROM documents)
SELECT count(*) FILTER (split = 'train') AS num_train, count(*) FILTER (split = 'val') AS num_val, count(*) AS total_lines, round(avg(n_chars), 6) AS avg_line_width,
       round(avg(n_chars % 100), 6) AS avg_line_height, count(DISTINCT source) AS pages_processed, 128 AS target_height FROM s
""")
def dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a split data set."""
    rows = splits.train_val_split(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    info = splits.dataset_info(rows, "source", F.col("n_chars"), F.col("n_chars") % 100, target_height=128)
    return info.withColumns({c: F.round(c, 6) for c in ("avg_line_width", "avg_line_height")})


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without an output."""
    return pairing.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY source")
def labelled_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs with an output, by source."""
    return pairing.finished(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, TRY_CAST(regexp_extract(url, '/[a-z][a-z]/([0-9]+)', 1) AS BIGINT) AS number FROM pages),
m AS (SELECT page_id, doc_id, CASE WHEN p.lang = d.lang THEN 0 ELSE 1 END AS priority FROM p JOIN documents d ON d.doc_id = p.number),
b AS (SELECT page_id, min(priority) AS priority, arg_min(doc_id, (priority, doc_id)) AS doc_id FROM m GROUP BY page_id)
SELECT page_id, doc_id, CAST(priority AS INTEGER) AS priority FROM p LEFT JOIN b USING (page_id)
""")
def priority_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the document of their number, of their language if there is one, else of any."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"), F.regexp_extract("url", "/[a-z][a-z]/([0-9]+)", 1).try_cast("bigint").alias("number"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dlang"))
    same = ([F.col("number"), F.col("lang")], [F.col("doc_id"), F.col("dlang")])
    return pairing.first_match(pages, docs, "page_id", [same, ([F.col("number")], [F.col("doc_id")])], "doc_id").select("page_id", "doc_id", "priority")


_PART_FILES = """
x AS (SELECT 'd' || p_partkey % 5 AS dir, 's' || p_partkey AS stem, 'n' || (p_partkey + 1) AS named FROM part),
i AS (SELECT 'd' || p_partkey % 5 || '/page' AS dir, 'n' || (p_partkey + 1) AS stem, 'jpg' AS ext FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT 'd' || p_partkey % 5 || '/page', 's' || p_partkey, 'png' FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT 'd' || p_partkey % 5, 's' || p_partkey, 'tif' FROM part WHERE p_partkey % 5 < 2)
"""


def _part_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Layout files (path, image_name, error) of parts, and images in the same folder, under either name, or one above."""
    p = F.col("p_partkey")
    text_of = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    folder, own, named = text_of("d", (p % 5).cast("string")), text_of("s", p.cast("string")), text_of("n", (p + 1).cast("string"))
    part = table(spark, sf_dir, "part")
    pages = part.select(text_of(folder, "/page/", own, ".xml").alias("path"), text_of(named, ".tif").alias("image_name"), F.lit(None).cast("string").alias("error"))
    images = [F.when(p % 2 == 0, text_of(folder, "/page/", named, ".jpg")), F.when(p % 3 == 0, text_of(folder, "/page/", own, ".png")), F.when(p % 5 < 2, text_of(folder, "/", own, ".tif"))]
    return pages, part.select(F.explode(F.array_compact(F.array(*images))).alias("path"))


@query(f"""
WITH {_PART_FILES}, m AS (
    SELECT x.dir || '/page/' || x.stem || '.xml' AS xml_path, i.dir || '/' || i.stem || '.' || i.ext AS image_path, k.priority FROM x, (VALUES (0), (1), (2)) k(priority)
    JOIN i ON i.dir = CASE WHEN k.priority < 2 THEN x.dir || '/page' ELSE x.dir END AND i.stem = CASE WHEN k.priority = 0 THEN x.named ELSE x.stem END)
SELECT xml_path, arg_min(image_path, priority) AS image_path, CAST(min(priority) AS INTEGER) AS priority FROM m GROUP BY xml_path
""")
def alto_image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout files with the image that they name, else that of their own stem, else that one folder above."""
    return pairing.alto_with_images(*_part_files(spark, sf_dir))


@query(f"""
WITH {_PART_FILES} SELECT x.dir || '/page/' || x.stem || '.xml' AS xml_path, i.dir || '/' || i.stem || '.' || i.ext AS image_path, CASE WHEN i.stem IS NULL THEN 'no image ' || x.named || '.jpg' END AS error
FROM x LEFT JOIN i ON i.stem = x.named AND i.ext = 'jpg'
""")
def named_image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout files with the image of the name that they give, wherever it is, and what is missing."""
    pages, images = _part_files(spark, sf_dir)
    return pairing.xml_with_named_images(pages.withColumn("image_name", F.regexp_replace("image_name", "tif$", "jpg")), images)


@query("""
SELECT u.conv_id, u.turn, len(u.text) AS reference_chars, len(a.text) AS hypothesis_chars FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def ordinal_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's turn after them, paired by number."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("bigint").alias("reference_chars"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("bigint").alias("hypothesis_chars"))
    return pairing.by_ordinal(asked, said, "conv_id", "turn")


_CONF = "CASE WHEN value BETWEEN 0 AND 1 THEN value WHEN value > 1 THEN value / 100 END"


@query(f"""
SELECT event_type, count(*) AS n, round(avg(c), 6) AS avg, min(c) AS min, max(c) AS max, count(*) FILTER (c < 0.8) AS low
FROM (SELECT event_type, {_CONF} AS c FROM events) WHERE c IS NOT NULL GROUP BY event_type
""")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confidence_statistics(table(spark, sf_dir, "events"), "event_type", confidence_col="value").withColumn("avg", F.round("avg", 6))


@query(f"""
SELECT CASE WHEN c >= 0.95 THEN 'very high' WHEN c >= 0.85 THEN 'high' WHEN c >= 0.75 THEN 'medium' ELSE 'low' END AS class, count(*) AS n
FROM (SELECT {_CONF} AS c FROM events) WHERE c IS NOT NULL GROUP BY class
""")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(confidence.normalised(F.col("value")).alias("c")).where("c is not null")
    return c.groupBy(confidence.confidence_class(F.col("c")).alias("class")).agg(F.count("*").alias("n"))


_SUMMARY_SQL = f"SELECT user_id, count(*) AS line_count, CAST(sum(len(event_type)) AS BIGINT) AS char_count, round(avg({_CONF}), 6) AS avg_confidence FROM events GROUP BY user_id"


@query(_SUMMARY_SQL)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, characters and mean confidence by page."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("text"), confidence.normalised(F.col("value")).alias("confidence"))
    return quality.page_summary(rows, "user_id").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"""
WITH p AS (SELECT user_id, count(*) AS l, sum(len(event_type)) AS c, avg({_CONF}) AS a FROM events GROUP BY user_id)
SELECT count(*) AS pages, CAST(sum(l) AS BIGINT) AS lines, CAST(sum(c) AS BIGINT) AS chars, round(avg(a), 6) AS avg_confidence, round(count(*) / 3723.0, 6) AS images_per_second,
       round(3723.0 / count(*), 6) AS seconds_per_image, round(sum(l) / 3723.0, 6) AS lines_per_second, '1h 2m 3s' AS duration FROM p
""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and speeds of a run of 3723 seconds."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("text"), confidence.normalised(F.col("value")).alias("confidence"))
    out = quality.batch_statistics(quality.page_summary(rows, "user_id"), 3723)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "images_per_second", "seconds_per_image", "lines_per_second")})


_ERRORS_SQL = """
SELECT CASE WHEN contains(m, ':') THEN split_part(m, ':', 1) ELSE left(m, 50) END AS error_type, count(*) AS n
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ': ' || user_id END AS m FROM events) GROUP BY error_type
"""


@query(_ERRORS_SQL)
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(": "), F.col("user_id").cast("string")))
    return quality.error_breakdown(table(spark, sf_dir, "events").select(message.alias("error")))


def _in_parts(spark: SparkSession, rows: DataFrame, order: str, parts: int = 4) -> str:
    """A folder to which rows came in some parts, by ranges of a number, each behind the one before."""
    folder = new_folder(spark, "arriving")
    spark.createDataFrame([], rows.schema).write.parquet(folder)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - F.lit(low)) * parts / (F.lit(high) - F.lit(low) + 1)) if low is not None else F.lit(0)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
    return folder


def _running(spark: SparkSession, rows: DataFrame, total: totals.Total) -> DataFrame:
    """A total of rows that arrive in four parts, a file a batch, folded on the way."""
    out, checkpoint = new_folder(spark, "totals"), new_folder(spark, "checkpoint")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(_in_parts(spark, rows, "event_id"))
    totals.keep_totals(stream, [total], out, checkpoint).awaitTermination()
    totals.fold(spark, total, out)
    return totals.read_total(spark, total, out)


# Twelve places, as means of six can lie on the edge between two, where the order of a sum decides.
@query(_SUMMARY_SQL.replace(", 6)", ", 12)"))
def running_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, characters and mean confidence by page, kept up to date while lines arrive."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("text"), confidence.normalised(F.col("value")).alias("confidence"))
    return _running(spark, rows, totals.page_totals("user_id")).withColumn("avg_confidence", F.round("avg_confidence", 12))


@query(_ERRORS_SQL)
def running_error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by type, kept up to date while they arrive."""
    message = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(": "), F.col("user_id").cast("string")))
    return _running(spark, table(spark, sf_dir, "events").select("event_id", message.alias("error")), totals.error_totals())


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NULL OR event_type <> last
""")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without repeats of the row before."""
    return sequences.keep_first_of_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT user_id, event_id, CAST(event_id * 7 // 3 % 4 AS INTEGER) AS idx FROM events), l AS (SELECT *, lag(idx) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM e)
SELECT user_id, idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos FROM l WHERE idx <> 0 AND (last IS NULL OR idx <> last)
""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy CTC: no blanks, no repeats of the step before."""
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("event_id") * 7 / 3) % 4).cast("int").alias("idx"))
    return sequences.ctc_collapse(steps, "user_id", "event_id").select("user_id", "idx", "pos")


@query("""
WITH g AS (SELECT l_orderkey AS line, l_linenumber AS t, l_partkey % 5 AS cls, -(l_quantity / 100) AS logp FROM lineitem),
k AS (SELECT line, t, arg_max(cls, (logp, -cls)) AS idx, max(logp) AS logp FROM g GROUP BY line, t), l AS (SELECT *, lag(idx) OVER (PARTITION BY line ORDER BY t) AS last FROM k),
m AS (SELECT line, string_agg(chr(CAST(96 + idx AS INTEGER)), '' ORDER BY t) AS text, avg(exp(logp)) AS c FROM l WHERE idx <> 0 AND (last IS NULL OR idx <> last) AND idx < 4 GROUP BY line)
SELECT a.line, coalesce(text, '') AS text, round(coalesce(c, 0), 6) AS confidence FROM (SELECT DISTINCT line FROM k) a LEFT JOIN m USING (line)
""")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy decoding with a vocabulary that lacks class 4, and its confidence."""
    logits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 5).cast("int").alias("cls"), (-(F.col("l_quantity") / 100)).alias("logp"))
    symbols = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx int, symbol string")
    return sequences.ctc_decode(logits, symbols, "line").withColumn("confidence", F.round("confidence", 6))


@query("""
WITH m AS (SELECT user_id, event_type || '-' || user_id % 7 * 3 % 5 || '-' || event_id % 13 AS model, max((ts, event_id)) AS last FROM events GROUP BY 1, 2)
SELECT user_id, model, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, model, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, model) AS rank FROM m) WHERE rank <= 10
""")
def mru_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten models used last."""
    used = table(spark, sf_dir, "events").withColumn("model", F.concat_ws("-", "event_type", (F.col("user_id") % 7 * 3 % 5).cast("string"), (F.col("event_id") % 13).cast("string")))
    return sequences.recent_distinct(used, "user_id", "model", "ts", "event_id")


@query("""
WITH t AS (SELECT l_orderkey AS page, l_linenumber AS y, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS gap FROM lineitem WHERE l_quantity > 20),
r AS (SELECT page, y, sum(CASE WHEN coalesce(gap, 0) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y) AS run FROM t)
SELECT page, min(y) AS first, max(y) AS last FROM r GROUP BY page, run HAVING max(y) - min(y) + 1 >= 2
""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text rows in a profile, interrupted by at least two other rows, at least two rows high."""
    profile = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("y"), (F.col("l_quantity") > 20).alias("is_text"))
    return sequences.runs(profile, "page", "y", "is_text", 2, 2)


@query("""
WITH i AS (SELECT l_orderkey AS page, l_partkey % 300 AS s, l_partkey % 300 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
p AS (SELECT *, sum(CASE WHEN s - reach <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY s, e) AS part FROM m)
SELECT page, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM p GROUP BY page, part
""")
def merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals merged over gaps of up to ten."""
    start = F.col("l_partkey") % 300
    intervals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), start.alias("s"), (start + F.col("l_quantity").cast("bigint")).alias("e"))
    return sequences.merge_close(intervals, "page", "s", "e", 10)


_HISTORY = "SELECT l_suppkey % 40 AS run, month(l_shipdate) + 12 * (year(l_shipdate) - 1990) AS epoch, round(avg(l_discount), 6) AS val_cer, round(avg(l_tax), 6) AS train_cer FROM lineitem GROUP BY 1, 2"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.month("l_shipdate") + 12 * (F.year("l_shipdate") - 1990)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("run"), epoch.alias("epoch")).agg(F.round(F.avg("l_discount"), 6).alias("val_cer"), F.round(F.avg("l_tax"), 6).alias("train_cer"))


@query(f"""
WITH h AS ({_HISTORY}), a AS (SELECT *, row_number() OVER w AS n, min(val_cer) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, past IS NULL OR val_cer < past AS is_best FROM a), c AS (SELECT *, n - max(CASE WHEN is_best THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS since_best FROM b),
d AS (SELECT *, since_best >= 8 AS stopped, coalesce(max(CAST(since_best >= 8 AS INTEGER)) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT run, CAST(epoch AS INTEGER) AS epoch, val_cer, is_best, least(past, val_cer) AS best_so_far, CAST(since_best AS INTEGER) AS since_best, stopped FROM d WHERE before = 0
""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs up to the one that ends each run, with patience 8."""
    return training_log.early_stopping(_history(spark, sf_dir), patience=8).select("run", "epoch", "val_cer", "is_best", "best_so_far", "since_best", "stopped")


@query(f"SELECT run, CAST(epoch AS INTEGER) AS epoch, train_cer < val_cer AS overfits, round(CASE WHEN val_cer <> 0 THEN (val_cer - train_cer) / val_cer * 100 END, 4) AS gap_percent FROM ({_HISTORY})")
def overfit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_log.overfit_flags(_history(spark, sf_dir)).select("run", "epoch", "overfits", F.round("gap_percent", 4).alias("gap_percent"))


@query(f"""
WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM ({_HISTORY})),
f AS (
    SELECT run, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS epoch, CAST('inf' AS DOUBLE) AS best, 0 AS bad, CAST(0.001 AS DOUBLE) AS rate FROM (SELECT DISTINCT run FROM h)
    UNION ALL
    SELECT run, n, epoch, CASE WHEN better THEN v ELSE best END, CASE WHEN better OR bad + 1 > 5 THEN 0 ELSE bad + 1 END, CASE WHEN NOT better AND bad + 1 > 5 THEN rate * 0.5 ELSE rate END
    FROM (SELECT f.run, h.n, h.epoch, h.val_cer AS v, f.best, f.bad, f.rate, h.val_cer < f.best * (1 - CAST(0.0001 AS DOUBLE)) AS better FROM f JOIN h ON f.run = h.run AND h.n = f.n + 1)
)
SELECT run, CAST(epoch AS INTEGER) AS epoch, rate AS learning_rate FROM f WHERE n > 0
""")
def plateau_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rates that plateaus of the loss bring down."""
    return training_log.plateau_rates(_history(spark, sf_dir), metric="val_cer")


_POINTS = "[l_partkey % 500, l_suppkey % 700, l_partkey % 500 + CAST(l_quantity AS BIGINT), l_suppkey % 700 + 30, l_linenumber * 100, 50]"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with boxes and a baseline made up from the item's numbers."""
    x1, y1 = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 700).cast("int")
    w, h = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 37 + 8).cast("int")
    base = F.array(F.struct(x1.alias("x"), (y1 + h - 5).alias("y")), F.struct((x1 + w).alias("x"), (y1 + h).alias("y")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_id"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), base.alias("baseline"), (F.col("l_suppkey") % 3).alias("region_id"))


_BOXES = """SELECT l_orderkey AS page, l_linenumber AS line_id, CAST(l_partkey % 500 AS INTEGER) AS x1, CAST(l_suppkey % 700 AS INTEGER) AS y1, CAST(l_partkey % 500 + CAST(l_quantity AS BIGINT) AS INTEGER) AS x2,
       CAST(l_suppkey % 700 + l_partkey % 37 + 8 AS INTEGER) AS y2, l_suppkey % 3 AS region_id FROM lineitem"""


@query(f"""
SELECT l_orderkey, l_linenumber, CAST(least(p[1], p[3], p[5]) AS INTEGER) AS x1, CAST(least(p[2], p[4], p[6]) AS INTEGER) AS y1, CAST(greatest(p[1], p[3], p[5]) AS INTEGER) AS x2, CAST(greatest(p[2], p[4], p[6]) AS INTEGER) AS y2,
       p[1] || ',' || p[2] || ' ' || p[3] || ',' || p[4] || ' ' || p[5] || ',' || p[6] AS points
FROM (SELECT l_orderkey, l_linenumber, {_POINTS} AS p FROM lineitem)
""")
def bbox_from_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in text, parsed, boxed and written back."""
    q = F.col("l_quantity").cast("bigint")
    raw = F.concat(F.col("l_partkey") % 500, F.lit(","), F.col("l_suppkey") % 700, F.lit("  "), F.col("l_partkey") % 500 + q, F.lit(","), F.col("l_suppkey") % 700 + 30, F.lit(" "), F.col("l_linenumber") * 100, F.lit(",50 "))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.parse_points(raw).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", geometry.points_box(F.col("p")).alias("b"), geometry.points_text(F.col("p")).alias("points")).select("l_orderkey", "l_linenumber", "b.*", "points")


@query(f"SELECT page, region_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS lines FROM ({_BOXES}) GROUP BY page, region_id")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_boxes(_boxes(spark, sf_dir), "page", "region_id")


@query(f"SELECT page, line_id, greatest(0, x1 - 5) AS x1, greatest(0, y1 - 5) AS y1, least(520, x2 + 5) AS x2, least(700, y2 + 5) AS y2 FROM ({_BOXES})")
def clamp_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.padded_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(520), F.lit(700))
    return _boxes(spark, sf_dir).select("page", "line_id", box.alias("b")).select("page", "line_id", "b.*")


@query(f"""
SELECT page, line_id, CASE WHEN old <= (y2 - 3 + 10) - greatest(0, y1 + 4 - 10) + 5 THEN y1 ELSE greatest(0, y1 + 4 - 10) END AS top,
       CASE WHEN old <= (y2 - 3 + 10) - greatest(0, y1 + 4 - 10) + 5 THEN y2 ELSE y2 - 3 + 10 END AS bottom
FROM (SELECT *, y2 - y1 AS old FROM (SELECT page, line_id, y1, y2 + 40 AS y2 FROM ({_BOXES})))
""")
def tighten_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons tightened to the ink's rows."""
    rows = _boxes(spark, sf_dir).withColumn("y2", F.col("y2") + 40)
    tight = geometry.tightened_points(geometry.box_points(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.col("y1") + 4, F.col("y2") - 3)
    box = geometry.points_box(tight)
    return rows.select("page", "line_id", box["y1"].alias("top"), box["y2"].alias("bottom"))


@query(f"SELECT page % 50 AS page, CAST(least(39, greatest(0, floor(floor((x1 + x2) / 2) / (520 / 40.0)))) AS INTEGER) AS bin, count(*) AS n FROM ({_BOXES}) GROUP BY 1, 2")
def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_histogram(_boxes(spark, sf_dir).withColumn("page", F.col("page") % 50), "page", F.lit(520))


@query(f"""
WITH b AS (SELECT *, floor((x1 + x2) / 2) AS cx FROM ({_BOXES}))
SELECT page, line_id, CAST([c[2] FOR c IN [list_min([[abs(cx - 65), 0], [abs(cx - 195), 1], [abs(cx - 325), 2], [abs(cx - 455), 3]])]][1] AS INTEGER) AS nearest FROM b
""")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of four column centres."""
    centers = F.array(*[F.lit(c) for c in (65, 195, 325, 455)])
    return _boxes(spark, sf_dir).select("page", "line_id", layout.nearest_index(geometry.center_x(F.col("x1"), F.col("x2")), centers).alias("nearest"))


@query(f"""
WITH h AS (SELECT page % 50 AS page, CAST(least(39, greatest(0, floor(floor((x1 + x2) / 2) / (520 / 40.0)))) AS INTEGER) AS bin, count(*) AS n FROM ({_BOXES}) GROUP BY 1, 2),
t AS (SELECT *, max(n) OVER (PARTITION BY page) AS top FROM h), k AS (SELECT *, bin - lag(bin) OVER (PARTITION BY page ORDER BY bin) AS d FROM t WHERE n >= greatest(2, floor(top * 0.25))),
p AS (SELECT page, bin, row_number() OVER (PARTITION BY page ORDER BY bin) - 1 AS c FROM k WHERE d IS NULL OR d > 2),
l AS (SELECT page, arg_min(bin, (-n, bin)) AS bin FROM h WHERE page NOT IN (SELECT page FROM p) GROUP BY page)
SELECT page, CAST(c AS INTEGER) AS "column", bin FROM p WHERE c < 4 UNION ALL SELECT page, 0, bin FROM l
""")
def column_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the histogram of line centres."""
    bins = layout.column_histogram(_boxes(spark, sf_dir).withColumn("page", F.col("page") % 50), "page", F.lit(520))
    return sequences.peaks(bins, "page")


@query("""
WITH l AS (SELECT p_size AS page, p_partkey AS line_id, CAST(p_partkey % 900 AS INTEGER) AS cx, CAST(p_partkey * 7 % 600 AS INTEGER) AS cy FROM part),
r AS (SELECT s_suppkey % 50 + 1 AS page, s_name AS region_id, s_suppkey AS region_idx, s_suppkey * 31 % 700 AS x1, s_suppkey * 17 % 400 AS y1 FROM supplier),
h AS (SELECT l.page, line_id, arg_min(region_id, region_idx) AS region_id FROM l JOIN r ON l.page = r.page AND cx BETWEEN x1 AND x1 + 400 AND cy BETWEEN y1 AND y1 + 300 GROUP BY 1, 2)
SELECT l.page, l.line_id, coalesce(region_id, 'r_1') AS region_id FROM l LEFT JOIN h ON l.line_id = h.line_id
""")
def point_in_bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the first region that holds their centre."""
    x, y = (F.col("p_partkey") % 900).cast("int"), (F.col("p_partkey") * 7 % 600).cast("int")
    found = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("page"), F.col("p_partkey").alias("line_id"), (x - 6).alias("x1"), (y - 4).alias("y1"), (x + 6).alias("x2"), (y + 4).alias("y2"))
    s = F.col("s_suppkey")
    regions = table(spark, sf_dir, "supplier").select((s % 50 + 1).alias("page"), F.col("s_name").alias("region_id"), s.alias("region_idx"), (s * 31 % 700).alias("x1"), (s * 17 % 400).alias("y1"), (s * 31 % 700 + 400).alias("x2"), (s * 17 % 400 + 300).alias("y2"))
    return layout.region_of_lines(found, regions, "page").select(F.col("page").cast("int").alias("page"), "line_id", "region_id")


@query("""
WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) * 10 AS x, unnest([CAST(floor(100 * CAST(v AS DOUBLE)) AS INTEGER) FOR v IN embedding]) AS y FROM embeddings)
SELECT vec_id, round(degrees(atan(regr_slope(y, x))), 6) + 0.0 AS angle FROM p GROUP BY vec_id
""")
def deskew_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of the line through the points of a vector."""
    points = F.transform("embedding", lambda v, i: F.struct((i * 10).alias("x"), F.floor(v.cast("double") * 100).cast("int").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(geometry.baseline_angle(points), 6) + 0.0).alias("angle"))


@query(f"""
SELECT page, count(DISTINCT region_id) AS regions, count(*) AS lines, round(avg(y2 - y1), 6) AS mean_line_height, round(var_pop(y2 - y1), 6) AS height_variance,
       round(coalesce(avg(CASE WHEN x2 > x1 THEN sqrt((x2 - x1) * (x2 - x1) + 25.0) / (x2 - x1) END), 0), 6) AS baseline_ratio FROM ({_BOXES}) GROUP BY page
""")
def qc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of segmented pages."""
    return layout.segmentation_quality(_boxes(spark, sf_dir), "page").withColumns({c: F.round(c, 6) for c in ("mean_line_height", "height_variance", "baseline_ratio")})


@query(f"SELECT page, line_id, CAST(coalesce(sum(y2 - y1 + 10) OVER (PARTITION BY page ORDER BY line_id, y2 - y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM ({_BOXES})")
def stack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of line images put below each other."""
    rows = _boxes(spark, sf_dir).withColumn("h", F.col("y2") - F.col("y1"))
    return sequences.stacked_offsets(rows, "page", ["line_id", "h"], "h").select("page", "line_id", F.col("y_offset").cast("bigint").alias("y_offset"))


@query("""
SELECT p_partkey, CAST(least(10000, greatest(1, trunc(64 * (w / h)))) AS INTEGER) AS ratio_first, CAST(least(10000, greatest(1, trunc(w * 64 / h))) AS INTEGER) AS multiply_first,
       CASE WHEN greatest(w, h) > 600 THEN CAST(greatest(1, trunc(w * (600 / greatest(w, h)))) AS INTEGER) ELSE CAST(w AS INTEGER) END AS limited
FROM (SELECT p_partkey, CAST(p_partkey % 1500 + 1 AS DOUBLE) AS w, CAST(p_size + 10 AS DOUBLE) AS h FROM part)
""")
def aspect_resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths at a target height in both orders of the arithmetic, and limited sizes."""
    w, h, t = (F.col("p_partkey") % 1500 + 1).cast("int"), (F.col("p_size") + 10).cast("int"), F.lit(64)
    return table(spark, sf_dir, "part").select("p_partkey", geometry.resized_width(w, h, t).alias("ratio_first"), geometry.resized_width(w, h, t, True).alias("multiply_first"), geometry.limited_size(w, h, 600)["width"].alias("limited"))


@query("""
SELECT o_orderkey, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s // 60 % 60 || 'm ' || s % 60 || 's' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS duration,
       round(s / 20.0, 6) AS eta FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS s FROM orders)
""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as text, and minutes to go at twenty images a minute."""
    s = F.floor("o_totalprice") % 9000
    return table(spark, sf_dir, "orders").select("o_orderkey", text.duration_text(s).alias("duration"), F.round(text.eta_minutes(s, F.lit(20.0)), 6).alias("eta"))


@query("""
SELECT source, CASE WHEN a < 40 THEN 'too small' WHEN a < 50 THEN 'good' WHEN a < 70 THEN 'very good' WHEN a <= 90 THEN 'large' ELSE 'too large' END AS height,
       CASE WHEN c < 50 THEN 'small' WHEN c < 100 THEN 'low' WHEN c <= 300 THEN 'typical' WHEN c <= 500 THEN 'high' ELSE 'large' END AS vocabulary,
       CASE WHEN n >= 10000 THEN 'enough' WHEN n >= 1000 THEN 'few' ELSE 'too few' END AS size
FROM (SELECT source, avg(n_chars % 100) AS a, count(DISTINCT n_chars % 400) AS c, count(*) AS n FROM documents GROUP BY source)
""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guideline bands of data sets."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg(F.col("n_chars") % 100).alias("a"), F.count_distinct(F.col("n_chars") % 400).alias("c"), F.count("*").alias("n"))
    return d.select("source", quality.quality_bands(F.col("a"), F.col("c"), F.col("n")).alias("b")).select("source", "b.*")


@query("""
SELECT user_id, event_id, CAST(greatest(0, t - p - c) AS BIGINT) AS internal_tok, round(CASE WHEN t > 0 THEN greatest(0, t - p - c) / t END, 6) AS internal_share
FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS t, event_id % 50 AS p, event_id % 31 AS c FROM events)
""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal tokens of a run log."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("total_tok"), (F.col("event_id") % 50).alias("prompt_tok"), (F.col("event_id") % 31).alias("cand_tok"))
    return quality.token_usage(log).select("user_id", "event_id", F.col("internal_tok").cast("bigint").alias("internal_tok"), F.round("internal_share", 6).alias("internal_share"))


@query("""
WITH r AS (SELECT * FROM (VALUES ('view', 'cpu', 32, 30.0), ('click', 'cuda', 4, 5.0), ('error', 'cpu', 16, 18.0)) v(engine, min_device, default_batch, per_min))
SELECT event_type AS engine, CAST(coalesce(per_min, 10.0) AS DOUBLE) AS images_per_min, coalesce(default_batch, 1) AS default_batch, images, round(images / CAST(coalesce(per_min, 10.0) AS DOUBLE), 6) AS minutes
FROM (SELECT event_type, count(*) AS images FROM events GROUP BY event_type) LEFT JOIN r ON event_type = engine
""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine settings by name, with a default speed, and the minutes that runs take."""
    registry = spark.createDataFrame([("view", "cpu", 32, 30.0), ("click", "cuda", 4, 5.0), ("error", "cpu", 16, 18.0)], "engine string, min_device string, default_batch int, images_per_min double")
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("images"))
    out = quality.with_engine(counts, registry)
    return out.select("engine", "images_per_min", F.coalesce("default_batch", F.lit(1)).alias("default_batch"), "images", F.round(text.eta_minutes(F.col("images"), F.col("images_per_min")), 6).alias("minutes"))


@query("""
SELECT event_id, CASE WHEN t IS NULL THEN 'unknown engine' WHEN md = 'cuda' AND event_id % 2 = 0 THEN 'needs a GPU' WHEN event_id % 40 NOT BETWEEN 1 AND mb THEN 'batch size out of range' WHEN event_id % 3 > 1 THEN 'too many beams' END AS error
FROM events LEFT JOIN (VALUES ('view', 'cpu', 32), ('click', 'cuda', 4), ('error', 'cpu', 16)) r(t, md, mb) ON event_type = t
""")
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken rule of engine settings."""
    registry = spark.createDataFrame([("view", "cpu", 32, 1, 32, 30.0, 1, None), ("click", "cuda", 4, 1, 4, 5.0, 1, None), ("error", "cpu", 16, 1, 16, 18.0, 1, None)], quality.ENGINE_SCHEMA)
    e = F.col("event_id")
    configs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("engine"), F.when(e % 2 == 0, "cpu").otherwise("cuda").alias("device"), (e % 40).alias("batch_size"), (e % 3).alias("num_beams"), F.lit(60).alias("images"))
    return quality.config_errors(configs, registry).select("event_id", "error")


@query("""
SELECT conv_id, turn, len(text) AS chars, len([w FOR w IN regexp_split_to_array(text, '\\s+') IF w <> '']) AS words, CASE WHEN trim(text) = '' OR lower(trim(text)) = 'nan' THEN md5('.') ELSE md5(text) END AS target,
       CASE WHEN len(text) > 40 THEN '...' || right(text, 37) ELSE text END AS shortened FROM conversations
""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, usable targets and shortened texts."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(t).cast("bigint").alias("chars"), F.size(text.words(t)).cast("bigint").alias("words"), F.md5(text.usable_text(t)).alias("target"), text.shortened_path(t).alias("shortened"))


@query("SELECT item_id, CAST(reading AS INTEGER) AS reading FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN -1 ELSE item_id * 2 END AS reading FROM benchmark)")
def reading_order_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order indices of custom attributes."""
    custom = F.when(F.col("item_id") % 3 == 0, F.lit("structure {type:x;}")).otherwise(F.concat(F.lit("readingOrder {index:"), F.col("item_id") * 2, F.lit(";}")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(geometry.reading_order_index(custom), F.lit(-1)).alias("reading"))


@query("""
WITH a AS (SELECT p_size AS page, p_partkey AS region_id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS late, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7919 % 1009 ELSE p_partkey END AS place FROM part)
SELECT page, region_id, CAST(row_number() OVER (PARTITION BY page ORDER BY late, place, region_id) - 1 AS INTEGER) AS position FROM a
""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by reference, those without one behind."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.col("p_partkey").alias("region_id"))
    order = parts.where("region_id % 3 = 0").select("page", "region_id", (F.col("region_id") * 7919 % 1009).alias("order_idx"), F.col("region_id").alias("ref_idx"))
    return layout.order_regions(parts.withColumn("region_idx", F.col("region_id")), order)


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'Fast.' || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || 'Again.' ELSE '' END AS prompt, regexp_matches(lower(p_type), 'preview|exp|experimental') AS preview FROM part")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = api_log.prompt(F.col("p_name"), (F.lit(True), "Fast."), (F.col("p_size") > 25, "Again."))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"), api_log.is_preview(F.col("p_type")).alias("preview"))


@query("SELECT item_id, md5(text) AS text_md5, 2 AS used FROM benchmark")
def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in overlapping chunks put together; the SQL has the texts they were cut from."""
    n = F.length("text")
    cuts = [F.struct(F.lit(0).alias("chunk"), F.left("text", F.greatest(F.floor(n * 0.6).cast("int"), F.lit(0))).alias("t")), F.struct(F.lit(1).alias("chunk"), F.substring(F.col("text"), F.floor(n * 0.4).cast("int") + 1, n).alias("t"))]
    chunks = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*cuts)).alias("c")).select("item_id", "c.*")
    return api_log.joined_chunks(chunks, "item_id", text_col="t").select("item_id", F.md5("text").alias("text_md5"), "used")


@query("""
SELECT doc_id, length(t) - length(replace(t, 'e', '')) AS edits, length(replace(t, 'e', '')) AS equal_chars, md5(t) AS reference_md5, md5(replace(t, 'e', '')) AS hypothesis_md5
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def document_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents aligned with what is left without one letter: as many edits as letters are gone, and both texts again
    from the operations."""
    body = F.coalesce("text", F.lit(""))
    rows = _spread(table(spark, sf_dir, "documents")).select("doc_id", metrics.diff_operations(body, F.replace(body, F.lit("e"), F.lit(""))).alias("ops"))
    joined = lambda name: F.md5(F.array_join(F.transform("ops", lambda o: o[name]), ""))
    equal = F.aggregate("ops", F.lit(0).cast("bigint"), lambda s, o: s + F.when(o["op"] == "equal", F.length(o["reference"])).otherwise(0))
    edits = F.size(F.filter("ops", lambda o: o["op"] != "equal")).cast("bigint")
    return rows.select("doc_id", edits.alias("edits"), equal.alias("equal_chars"), joined("reference").alias("reference_md5"), joined("hypothesis").alias("hypothesis_md5"))


@query()
def diff_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit operations of benchmark texts against their hypothesis; the alignment is not unique, so no SQL."""
    return table(spark, sf_dir, "benchmark").select("item_id", metrics.diff_operations("text", F.translate("text", "aeiou", "eioua")).alias("operations"))


@query()
def region_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls of regions' line boxes."""
    return layout.region_hulls(_boxes(spark, sf_dir), "page")


@query(f"""
WITH b AS (SELECT row_number() OVER () AS id, page % 50 AS page, x1 || '_' || y1 || '_' || line_id AS line_id, x1, y1, floor((x1 + x2) / 2) AS cx FROM ({_BOXES}) WHERE y2 - y1 >= 10),
h AS (SELECT page, CAST(least(39, greatest(0, floor(cx / (520 / 40.0)))) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT *, max(n) OVER (PARTITION BY page) AS top FROM h), k AS (SELECT *, bin - lag(bin) OVER (PARTITION BY page ORDER BY bin) AS d FROM t WHERE n >= greatest(2, floor(top * 0.25))),
p AS (SELECT page, bin, row_number() OVER (PARTITION BY page ORDER BY bin) - 1 AS c FROM k WHERE d IS NULL OR d > 2),
l AS (SELECT page, arg_min(bin, (-n, bin)) AS bin FROM h WHERE page NOT IN (SELECT page FROM p) GROUP BY page),
m AS (SELECT page, c, trunc((bin + 0.5) * 520 / 40) AS x FROM (SELECT page, c, bin FROM p WHERE c < 4 UNION ALL SELECT page, 0, bin FROM l)),
a AS (SELECT id, b.page, any_value(line_id) AS line_id, any_value(x1) AS x1, any_value(y1) AS y1, any_value(cx) AS cx, arg_min(c, (abs(cx - x), c)) AS c FROM b JOIN m ON b.page = m.page GROUP BY id, b.page),
r AS (SELECT page, c, row_number() OVER (PARTITION BY page ORDER BY avg(cx), c) AS rank FROM a GROUP BY page, c)
SELECT a.page, line_id, 'col_' || rank AS region, CAST(row_number() OVER (PARTITION BY a.page, a.c ORDER BY y1, x1, line_id) AS INTEGER) AS line_number FROM a JOIN r ON a.page = r.page AND a.c = r.c
""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lines and reading order by column."""
    found = layout.segmented_pages(_boxes(spark, sf_dir).withColumn("page", F.col("page") % 50).withColumn("line_id", F.concat_ws("_", "x1", "y1", "line_id")), "page", F.lit(520))
    return found.select("page", "line_id", "region", "line_number")


_EVEN_PAGES = SQL["page_columns"].partition("r AS (")[0].rstrip().rstrip(",")
_EVEN_PAGES = _EVEN_PAGES.replace("WITH b AS (", "WITH every_line AS (").replace("AS cx FROM", "AS cx, region_id FROM").replace("WHERE y2 - y1 >= 10),", "WHERE y2 - y1 >= 10), b AS (SELECT * FROM every_line WHERE page % 2 = 0),", 1)


@query(f"""
{_EVEN_PAGES}, g AS (SELECT page, line_id, x1, y1, 'col_' || c AS rid FROM a UNION ALL SELECT page, line_id, x1, y1, 'text_' || region_id FROM every_line WHERE page % 2 = 1)
SELECT page, line_id, 'r_' || dense_rank() OVER (PARTITION BY page ORDER BY rid) AS region, CAST(row_number() OVER (PARTITION BY page, rid ORDER BY y1, x1, line_id) AS INTEGER) AS line_number FROM g
""")
def model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the regions that a model gave them on odd pages; even pages, all lines of which are in one, by columns."""
    named = F.when(F.col("page") % 2 == 1, F.concat(F.lit("text_"), F.col("region_id").cast("string")))
    boxes = _boxes(spark, sf_dir).withColumn("page", F.col("page") % 50).withColumn("line_id", F.concat_ws("_", "x1", "y1", "line_id")).withColumn("region_id", named)
    return layout.grouped_regions(boxes, "page", F.lit(520), least_height=10).select("page", "line_id", "region", "line_number")


def _line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_bytes = F.encode("text", "UTF-8").alias("content")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("page"), F.col("turn").cast("string").alias("line_id"), F.col("turn").cast("int").alias("line_idx"), text_bytes)


_ECHO_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS page, count(*) AS line_count, CAST(sum(len(replace(text, chr(10), ''))) AS BIGINT) AS char_count, round(avg(least(1.0, len(text) / 100)), 6) AS avg_confidence
FROM conversations GROUP BY conv_id
"""


@query(_ECHO_SQL)
def echo_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through the echo transcriber, summed by page."""
    from palimpsest.operators.transcribe import EchoTranscriber, transcribe

    return quality.page_summary(transcribe(_line_images(spark, sf_dir), EchoTranscriber()), "page").withColumns({"avg_confidence": F.round("avg_confidence", 6), "char_count": F.col("char_count").cast("bigint")})


@query(_ECHO_SQL)
def transcribe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table function in SQL, page by page."""
    from palimpsest.operators import table_functions

    table_functions.register(spark)
    _line_images(spark, sf_dir).createOrReplaceTempView("palimpsest_lines")
    found = spark.sql("SELECT * FROM transcribe(TABLE(palimpsest_lines) PARTITION BY page ORDER BY (line_idx), 'echo')")
    return quality.page_summary(found, "page").withColumns({"avg_confidence": F.round("avg_confidence", 6), "char_count": F.col("char_count").cast("bigint")})


_PART_LINES = """SELECT 'p' || p_partkey // 40 AS path, 'r' || p_partkey % 3 AS region_id, p_partkey % 3 AS region_idx, 'l' || p_partkey AS line_id, p_partkey AS line_idx, trim(p_name) AS text, CAST(p_partkey * 13 % 900 AS INTEGER) AS x1,
       CAST(p_partkey * 7 % 600 AS INTEGER) AS y1, CAST(p_partkey * 13 % 900 + p_size + 5 AS INTEGER) AS x2, CAST(p_partkey * 7 % 600 + 20 AS INTEGER) AS y2 FROM part"""


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts to a page, in three regions, named by their lines."""
    k = F.col("p_partkey")
    x1, y1 = (k * 13 % 900).cast("int"), (k * 7 % 600).cast("int")
    name = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    return table(spark, sf_dir, "part").select(
        name("p", F.floor(k / 40)).alias("page"), name("p", F.floor(k / 40)).alias("image_name"), F.lit(930).alias("page_width"), F.lit(610).alias("page_height"), name("r", k % 3).alias("region_id"), (k % 3).cast("int").alias("region_idx"),
        name("l", k).alias("line_id"), k.cast("int").alias("line_idx"), F.col("p_name").alias("text"), F.lit(0.5).alias("confidence"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("p_size").cast("int") + 5).alias("x2"), (y1 + 20).alias("y2"), F.lit(None).cast("array<struct<x:int,y:int>>").alias("coords"),
    )


def _part_pages(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """Parts as PAGE documents, read back; without their reading order on demand."""
    xml = F.col("xml") if ordered else F.regexp_replace("xml", "<ReadingOrder>.*</ReadingOrder>", "")
    return layout_xml.parse_pages(sinks.page_xml(_part_lines(spark, sf_dir)).select(F.col("page").alias("path"), xml.cast("binary").alias("content")))


@query(f"SELECT path, region_id, line_id, text, x1, y1, x2, y2, x2 - x1 AS width FROM ({_PART_LINES}) WHERE text <> '' AND x2 - x1 >= 20")
def page_xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text and a width, written as PAGE documents and read back."""
    return xml_lines.page_lines(_part_pages(spark, sf_dir)).select("path", "region_id", "line_id", "text", "x1", "y1", "x2", "y2", "width")


@query(f"SELECT path, md5(string_agg(text || chr(10), '' ORDER BY region_idx, line_idx)) AS text_md5 FROM ({_PART_LINES}) GROUP BY path")
def page_xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts in the documents' reading order."""
    return xml_lines.page_texts(_part_pages(spark, sf_dir)).select("path", F.md5("text").alias("text_md5"))


@query(f"""
WITH l AS ({_PART_LINES}), r AS (SELECT path, region_id, min(y1) AS y FROM l GROUP BY path, region_id)
SELECT path, md5(string_agg(text || chr(10), '' ORDER BY y, region_idx, line_idx)) AS text_md5 FROM l JOIN r USING (path, region_id) GROUP BY path
""")
def page_xml_texts_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of documents without a reading order: regions from top to bottom."""
    return xml_lines.page_texts(_part_pages(spark, sf_dir, ordered=False)).select("path", F.md5("text").alias("text_md5"))


@query(f"""
WITH l AS ({_PART_LINES}), r AS (SELECT path, region_id, min(y1) AS y FROM l GROUP BY path, region_id)
SELECT path, line_id, CAST(row_number() OVER (PARTITION BY path ORDER BY y, region_idx, line_idx) - 1 AS INTEGER) AS position, greatest(0, x1 - 5) AS px1, greatest(0, y1 - 5) AS py1, least(930, x2 + 5) AS px2, least(610, y2 + 5) AS py2
FROM l JOIN r USING (path, region_id)
""")
def page_xml_guided_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in reading order with padded boxes, as page inference takes them."""
    found = xml_lines.guided_lines(_part_pages(spark, sf_dir))
    return found.select("path", "line_id", "position", *[F.col(f"padded.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])


@query(f"SELECT path || '.xml' AS file, count(*) AS lines, CAST(sum(len(text)) AS BIGINT) AS chars FROM ({_PART_LINES}) GROUP BY path")
def page_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page documents written as files of an export and read back from its page folder."""
    folder = new_folder(spark, "export")
    documents = sinks.page_xml(_part_lines(spark, sf_dir)).select(F.concat("page", F.lit(".xml")).alias("name"), "xml")
    sinks.write_files(documents, f"{folder}/page", "name", "xml")
    found = xml_lines.corpus_lines(layout_xml.parse_pages(layout_xml.read_export(spark, folder), "auto"))
    return found.groupBy(F.substring_index("path", "/", -1).alias("file")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM ({_PART_LINES})) WHERE ch <> '' GROUP BY ch")
def page_parquet_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page documents with images turned into a Parquet set of lines, and the counts of its characters."""
    folder, out = new_folder(spark, "export"), new_folder(spark, "lines")
    sinks.write_files(sinks.page_xml(_part_lines(spark, sf_dir)).select(F.concat("page", F.lit(".xml")).alias("name"), "xml"), folder, "name", "xml")
    images = layout_xml.read_xml(spark, folder).select(F.regexp_replace("path", "xml$", "png").alias("path"))
    return jobs.page_to_parquet(spark, folder, images, out)[1]


@query("SELECT CAST(conv_id AS VARCHAR) AS image, count(*) AS line_count, CAST(sum(len(replace(text, chr(10), ''))) AS BIGINT) AS char_count FROM conversations GROUP BY conv_id")
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch transcription from lines to its files, and the summary that it wrote."""
    from palimpsest.operators.transcribe import EchoTranscriber

    out = new_folder(spark, "batch")
    jobs.run_batch(_line_images(spark, sf_dir), EchoTranscriber(), out, pages_per_file=100)
    return spark.read.option("header", "true").csv(f"{out}/batch_results.csv").select("image", F.col("line_count").cast("bigint").alias("line_count"), F.col("char_count").cast("bigint").alias("char_count"))


@query(f"SELECT path, region_id, line_id, text, x1, y1, x2, y2 FROM ({_PART_LINES}) WHERE text <> '' AND x2 - x1 >= 20")
def alto_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ALTO documents, their words apart."""
    part = _part_lines(spark, sf_dir)
    words = F.array_join(F.transform(F.split(sinks.xml_escaped(F.trim("text")), " "), lambda w: F.concat(F.lit('<String CONTENT="'), w, F.lit('"/>'))), "<SP/>")
    line = F.concat(F.lit('<TextLine ID="'), F.col("line_id"), F.lit('" HPOS="'), F.col("x1"), F.lit('" VPOS="'), F.col("y1"), F.lit('" WIDTH="'), F.col("x2") - F.col("x1"), F.lit('" HEIGHT="'), F.col("y2") - F.col("y1"), F.lit('">'), words, F.lit("</TextLine>"))
    blocks = part.withColumn("_l", line).groupBy("page", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "_l"))), lambda x: x["_l"]), "").alias("b"))
    block = F.concat(F.lit('<TextBlock ID="'), F.col("region_id"), F.lit('">'), F.col("b"), F.lit("</TextBlock>"))
    pages = blocks.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("t"))
    xml = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page WIDTH="930" HEIGHT="610"><PrintSpace>'), F.col("t"), F.lit("</PrintSpace></Page></Layout></alto>"))
    found = xml_lines.alto_lines(layout_xml.parse_pages(pages.select(F.col("page").alias("path"), xml.cast("binary").alias("content")), "auto"))
    return found.select("path", "region_id", "line_id", "text", "x1", "y1", "x2", "y2")


_EVENT_OF = "CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN event_type END"


def _answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 5 == 0, " ").when(e % 7 == 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", e.alias("seq"), said.alias("text"), (e % 50).alias("prompt_tok"), (e % 31).alias("cand_tok"), (F.floor("value") % 400).alias("total_tok"))


_OUTCOMES_SQL = f"""
WITH e AS (SELECT user_id, event_id, {_EVENT_OF} AS text, event_id % 50 AS p, event_id % 31 AS c, CAST(floor(value) AS BIGINT) % 400 AS t FROM events),
s AS (SELECT *, row_number() OVER w AS pos, coalesce(max(len(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS any_text, max(CAST(coalesce(trim(text) <> '', false) AS INTEGER)) OVER w = 1 AS seen FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, CASE WHEN NOT any_text AND greatest(0, t - p - c) >= 0.6 * 400 THEN 'reasoning abort' WHEN seen THEN 'early exit' END AS kind FROM s),
z AS (SELECT user_id, min(pos) FILTER (WHERE kind IS NOT NULL) AS stop FROM k GROUP BY user_id)
SELECT k.user_id, coalesce(max(kind) FILTER (WHERE pos = stop), 'fallback') AS outcome, max(pos) AS used FROM k JOIN z USING (user_id) WHERE stop IS NULL OR pos <= stop GROUP BY k.user_id
"""


@query(_OUTCOMES_SQL)
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How streamed answers end: at their first text, or where thinking uses up the budget."""
    log = _answer_events(spark, sf_dir)
    return api_log.stream_outcomes(log, "user_id", budget=400).select("user_id", "outcome", F.col("used").cast("bigint").alias("used"))


@query(_OUTCOMES_SQL)
def live_stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while the events arrive, in four parts by their order, with a state for each answer."""
    events = _answer_events(spark, sf_dir)
    log = events.withColumn("last", F.col("seq") == F.max("seq").over(Window.partitionBy("user_id")))
    found, checkpoint = new_folder(spark, "outcomes"), new_folder(spark, "checkpoint")
    stream = spark.readStream.schema(log.schema).parquet(_in_parts(spark, log, "seq"))
    ended = answers.live_outcomes(stream, "user_id", "seq", "last", budget=400, wait_seconds=86_400)
    schema = ended.schema
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{found}/batch={n}")  # noqa: E731  a batch that runs again replaces its rows
    ingest.run_until_idle(ended.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").foreachBatch(write).start())
    return spark.read.schema(schema).parquet(found).select("user_id", "outcome", F.col("used").cast("bigint").alias("used"))
