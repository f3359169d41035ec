"""Character vocabularies, index encoding, n-gram counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import SPACE_TOKEN, chars, lm_tokens


def char_counts(texts: DataFrame, text_col: str = "text", *by: str) -> DataFrame:
    """(by..., ch, n): how often each code point occurs. Each Arrow batch is counted whole, so that a row stands for a
    character of a batch and not for one of a text."""
    rows = texts.select(*by, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ch", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, own = (batch.column(k).to_pylist() for k in range(batch.num_columns))
            found: dict[tuple, Counter] = {}
            for key, text in zip(zip(*keys, strict=True) if keys else [()] * len(own), own, strict=True):
                if text:
                    found.setdefault(key, Counter()).update(text)
            counted = [(*key, ch, n) for key, counts in found.items() for ch, n in counts.items()]
            kinds = [*[batch.column(k).type for k in range(len(keys))], pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in counted], kind) for k, kind in enumerate(kinds)], schema.names)

    return rows.mapInArrow(run, schema).groupBy(*by, "ch").agg(F.sum("n").alias("n"))


def sorted_charset(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(rank, symbol): the space token at 0, then the other characters by code point."""
    symbols = char_counts(texts, text_col).where("ch <> ' '").select("ch")
    ranked = symbols.select(F.row_number().over(Window.orderBy("ch")).alias("rank"), F.col("ch").alias("symbol"))
    return texts.sparkSession.createDataFrame([(0, SPACE_TOKEN)], "rank int, symbol string").unionByName(ranked)


def frequency_vocabulary(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(rank from 0, symbol, n): by count, ties by first occurrence in the order of ids; a space is its token."""
    seen = texts.select(F.col(id_col).alias("id"), F.posexplode(chars(F.col(text_col))).alias("pos", "ch"))
    counts = seen.groupBy("ch").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1
    return counts.select(rank.alias("rank"), F.when(F.col("ch") == " ", SPACE_TOKEN).otherwise(F.col("ch")).alias("symbol"), "n")


def parse_vocabulary_lines(lines: DataFrame, order_col: str = "line_idx", text_col: str = "text") -> DataFrame:
    """(idx, symbol) from the lines of a symbols file: 'symbol index' lines if the first line has that form, else a list
    whose line numbers are the indices. A leading <ctc> is dropped from lists; space tokens become spaces."""
    text = F.col(text_col)
    first = lines.where(text != "").orderBy(order_col).select(text.rlike(r"^\S+ \d+$")).first()
    kaldi = bool(first and first[0])
    pair = r"^(.*) (\d+)$"
    symbol, at = (F.regexp_extract(text, pair, 1), F.regexp_extract(text, pair, 2).try_cast("int")) if kaldi else (text, F.col(order_col).cast("int"))
    parsed = lines.where(text != "").select(at.alias("idx"), symbol.alias("symbol")).where("idx is not null")
    return parsed.where("symbol <> '<ctc>'").select("idx", F.when(F.col("symbol").isin("<SPACE>", "<space>"), " ").otherwise(F.col("symbol")).alias("symbol"))


def char_indices(text: Column, vocabulary: Column) -> Column:
    """Index of each character by a map from symbols; spaces by their tokens, unknown characters 0."""
    space = F.coalesce(F.try_element_at(vocabulary, F.lit("<SPACE>")), F.try_element_at(vocabulary, F.lit("<space>")), F.try_element_at(vocabulary, F.lit(" ")), F.lit(0))
    return F.transform(chars(text), lambda c: F.when(c == " ", space).otherwise(F.coalesce(F.try_element_at(vocabulary, c), F.lit(0))))


def indices_text(indices: Column, symbols: Column) -> Column:
    """Characters of indices by a map from indices; unknown ones are left out."""
    return F.array_join(F.transform(indices, lambda i: F.coalesce(F.try_element_at(symbols, i), F.lit(""))), "")


def unknown_rate(texts: DataFrame, vocabulary: DataFrame, *by: str, text_col: str = "text") -> DataFrame:
    """(by..., n, unknown, rate): characters outside the vocabulary (symbol), spaces being known. Counts of characters
    meet the vocabulary, not the texts."""
    counts = char_counts(texts, text_col, *by)
    known = vocabulary.select(F.col("symbol").alias("ch")).distinct().withColumn("known", F.lit(True))
    joined = counts.join(known, "ch", "left").withColumn("out", F.when(F.col("known").isNull() & (F.col("ch") != " "), F.col("n")).otherwise(0))
    return joined.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("out").alias("unknown"), (F.sum("out") / F.sum("n")).alias("rate"))


def lm_corpus(lines: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., tokens) of the lines that are not blank."""
    return lines.select(*keep, lm_tokens(F.col(text_col)).alias("tokens")).where("tokens is not null")


def ngram_counts(lines: DataFrame, text_col: str = "text", orders: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(n, gram, count) of character n-grams within lines."""
    grams = lambda n: F.transform(F.when(F.length(text_col) >= n, F.sequence(F.lit(1), F.length(text_col) - (n - 1))), lambda i: F.struct(F.lit(n).alias("n"), F.substring(F.col(text_col), i, F.lit(n)).alias("gram")))
    every = F.concat(*[F.coalesce(grams(n), F.array().cast("array<struct<n:int,gram:string>>")) for n in orders])
    return lines.select(F.explode(every).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("count"))


def most_frequent(counts: DataFrame, most: int = 20, count_col: str = "n", symbol_col: str = "ch") -> DataFrame:
    """The symbols that occur most, ties by code point."""
    return counts.orderBy(F.desc(count_col), symbol_col).limit(most)


def overridden(vocabulary: DataFrame, checkpoint: DataFrame, enable_spaces: bool = True) -> DataFrame:
    """(idx, symbol): the checkpoint's symbols if it has any, else the file's; space tokens become spaces on demand."""
    chosen = vocabulary if checkpoint.isEmpty() else checkpoint
    symbol = F.when(F.lit(enable_spaces) & F.col("symbol").isin("<SPACE>", "<space>"), " ").otherwise(F.col("symbol"))
    return chosen.select("idx", symbol.alias("symbol"))
