"""Prompts, continuations and model lists of remote transcription services, over logged rows; nothing is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import strip

#: Fixed values.
PREVIEW = "preview|exp|experimental"


def is_preview(model: Column) -> Column:
    return F.lower(model).rlike(PREVIEW)


def prompt(base: Column, *extras: tuple[Column, str]) -> Column:
    """The base prompt and each extra paragraph whose condition holds."""
    return F.concat(base, *[F.when(condition, F.lit(f"\n\n{text}")).otherwise("") for condition, text in extras])


def without_overlap(text: Column, more: Column, most: int = 200) -> Column:
    """`more` less its longest beginning, of up to `most` characters, that the text ends with."""
    n = F.least(F.length(text), F.length(more), F.lit(most))
    sizes = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda k: F.endswith(text, F.substring(more, F.lit(1), k))))
    return F.substring(more, F.coalesce(F.array_max(sizes), F.lit(0)) + 1, F.length(more))


def joined_chunks(chunks: DataFrame, key: str, order: str = "chunk", text_col: str = "text", least_new: int = 1) -> DataFrame:
    """(key, text, used): the chunks of each answer in order, overlaps cut off, up to the first that adds fewer than
    least_new characters. A fold over an answer's chunks, which are few."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text_col, F.lit("")).alias("t"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        new = without_overlap(s["text"], x["t"])
        over = s["over"] | ((s["used"] > 0) & (F.length(new) < least_new))
        return F.struct(F.when(over, s["text"]).otherwise(F.concat(s["text"], new)).alias("text"), F.when(over, s["used"]).otherwise(s["used"] + 1).alias("used"), over.alias("over"))

    return chunks.groupBy(key).agg(parts.alias("parts")).select(key, F.aggregate("parts", start, step).alias("s")).select(key, "s.text", "s.used")


def usable_models(models: DataFrame, wanted: list[str], fallback: list[str], name_col: str = "model") -> DataFrame:
    """Model names that hold one of the wanted substrings, newest names first; the fallback list if there is none."""
    found = models.where(F.lower(name_col).rlike("|".join(wanted))).select(name_col).distinct()
    if found.isEmpty():
        found = models.sparkSession.createDataFrame([(m,) for m in fallback], f"{name_col} string")
    return found.orderBy(F.desc(name_col))


def stream_outcomes(events: DataFrame, call: str = "call", order: str = "seq", budget: int = 8192, share: float = 0.6, early_exit: bool = True) -> DataFrame:
    """(call, outcome, text, used, prompt_tok, cand_tok, total_tok) from the events of streamed answers (call, seq, text,
    prompt_tok, cand_tok, total_tok).

    outcome is "early exit" at the first event up to which there is any visible text, if early_exit; "reasoning abort" at
    the first event without any text so far whose internal tokens (total less prompt and candidates) reach the share of the
    budget; "full" if a stream ends with text, else "fallback". text is what had come by then, used the events up to
    there; the token counts are those of the first event that has any."""
    own = Window.partitionBy(call).orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    visible = F.col("text").rlike(r"\S")
    internal = F.greatest(F.lit(0), F.col("total_tok") - F.col("prompt_tok") - F.coalesce("cand_tok", F.lit(0)))
    known = F.col("prompt_tok").isNotNull() & F.col("total_tok").isNotNull()
    rows = events.withColumns({"_at": F.row_number().over(own), "_any": F.coalesce(F.max(F.length("text")).over(before), F.lit(0)) > 0, "_seen": F.max(F.coalesce(visible, F.lit(False))).over(upto), "_usage": F.when(known, F.struct("prompt_tok", "cand_tok", "total_tok"))})
    kind = F.when(~F.col("_any") & known & (internal >= share * budget), "reasoning abort").when(F.lit(early_exit) & F.col("_seen"), "early exit")
    stops = rows.withColumn("_kind", kind)
    first = F.min(F.when(F.col("_kind").isNotNull(), F.col("_at")))
    ends = stops.groupBy(call).agg(first.alias("_stop"), F.min_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("_at"))).alias("_kind"))
    kept = stops.drop("_kind").join(ends, call).where(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    parts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("text", F.lit("")).alias("t"))))
    text = strip(F.array_join(F.transform(parts, lambda x: x["t"]), ""))
    out = kept.groupBy(call).agg(text.alias("text"), F.max("_at").alias("used"), F.max("_kind").alias("_kind"), F.min_by("_usage", F.when(F.col("_usage").isNotNull(), F.col("_at"))).alias("_u"))
    outcome = F.coalesce("_kind", F.when(F.col("text") != "", "full").otherwise("fallback"))
    return out.select(call, outcome.alias("outcome"), F.when(outcome == "reasoning abort", "").otherwise(F.col("text")).alias("text"), "used", "_u.prompt_tok", "_u.cand_tok", "_u.total_tok")


def encoded_image(content: Column) -> Column:
    """Image bytes as base64 text, as services take them."""
    return F.base64(content)
