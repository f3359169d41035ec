"""Carried-state logic over ordered rows as window functions: runs, merges, collapses, histories, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first_of_repeats(rows: DataFrame, by: str, order: list[str], text_col: str, blank: bool = False) -> DataFrame:
    """Without rows whose text equals the text of the row before, empty texts apart; blank=True empties the text
    instead, so that rows stay aligned."""
    last = F.lag(text_col).over(Window.partitionBy(by).orderBy(*order))
    repeat = F.coalesce((F.col(text_col) != "") & F.col(text_col).eqNullSafe(last), F.lit(False))
    if blank:
        return rows.withColumn("_r", repeat).withColumn(text_col, F.when(F.col("_r"), "").otherwise(F.col(text_col))).drop("_r")
    return rows.withColumn("_r", repeat).where("not _r").drop("_r")


def padded_results(results: DataFrame, expected: DataFrame, page_col: str, idx_col: str = "idx", count_col: str = "n") -> DataFrame:
    """Each page's results and empty rows up to its expected count (page, n)."""
    slots = expected.select(page_col, F.explode(F.when(F.col(count_col) > 0, F.sequence(F.lit(0), F.col(count_col).cast("int") - 1))).alias(idx_col))
    return slots.join(results, [page_col, idx_col], "left")


def ctc_collapse(steps: DataFrame, line: str, step: str = "t", symbol: str = "idx", blank: int = 0) -> DataFrame:
    """The steps that greedy decoding emits: not blank, and not the class of the step before; adds pos from 0."""
    last = F.lag(symbol).over(Window.partitionBy(line).orderBy(step))
    emitted = steps.withColumn("_last", last).where((F.col(symbol) != blank) & ~F.col(symbol).eqNullSafe(F.col("_last"))).drop("_last")
    return emitted.withColumn("pos", F.row_number().over(Window.partitionBy(line).orderBy(step)) - 1)


def best_class(logits: DataFrame, line: str = "line_id", step: str = "t") -> DataFrame:
    """(line, t, idx, logp): the most probable class of each step, ties to the smaller class."""
    best = F.max(F.struct(F.col("logp"), (-F.col("cls")).alias("c"), "cls")).alias("b")
    return logits.groupBy(line, step).agg(best).select(line, step, F.col("b.cls").alias("idx"), F.col("b.logp").alias("logp"))


def ctc_decode(logits: DataFrame, vocabulary: DataFrame, line: str = "line_id") -> DataFrame:
    """(line, text, confidence): greedy decoding of (line, t, cls, logp) with a vocabulary (idx, symbol). Emitted classes
    outside it are left out; confidence is the mean probability of the characters kept, 0 without any. A line that
    emits nothing has an empty text."""
    best = best_class(logits, line)
    kept = ctc_collapse(best, line).join(vocabulary, "idx")
    parts = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    decoded = kept.groupBy(line).agg(F.array_join(F.transform(parts, lambda x: x["symbol"]), "").alias("text"), F.avg(F.exp("logp")).alias("confidence"))
    return best.select(line).distinct().join(decoded, line, "left").select(line, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def runs(profile: DataFrame, by: str, at: str, flag: str, min_gap: int, min_size: int, most: int | None = None) -> DataFrame:
    """(by, first, last): runs of true rows; a run ends after min_gap rows that are not true. Runs shorter than min_size
    or longer than most are left out."""
    w = Window.partitionBy(by).orderBy(at)
    true = profile.where(F.col(flag)).withColumn("_gap", F.col(at) - F.lag(at).over(w) - 1)
    marked = true.withColumn("_run", F.sum(F.when(F.coalesce("_gap", F.lit(0)) >= min_gap, 1).otherwise(0)).over(w))
    found = marked.groupBy(by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_run")
    size = F.col("last") - F.col("first") + 1
    return found.where((size >= min_size) & (size <= most if most else F.lit(True)))


def merge_close(intervals: DataFrame, by: str, start: str, end: str, max_gap: int) -> DataFrame:
    """(by, start, end, parts): intervals whose start is at most max_gap after all before them end become one."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(F.col(start) - reach <= max_gap, 0).otherwise(1))
    marked = marked.withColumn("_part", F.sum("_new").over(w))
    return marked.groupBy(by, "_part").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("_part")


def peaks(bins: DataFrame, by: str, at: str = "bin", count: str = "n", most: int = 4) -> DataFrame:
    """(by, column, bin): bins with at least max(2, a quarter of the highest count), except those within 2 of the such
    bin before; the leftmost `most` of them. Where no bin is that high, the highest, ties to the left."""
    w = Window.partitionBy(by)
    top = bins.withColumn("_max", F.max(count).over(w))
    high = top.where(F.col(count) >= F.greatest(F.lit(2), F.floor(F.col("_max") * 0.25)))
    first = high.withColumn("_d", F.col(at) - F.lag(at).over(w.orderBy(at))).where("_d is null or _d > 2")
    chosen = first.withColumn("column", F.row_number().over(w.orderBy(at)) - 1).where(F.col("column") < most).select(by, "column", F.col(at).alias("bin"))
    lone = bins.join(chosen.select(by).distinct(), by, "left_anti").groupBy(by).agg(F.min_by(at, F.struct(-F.col(count), F.col(at))).alias("bin")).select(by, F.lit(0).alias("column"), "bin")
    return chosen.unionByName(lone)


def recent_distinct(events: DataFrame, by: str, item: str, *order: Column | str, most: int = 10) -> DataFrame:
    """(by, item, rank): the distinct items used last, newest first."""
    last = events.groupBy(by, item).agg(F.max(F.struct(*order)).alias("_last"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_last"), item))
    return last.withColumn("rank", rank).where(F.col("rank") <= most).drop("_last")


def stacked_offsets(lines: DataFrame, by: str, order: list[str], height: str, gap: int = 10) -> DataFrame:
    """Adds y_offset: the heights and gaps of the lines before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("y_offset", F.coalesce(F.sum(F.col(height) + gap).over(w), F.lit(0)))
