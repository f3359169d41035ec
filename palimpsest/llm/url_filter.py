"""URL filter: host and path rules first, then a ratio of two character language models.

Both models are variable-order Markov models with Witten-Bell smoothing: the probability of a character mixes what
followed its context in training with the estimate from the context shortened by its first character, down to a uniform
distribution. One is trained on accepted, one on rejected URLs; a URL's score is the difference of the two
log-likelihoods, divided by its length, and it is allowed if the score reaches a threshold calibrated on URLs kept out
of training. Accepted and rejected URLs are all those that the rules decide. Counts and probabilities are tables, which
URLs meet in joins on contexts; MarkovModel, UrlModel and calibrate are the same in memory, for small sets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, dealt_anew

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Decides URLs of a host and its subdomains whose path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the query; fixed values.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or end, A-Z in lower case; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or end; empty without :// or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and rule_verdict. The longest fitting rule wins, of equal ones the first given; rule and
    rule_verdict are null if none fits."""
    out = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


class MarkovModel:
    """Character counts after every context of up to `order` characters; ^ marks the start, $ the end of a URL."""

    def __init__(self, order: int = 6, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.after: dict[str, dict[str, int]] = defaultdict(dict)
        self.total: dict[str, int] = defaultdict(int)

    def fit(self, urls: list[str]) -> MarkovModel:
        after, total = self.after, self.total
        for url in urls:
            text = f"^{url}$"
            for i in range(1, len(text)):
                c = text[i]
                for n in range(min(self.order, i) + 1):
                    context = text[i - n : i]
                    seen = after[context]
                    seen[c] = seen.get(c, 0) + 1
                    total[context] += 1
        self.after, self.total = dict(after), dict(total)
        return self

    def probability(self, context: str, c: str) -> float:
        p = 1.0 / self.alphabet
        for n in range(len(context) + 1):
            seen = self.after.get(context[len(context) - n :])
            if seen is None:
                break
            kinds = len(seen)
            p = (seen.get(c, 0) + kinds * p) / (self.total[context[len(context) - n :]] + kinds)
        return p


@dataclass
class UrlModel:
    """The two models and the calibrated threshold."""

    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float = 0.0

    def score(self, url: str, known: dict[tuple[str, str], float]) -> float:
        """Log-likelihood difference for each character, the end mark included."""
        text, total = f"^{url}$", 0.0
        order = self.accepted.order
        for i in range(1, len(text)):
            key = (text[max(0, i - order) : i], text[i])
            d = known.get(key)
            if d is None:
                if len(known) > 500_000:
                    known.clear()
                d = known[key] = math.log(self.accepted.probability(*key)) - math.log(self.rejected.probability(*key))
            total += d
        return total / (len(text) - 1)


def calibrate(scores: list[tuple[float, bool]]) -> float:
    """The threshold with the best mean of both classes' recalls, halfway between the scores around it; 0 if a class is missing."""
    good, bad = sum(y for _, y in scores), sum(not y for _, y in scores)
    if not good or not bad:
        return 0.0
    values = sorted(scores)
    best, at, lost, kept_out = -1.0, 0.0, 0, 0
    for i in range(len(values) + 1):
        if (i == 0 or i == len(values) or values[i][0] != values[i - 1][0]) and (now := (good - lost) / good + kept_out / bad) > best + 1e-12:
            best = now
            at = values[0][0] - 1e-9 if i == 0 else values[-1][0] + 1e-9 if i == len(values) else (values[i - 1][0] + values[i][0]) / 2
        if i < len(values):
            lost, kept_out = lost + values[i][1], kept_out + (not values[i][1])
    return at


def windows(text: Column, order: int) -> Column:
    """(i, context, c) of each character of ^text$ but the first; the context is the up to `order` characters before it. The
    text is split once, as to cut pieces out of a string takes time by their place."""
    whole = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    cut = lambda cs, i: F.struct(i.alias("i"), F.array_join(F.slice(cs, F.greatest(i - order, F.lit(0)) + 1, F.least(i, F.lit(order))), "").alias("context"), F.get(cs, i).alias("c"))
    return F.flatten(F.transform(F.array(whole), lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - 1), lambda i: cut(cs, i))))


def _shorter(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each end of the context, the empty and the whole one included: keep, n (its length), suffix."""
    size = F.length("context")
    return df.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), size), lambda n: F.substring(F.col("context"), size - n + 1, n))).alias("n", "suffix"))


def context_counts(labelled: DataFrame, order: int = 6, url_col: str = "url", verdict_col: str = "rule_verdict") -> DataFrame:
    """(suffix, c, a, b): how often c follows suffix in accepted and in rejected URLs, over all rows."""
    verdict = F.col(verdict_col)
    at = labelled.select((verdict == "allow").cast("bigint").alias("a"), (verdict == "block").cast("bigint").alias("b"), F.explode(windows(F.col(url_col), order)).alias("w")).select("a", "b", "w.context", "w.c")
    whole = at.groupBy("context", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return _shorter(whole, "c", "a", "b").groupBy("suffix", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def log_ratios(wanted: DataFrame, counts: DataFrame, scratch: Scratch, alphabet: int = 256) -> DataFrame:
    """(context, c, d) for distinct (context, c): the difference of the models' log-probabilities, each mixed from the
    empty context up to the longest that was seen."""
    counts = scratch.cut(counts)
    totals = counts.groupBy("suffix").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count_if(F.col("a") > 0).alias("ka"), F.count_if(F.col("b") > 0).alias("kb"))
    ends = scratch.cut(_shorter(wanted, "context", "c")).join(dealt_anew(totals, "suffix"), "suffix")
    ends = scratch.cut(ends).join(dealt_anew(counts, "suffix", "c"), ["suffix", "c"], "left")
    steps = ends.groupBy("context", "c").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "ta", "tb", "ka", "kb"))).alias("steps"))

    def model(x: str) -> Column:
        mixed = lambda p, s: F.when(s[f"t{x}"] > 0, (s[x] + s[f"k{x}"] * p) / (s[f"t{x}"] + s[f"k{x}"])).otherwise(p)
        return F.aggregate("steps", F.lit(1.0 / alphabet), mixed)

    return steps.select("context", "c", (F.log(model("a")) - F.log(model("b"))).alias("d"))


def url_scores(urls: DataFrame, counts: DataFrame, scratch: Scratch, order: int = 6, url_col: str = "url") -> DataFrame:
    """Rows of distinct URLs with score: the sum of the log ratios for each character, the end mark included. Sums go
    in the order of characters, so that they come out the same each time."""
    urls = scratch.cut(urls.withColumn("__id", F.monotonically_increasing_id()))
    at = scratch.cut(urls.select("__id", F.explode(windows(F.col(url_col), order)).alias("w")).select("__id", "w.*"))
    ratios = scratch.cut(log_ratios(at.select("context", "c").distinct(), counts, scratch))
    met = at.join(dealt_anew(ratios, "context", "c"), ["context", "c"], "left").select("__id", F.struct("i", F.coalesce("d", F.lit(0.0)).alias("d")).alias("x"))
    sums = met.groupBy("__id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("__id", (F.aggregate("x", F.lit(0.0), lambda total, x: total + x["d"]) / F.size("x")).alias("score"))
    return urls.join(sums, "__id").drop("__id")


def calibrated(scores: DataFrame, scratch: Scratch) -> float:
    """What calibrate() gives for rows of (score, accepted), however many: running counts within ranges of scores, to
    which the counts of the ranges before are added."""
    each = scores.groupBy("score").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    ranges = scratch.cut(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = sorted(ranges.groupBy("part").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda p: p.low)
    good, bad = sum(p.good for p in parts), sum(p.bad for p in parts)
    if not good or not bad:
        return 0.0
    before, rows = (None, 0, 0), []
    for p in parts:
        rows.append((p.part, *before))
        before = (p.high, before[1] + p.good, before[2] + p.bad)
    earlier = F.broadcast(scores.sparkSession.createDataFrame(rows, "part int, top double, lost bigint, kept_out bigint"))
    own = Window.partitionBy("part").orderBy("score")
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    cuts = ranges.join(earlier, "part").select(
        "score", F.coalesce(F.lag("score").over(own), "top").alias("last"),
        (F.col("lost") + F.coalesce(F.sum("good").over(upto), F.lit(0))).alias("lost"), (F.col("kept_out") + F.coalesce(F.sum("bad").over(upto), F.lit(0))).alias("kept_out"),
    )
    # Whole numbers in place of the recalls' mean, so that equal cuts are equal; of these the least score counts.
    worth = (F.lit(good) - F.col("lost")).cast("decimal(19,0)") * F.lit(bad).cast("decimal(19,0)") + F.col("kept_out").cast("decimal(19,0)") * F.lit(good).cast("decimal(19,0)")
    best = cuts.select(F.max_by(F.struct("score", "last", worth.alias("worth")), F.struct(worth, -F.col("score"))).alias("x")).first().x
    if best.worth < good * bad:  # to keep all out
        return before[0] + 1e-9
    return best.score - 1e-9 if best.last is None else (best.last + best.score) / 2


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = 6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: id, host, path, rule, verdict, score (null where a rule decided). Null urls count as empty. The
    models count all distinct URLs that the rules decide but for a quarter, by hash, on which the threshold is
    calibrated. Without any URLs both models are uniform and every URL is allowed at threshold 0."""
    scratch = Scratch(pages.sparkSession, "url_filter")
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    distinct = given.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.max(F.col("url").isNotNull()).alias("known"))
    decided = F.col("known") & F.col("rule_verdict").isNotNull()
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    urls = scratch.cut(apply_rules(distinct, rules).select("url", "rule_verdict", decided.alias("decided"), (decided & held).alias("held")))
    counts = context_counts(urls.where("decided and not held"), order)
    scored = scratch.cut(url_scores(urls.where("held or rule_verdict is null").select("url", "rule_verdict", "held"), counts, scratch, order))
    threshold = calibrated(scored.where("held").select("score", (F.col("rule_verdict") == "allow").alias("accepted")), scratch)
    ruled = apply_rules(given, rules)
    open_ = ruled.where("rule_verdict is null").withColumn("url", F.coalesce("url", F.lit("")))
    judged = open_.join(dealt_anew(scored.where("rule_verdict is null").select("url", "score"), "url"), "url", "left")
    out = judged.select("page_id", "host", "path", "rule", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    return ruled.where("rule_verdict is not null").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(out)
