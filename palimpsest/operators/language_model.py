"""Character language models: interpolated modified Kneser-Ney over n-gram tables.

A line is a sequence of characters between a begin and an end mark. The n-grams of the highest order, and those that begin a
line, count as often as they occur; the others count the different characters that stand before them, which is the number of
n-grams one longer that end with them. Each order has three discounts, for n-grams that count once, twice and more often, from
how many n-grams count once to four times. What discounts take from a context is dealt to the next lower order, whose
probabilities are joined by the n-gram without its first character. Every step is a grouping or an equi-join of n-gram tables;
what comes to the driver is a row of counts for each order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import SPACE_TOKEN
from palimpsest.session import written

#: Characters that stand for an unknown character, the begin and the end of a line; texts must not hold them, so they are
#: taken out of lines. As tokens they have names; fixed values.
UNKNOWN, BEGIN, END = "\x01", "\x02", "\x03"
TOKENS = {UNKNOWN: "<unk>", BEGIN: "<s>", END: "</s>", " ": SPACE_TOKEN}
#: Characters that are counted at a time.
PIECE = 500_000
#: Discounts where counts are too few to tell; fixed values.
FALLBACK = (0.5, 1.0, 1.5)
#: Logarithm of the begin mark's probability, which nothing asks for; fixed value.
NEVER = -99.0


def marked(text: str) -> str:
    """A stripped line between its marks; empty for a blank one."""
    if UNKNOWN in text or BEGIN in text or END in text:
        text = text.translate(_NO_MARKS)
    text = text.strip()
    return text and BEGIN + text + END


_NO_MARKS = dict.fromkeys(map(ord, (UNKNOWN, BEGIN, END)))


class _Counts:
    """Counts of the n-grams of one order in marked lines, and of the shorter beginnings of lines, each a whole number of its
    characters' own numbers from 1 up, sorted piece by piece; where there are more different characters than such a number has
    room for, they are counted as texts."""

    def __init__(self, order: int):
        self.order, self.bits = order, 63 // order
        self.number, self.symbols = np.zeros(0x110000, np.uint32), np.zeros(0, np.uint32)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.texts: Counter = Counter()
        self.waiting: list[str] = []
        self.chars = 0

    def add(self, *lines: str) -> None:
        self.waiting += lines
        self.chars += sum(map(len, lines))
        if self.chars >= PIECE:
            self.count()

    def count(self) -> None:
        lines, self.waiting, self.chars = self.waiting, [], 0
        if not lines:
            return
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        size = -(-len(points) // max(1, len(points) // PIECE))
        for at in range(0, len(points), size):  # what begins here; a line may be longer than a piece
            own = points[at : at + size + self.order - 1]
            whole = np.ones(min(size, len(points) - at), bool)
            near = slice(*np.searchsorted(ends, [at + 1, at + len(own) + 1]))
            for k in range(1, self.order):
                last = (ends[near] - k)[sizes[near] >= k] - at
                whole[last[(last >= 0) & (last < len(whole))]] = False
            begins = slice(*np.searchsorted(ends - sizes, [at, at + len(whole)]))
            self._count(own, whole, (ends - sizes)[begins] - at, sizes[begins])

    def _count(self, points: np.ndarray, whole: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        """Counts of the n-grams from where `whole` says, and of the beginnings of lines."""
        own = self.number[points]
        new = np.unique(points[own == 0])
        if len(new) + len(self.symbols) >= 1 << self.bits:
            text = points.tobytes().decode("utf-32-le")
            self.texts.update(text[i : i + self.order] for i in np.flatnonzero(whole).tolist())
            self.texts.update(text[i : i + k] for i, n in zip(begins.tolist(), sizes.tolist(), strict=True) for k in range(2, min(self.order - 1, n) + 1))
            return
        if len(new):
            self.number[new] = np.arange(len(new)) + len(self.symbols) + 1
            self.symbols = np.concatenate([self.symbols, new])
            own = self.number[points]
        # up to 32 bits hold an n-gram of few different characters, which sorts faster; they are spread after that
        bits, kind = (32 // self.order, np.uint32) if len(self.symbols) < 1 << 32 // self.order else (self.bits, np.int64)
        own = own.astype(kind, copy=False)
        n = min(len(whole), len(points) - self.order + 1)
        found = []
        if n > 0:
            gram = own[:n].copy()
            for k in range(1, self.order):
                gram <<= bits
                gram |= own[k : n + k]
            found.append(gram[whole[:n]])
        gram = own[begins]
        for k in range(1, self.order - 1):
            longer = sizes > k
            begins, sizes = begins[longer], sizes[longer]
            gram = gram[longer] << bits | own[begins + k]
            found.append(gram)
        if found:
            grams, counts = np.unique(np.concatenate(found), return_counts=True)
            if bits < self.bits:
                spread = np.zeros(len(grams), np.int64)
                for k in range(self.order - 1, -1, -1):
                    spread = spread << self.bits | (grams >> bits * k & ((1 << bits) - 1))
                grams = spread
            self.found.append((grams.astype(np.int64, copy=False), counts))

    def size(self) -> int:
        return len(self.texts) + sum(len(g) for g, _ in self.found)

    def merge(self) -> None:
        self.count()
        if len(self.found) > 1:
            grams, at = np.unique(np.concatenate([g for g, _ in self.found]), return_inverse=True)
            self.found = [(grams, np.bincount(at, np.concatenate([c for _, c in self.found])).astype(np.int64))]

    def rows(self) -> tuple[list[str], list[int]]:
        """All n-grams and their counts."""
        self.merge()
        grams, counts = list(self.texts), list(self.texts.values())
        for own, n in self.found:
            shifts = self.bits * np.arange(self.order - 1, -1, -1)
            numbers = own[:, None] >> shifts & ((1 << self.bits) - 1)
            text = self.symbols[numbers[numbers > 0] - 1].astype("<u4").tobytes().decode("utf-32-le")
            ends = np.cumsum((numbers > 0).sum(axis=1)).tolist()
            grams += [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            counts += n.tolist()
        return grams, counts


def _pieces(lines: list[str]) -> Iterator[list[str]]:
    """Lines in runs of about PIECE characters."""
    at = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))) // PIECE
    for i, j in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(lines)]):
        yield lines[i:j]


def _grams(lines: DataFrame, order: int, *by: str, text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(by..., gram, count) of marked lines: of each character and end mark the n-gram of the order that ends with it, or all that stands
    before it where that is less. A task holds up to about `most` different ones at a time, and those of one piece."""
    lines = lines.select(*by, F.col(text_col).cast("string").alias("gram")).where("gram is not null")
    schema = lines.select(*by, "gram", F.lit(0).cast("bigint").alias("count")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, _Counts] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, own in found.items():
                grams, counts = own.rows()
                values = [*[[v] * len(grams) for v in key], grams, counts]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], schema.names)
            found.clear()

        def full() -> bool:
            if sum(own.size() for own in found.values()) <= most:
                return False
            for own in found.values():
                own.merge()
            return sum(own.size() for own in found.values()) > most // 2

        for batch in batches:
            *keys, own = batch.columns
            kinds = [*[k.type for k in keys], pa.string(), pa.int64()]
            keys, own = [k.to_pylist() for k in keys], own.to_numpy(zero_copy_only=False).tolist()
            rows: dict[tuple, list[str]] = defaultdict(list)
            for key, t in zip(zip(*keys, strict=True) if keys else [()] * len(own), map(marked, own), strict=True):
                if t:
                    rows[key].append(t)
            for key, piece in ((key, piece) for key, own in rows.items() for piece in _pieces(own)):
                if key not in found:
                    found[key] = _Counts(order)
                found[key].add(*piece)
                if not found[key].chars and full():
                    yield from out()
        yield from out()

    return lines.mapInArrow(run, schema).where(F.col("gram") != BEGIN).groupBy(*by, "gram").agg(F.sum("count").alias("count"))


def adjusted_counts(lines: DataFrame, order: int = 5, text_col: str = "text") -> DataFrame:
    """(n, gram, count): occurrences of n-grams of the highest order and of those that begin with the begin mark, for others
    the number of different characters before them. The begin mark alone is not among them."""
    size = F.length("gram")
    raw = written(_grams(lines, order, text_col=text_col).withColumn("n", size), "grams", "n")
    level = raw.where(F.col("n") == order).select("gram", "count")
    levels = [level]
    for n in range(order - 1, 0, -1):
        ends = level.groupBy(F.substring("gram", F.lit(2), F.lit(n)).alias("gram")).agg(F.count("*").alias("count"))
        level = ends.unionByName(raw.where(F.col("n") == n).select("gram", "count"))
        levels.append(level)
    out = levels[0].withColumn("n", F.lit(order))
    for n, own in zip(range(order - 1, 0, -1), levels[1:], strict=True):
        out = out.unionByName(own.withColumn("n", F.lit(n)))
    return out.select("n", "gram", "count")


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of each order of (n, gram, count): FALLBACK for an order in which no n-gram counts one, two or
    three, or where a discount is negative or more than the count."""
    out = {}
    for r in counts.groupBy("n").agg(*[F.count_if(F.col("count") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).collect():
        own = FALLBACK
        if r.t1 and r.t2 and r.t3:
            share = r.t1 / (r.t1 + 2 * r.t2)
            found = tuple(k - (k + 1) * share * after / t for k, (t, after) in enumerate([(r.t1, r.t2), (r.t2, r.t3), (r.t3, r.t4)], 1))
            own = found if all(0 <= d <= k for k, d in enumerate(found, 1)) else FALLBACK
        out[r.n] = own
    return out


def kneser_ney(counts: DataFrame, order: int = 5) -> DataFrame:
    """(n, gram, logp, backoff) from (n, gram, count): logarithms to the base 10 of each n-gram's probability of its last
    character after the others, and of the share that a context leaves to shorter ones (null where nothing follows). The
    begin mark and the unknown character have a row; the unknown one gets what the unigrams leave, an equal share with each
    of them."""
    spark = counts.sparkSession
    counts = written(counts, "counts", "n")
    cuts = discounts(counts)
    by_count = lambda n: F.when(F.col("count") == 1, cuts[n][0]).when(F.col("count") == 2, cuts[n][1]).otherwise(cuts[n][2])
    taken = lambda n: sum((F.count_if(c) * F.lit(d) for c, d in zip((F.col("count") == 1, F.col("count") == 2, F.col("count") > 2), cuts[n], strict=True)), F.lit(0.0))
    if not cuts:
        return spark.createDataFrame([], "n int, gram string, logp double, backoff double")
    total, left, size = counts.where("n = 1").agg(F.sum("count"), taken(1), F.count("*")).first()
    even = left / total / (size + 1)
    level = counts.where("n = 1").select("gram", ((F.col("count") - by_count(1)) / total + even).alias("p"))
    level = level.unionByName(spark.createDataFrame([(UNKNOWN, even), (BEGIN, 10.0**NEVER)], "gram string, p double"))
    out = None
    for n in range(2, order + 2):
        after = None
        if n <= order:
            own = counts.where(F.col("n") == n).select("gram", "count", F.left("gram", F.lit(n - 1)).alias("context"), F.substring("gram", F.lit(2), F.lit(n - 1)).alias("shorter"))
            sums = own.groupBy("context").agg((taken(n) / F.sum("count")).alias("share"), F.sum("count").alias("total"))
            rated = own.join(sums, "context").join(level.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
            after = written(rated.select("gram", ((F.col("count") - by_count(n)) / F.col("total") + F.col("share") * F.col("below")).alias("p"), "context", "share"), f"order{n}")
            level = level.join(after.select(F.col("context").alias("gram"), "share").distinct(), "gram", "left")
        else:
            level = level.withColumn("share", F.lit(None).cast("double"))
        rows = level.select(F.lit(n - 1).alias("n"), "gram", F.log10("p").alias("logp"), F.log10("share").alias("backoff"))
        out = rows if out is None else out.unionByName(rows)
        level = after.select("gram", "p") if after is not None else None
    return out


def tokens(gram: Column) -> Column:
    """An n-gram as tokens separated by spaces."""
    named = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv]), c), c)
    return F.array_join(F.transform(F.filter(F.split(gram, ""), lambda c: c != ""), named), " ")


def perplexity(lines: DataFrame, model: DataFrame, *by: str, order: int = 5, text_col: str = "text") -> DataFrame:
    """(by..., chars, unknown, logp, perplexity) of lines under a model (n, gram, logp, backoff): end marks count as
    characters. Each position asks for its longest n-gram that the model has, at the price of the contexts' backoffs; equal
    positions are counted first, so what meets the model is a table of different n-grams."""
    never = model.where((F.col("n") == 1) & (F.col("gram") == UNKNOWN)).first()
    seen = written(_grams(lines, order, *by, text_col=text_col), "seen")
    sizes = F.sequence(F.lit(1), F.length("gram"))
    asked = seen.select("gram").distinct().select("gram", F.explode(sizes).alias("k")).withColumn("own", F.right("gram", F.col("k")))
    asks = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("own").alias("key")), F.struct(F.lit(False).alias("whole"), F.expr("left(own, k - 1)").alias("key"))))
    keyed = asked.select("gram", "k", asks.alias("a")).select("gram", "k", "a.*").where("key <> ''")
    met = keyed.join(model.select(F.col("gram").alias("key"), "logp", "backoff"), "key")
    parts = F.sort_array(F.collect_list(F.struct("k", "whole", "logp", "backoff")))
    best = lambda p: F.array_max(F.transform(F.filter(p, lambda x: x["whole"]), lambda x: x["k"]))
    found = met.groupBy("gram").agg(parts.alias("p")).withColumn("best", F.coalesce(best(F.col("p")), F.lit(0)))
    price = F.aggregate(F.filter("p", lambda x: ~x["whole"] & (x["k"] > F.col("best"))), F.lit(0.0), lambda s, x: s + F.coalesce(x["backoff"], F.lit(0.0)))
    own = F.aggregate(F.filter("p", lambda x: x["whole"] & (x["k"] == F.col("best"))), F.lit(None).cast("double"), lambda s, x: x["logp"])
    rated = seen.join(found.select("gram", price.alias("price"), own.alias("own")), "gram", "left")
    logp = F.coalesce("price", F.lit(0.0)) + F.coalesce("own", F.lit(never.logp if never else None).cast("double"))
    summed = rated.groupBy(*by).agg(F.sum("count").alias("chars"), F.sum(F.when(F.col("own").isNull(), F.col("count")).otherwise(0)).alias("unknown"), F.sum(F.col("count") * logp).alias("logp"))
    return summed.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("logp") / F.col("chars")))
