"""Exact top-k search by inner product over integer vectors.

Candidates are cut into strips of like length, longest first, and queries into groups, both of bounded size; a cell holds
one group and one strip. The first strips meet all queries. A query's k-th best score from there, over its own length, is
the least length that can still matter to it: it goes on to the strips that reach that length, and carries the score along,
so that their cells return what beats it and nothing else. The best of all cells meet in a last window.

Within a cell candidates are taken in blocks by descending length. Lengths alone bound what a query can still reach, so a
query stops at the first block that cannot reach its k-th best score so far. Both sides are rotated by the candidates'
right singular vectors, which gathers most of the product in the first dimensions. Sums grow by stages of the dimensions:
after each, a pair goes on only if its partial sum plus the Cauchy-Schwarz bound of the rest, the product of the residual
lengths, reaches the k-th best. While most pairs of a block are left their next terms come from one matrix product, after
that from a gather for the pairs alone. What passes the last bound is scored exactly in integers. The bounds are in floating
point and have a slack above their rounding error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: Most candidates and queries of a cell, on average; rows of a strip below which more strips do not pay.
CELL_CANDIDATES, CELL_QUERIES, LEAST_STRIP = 65_536, 32_768, 2_048
#: Classes of length in which a squared length doubles.
CLASSES = 8
#: Shares of the dimensions after which the residual bound is tested.
STAGES = (0.25, 0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375)
#: Share of a block's pairs under which their sums are continued one by one.
GATHERED = 0.05
_NONE = np.iinfo(np.int64).min


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as double; null for vectors that are null or hold null or non-finite ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each q: highest score, ties to the smaller id; sorted by q and rank."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    keep = rank < k
    return q[keep], score[keep], ids[keep]


def _staged(q: np.ndarray, c: np.ndarray, q_rest: list[np.ndarray], c_rest: list[np.ndarray], ends: list[int], needed: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of q, row of c) whose partial sum and bound of the rest reach what the row of q needs after every
    stage; their numbers are added to `alive`, that of all pairs first."""
    alive[0] += len(q) * len(c)
    keep, sums, start = np.ones((len(q), len(c)), bool), np.zeros((len(q), len(c))), 0
    i = j = None
    for s, end in enumerate(ends):
        if i is None:
            sums += q[:, start:end] @ c[:, start:end].T
            keep &= sums + np.outer(q_rest[s], c_rest[s]) >= needed[:, None]
            left = int(np.count_nonzero(keep))
            if left <= GATHERED * keep.size:
                i, j = np.nonzero(keep)
                sums = sums[i, j]
        else:
            for at in range(0, len(i), 65536):
                own = slice(at, at + 65536)
                sums[own] += np.einsum("ij,ij->i", q[i[own], start:end], c[j[own], start:end])
            good = sums + q_rest[s][i] * c_rest[s][j] >= needed[i]
            i, j, sums = i[good], j[good], sums[good]
            left = len(i)
        alive[s + 1] += left
        start = end
    return np.nonzero(keep) if i is None else (i, j)


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, block: int = 2048, passed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, score, candidate id) of the k best candidates of each query, its own id left out; with `least`, of
    those whose score is no less. `passed` gets the numbers of pairs: all, those that the lengths leave, and those left
    after each stage."""
    none = np.zeros(0, np.int64)
    if not len(queries) or not len(candidates):
        return none, none, none
    length = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    candidates, ids, length = candidates[order], ids[order], length[order]
    c, q = candidates.astype(np.float64), queries.astype(np.float64)
    rotation = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    c, q = c @ rotation, q @ rotation
    ends = sorted({max(1, round(c.shape[1] * share)) for share in STAGES})
    c_rest, q_rest = ([np.sqrt((x[:, end:] ** 2).sum(axis=1)) for end in ends] for x in (c, q))
    alive = np.zeros(len(ends) + 2, np.int64)
    alive[0] = len(q) * len(c)
    q_length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    reach = np.full(len(q), _NONE) if least is None else least.copy()
    found = (none, none, none)
    live = np.arange(len(q))
    at, step = 0, min(block, max(4 * k, 128))
    while at < len(c) and len(live):
        cut = slice(at, at + step)
        slack = 1e-7 * (1.0 + q_length * length[at])
        live = live[q_length[live] * length[at] >= reach[live] - slack[live]]
        new = [found]
        for part in np.array_split(live, max(1, len(live) // 1024)):
            i, j = _staged(q[part], c[cut], [x[part] for x in q_rest], [x[cut] for x in c_rest], ends, reach[part] - slack[part], alive[1:])
            i, j = part[i], j + at
            other = query_ids[i] != ids[j]
            i, j = i[other], j[other]
            score = np.concatenate([np.einsum("ij,ij->i", queries[i[s : s + 65536]], candidates[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [none])
            good = score >= reach[i]
            new.append(_best(i[good], score[good], ids[j[good]], k))
        found = _best(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
        count = np.bincount(found[0], minlength=len(q))
        last = np.cumsum(count) - 1
        full = count == k
        reach[full] = np.maximum(reach[full], found[1][last[full]])
        at, step = at + step, block
    if passed is not None:
        passed[:] = alive.tolist()
    return found


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end and lengths of a list column."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            (qv, ql), (cv, cl) = _matrix(left["vector"]), _matrix(right["c_vector"])
            rows, q_ids, least, c_ids = (t[n].to_numpy() for t, n in ((left, "row"), (left, "vec_id"), (left, "least"), (right, "c_id")))
            for size in np.intersect1d(ql, cl):
                if size:
                    a, b = ql == size, cl == size
                    q = qv[np.repeat(a, ql)].reshape(-1, size)
                    number, score, ids = search(q, q_ids[a], cv[np.repeat(b, cl)].reshape(-1, size), c_ids[b], k, least[a])
                    parts.append((rows[a][number], q_ids[a][number], ids, score))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["row", "query_id", "vec_id", "score"])

    return run


def strips_of(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(lowest class, highest class, parts) of the strips, longest vectors first: neighbouring classes together while they
    hold `most` rows or fewer, a larger class alone and dealt by hash to parts of about that size."""
    out: list[list[int]] = []
    held = 0
    for c in sorted(counts, reverse=True):
        if out and held + counts[c] <= most:
            out[-1][0] = c
            held += counts[c]
        else:
            out.append([c, c, -(-counts[c] // most)])
            held = counts[c]
    return [tuple(x) for x in out]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per query and rank: query_id, rank (from 1), vec_id, score; all candidates of a query that has fewer than k.

    is_query picks queries by id_col. Every valid row is a candidate, but rows with the query's own id. Rows with a null
    id or an invalid vector take no part; vectors of different lengths don't meet, empty ones don't either. Repeated
    query rows are answered each, repeated candidates are listed each; other columns are not read. Squared lengths must
    fit 63 bits."""
    spark = vectors.sparkSession
    squared = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    class_of = lambda square: F.least(F.lit(63 * CLASSES), F.floor(F.log2(square + 1) * CLASSES)).cast("int")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), integer_vector(F.col(vector_col), scale).alias("vector"), is_query.alias("asks"), F.monotonically_increasing_id().alias("row")).where("vec_id is not null and vector is not null")
    # Written once: both sides of the search must see one number for each row, however often the input is read.
    scratch = Scratch(spark, "topk")
    rows = scratch.cut(rows.withColumn("square", squared).withColumn("class", class_of(F.col("square"))))
    # At most 63 * CLASSES + 1 rows.
    classes = {r["class"]: (r.n, r.asked) for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).collect()}
    n, asked = (sum(c[i] for c in classes.values()) for i in (0, 1))
    tasks = 2 * spark.sparkContext.defaultParallelism
    base, parts, reached = ([0] * (63 * CLASSES + 1) for _ in range(3))
    strips = lead = held = 0
    enough = 4 * (k + 1)
    for low, high, count in strips_of({c: x[0] for c, x in classes.items()}, min(CELL_CANDIDATES, max(LEAST_STRIP, -(-n // tasks)))):
        size = sum(x[0] for c, x in classes.items() if low <= c <= high)
        if held < enough:  # the first strips: as many as can answer a query, one part of a class that is cut
            lead = strips + (1 if size // count >= enough else count)
        held += size
        for c in range(low, high + 1):
            base[c], parts[c] = strips, count
        strips += count
        for c in range(high + 1):  # whoever needs class c meets the strips up to the last that holds c or more
            reached[c] = strips
    of_class = lambda table, c: F.element_at(F.array(*map(F.lit, table)), c + 1)
    c = F.col("class")
    strip = (of_class(base, c) + F.pmod(F.xxhash64("row"), of_class(parts, c))).cast("int")
    asks = rows.where("asks").select("row", "vec_id", "vector", "square")
    have = rows.select("vec_id", "vector", "row", strip.alias("h"))
    kind = "row bigint, query_id bigint, vec_id bigint, score bigint"
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    def met(queries: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
        queries = queries.select("row", F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"), "least", "h", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"))
        candidates = candidates.select(F.col("vec_id").alias("c_id"), F.col("vector").alias("c_vector"), F.col("h").alias("h"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"))
        return queries.groupBy("g", "h").cogroup(candidates.groupBy("g", "h")).applyInArrow(_cell(k), kind)

    every = lambda first, last: F.explode(F.sequence(first, last)).alias("h")
    groups = max(1, -(-asked // CELL_QUERIES))
    first = asks.withColumn("least", F.lit(_NONE)).select("*", every(F.lit(0), F.lit(max(0, lead - 1))))
    best = ranked(met(first, have.where(F.col("h") < lead), max(groups, min(tasks // max(1, lead), asked // 256))))
    if strips > lead:
        best = scratch.cut(best.drop("rank"))
        least = best.groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("least")).where("least is not null")
        least = asks.join(least, "row", "left")
        # Above score 0, a candidate needs the length score / |q|; a little less, for rounding.
        needed = F.when((F.col("least") > 0) & (F.col("square") > 0), class_of(F.col("least").cast("double") ** 2 / F.col("square") * (1 - 1e-6)))
        last = of_class(reached, F.coalesce(needed, F.lit(0)))
        going = least.withColumn("last", last).where(F.col("last") > lead).withColumn("least", F.coalesce("least", F.lit(_NONE))).select("*", every(F.lit(lead), F.col("last") - 1))
        best = ranked(best.unionByName(met(going, have.where(F.col("h") >= lead), groups)))
    return best.select("query_id", "rank", "vec_id", "score")
