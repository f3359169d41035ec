"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

A document is the weighted set of its shingles of five words, the weight being how often each occurs. Darts hit the
plane over each shingle: along the weight axis, cut into the regions [0,1), [1,2), [2,4), [4,8) ..., darts arrive in
the order of their rank at unit rate per unit of weight, at hashed ranks and hashed weights that depend on the shingle,
the region and the dart's number alone. A document keeps the darts under its weights up to the rank at which about
k (ln k + 4) have been thrown, deals them to k coordinates by another hash and keeps the earliest of each; should a
coordinate stay empty, the document goes on to twice the rank. Two documents agree on a coordinate with the probability
of their weighted Jaccard similarity, and the work is the number of shingles plus the number of darts
(Christiani 2020).

Texts with equal word sequences are one node from the start. `rows` coordinates make a band; nodes that share a band
are candidates, and a candidate link counts if the exact weighted Jaccard similarity reaches the threshold. A pair at
similarity 0.8 shares some band with probability 1 - (1 - 0.8**6)**32 = 0.99994. Classes are connected components, so
pairs within a component need no comparison. In each bucket all members first meet its most central one, which shares
most buckets with others; then, as long as that shrinks them by a tenth, the members outside that one's component meet
the most central of their own. In these rounds pairs whose sizes or two-bit sketches rule the threshold out are dropped
within the joins. Nodes whose buckets still hold several components are compared by prefixes of their shingles in the end,
rare ones first, which misses no link between them and forms few pairs even where thousands share long passages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, dealt_anew, free_name, hash_words, mix64, ragged, shingle_hashes, slices, unit

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6

_U = np.uint64


def weighted_shingles(words: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and how often each occurs. A text of fewer than n words is one shingle."""
    h = shingle_hashes(words, n) if len(words) >= n else shingle_hashes(words, len(words))[:1] if len(words) else words
    return np.unique(h, return_counts=True)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Signatures (sets x k, uint64) of weighted sets given end to end; all sets must have positive total weight.
    Weights are best scaled so that the typical one is about 1: smaller ones waste darts, but stay exact."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    total = np.add.reduceat(weights, offsets[:-1]) if n else np.zeros(0)
    out = np.zeros((n, k), np.uint64)
    want = k * (np.log(k) + 4.0) / total if n else total
    todo = np.arange(n)
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        pick = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in todo])
        element, weight, limit = elements[pick], weights[pick], want[todo][owner]
        best = np.full(len(todo) * k, np.inf)
        keys, ranks, darts = [], [], []
        low, width, region = 0.0, 1.0, 0
        while True:
            inside = weight > low
            if not inside.any():
                break
            own, w, lim, at = mix64(element[inside] ^ _U(region * 0x51ED2701)), weight[inside], limit[inside], owner[inside]
            rank, number = np.zeros(len(own)), 0
            while len(own):
                h = mix64(own + _U(number))
                rank = rank - np.log(unit(h)) / width
                live = rank <= lim
                own, w, lim, at, rank, h = own[live], w[live], lim[live], at[live], rank[live], h[live]
                dart = mix64(h ^ _U(0xA5A5A5A5))
                under = low + width * unit(mix64(dart ^ _U(0x3C3C3C3C))) < w
                key = at[under] * k + (dart[under] % _U(k)).astype(np.int64)
                keys.append(key)
                ranks.append(rank[under])
                darts.append(dart[under])
                number += 1
            low, width, region = low + width, (width if region == 0 else width * 2), region + 1
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        signature = np.zeros(len(todo) * k, np.uint64)
        signature[key[first]] = dart[first]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        out[todo[full]] = signature.reshape(-1, k)[full]
        todo = todo[~full]
        want[todo] *= 2
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted weighted sets."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 1.0


def _offsets(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, f1, f2, n, keys, sketch) per document: a 128-bit hash of its words (of the text, if it has none), how
    many shingles, a hash for each band and two bits of each coordinate; f1 is null for null and empty texts, keys and
    sketch are empty for texts without words. bands * rows must be a multiple of 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, rows=256, chars=2_000_000):
                texts = batch.column(1).to_pylist()
                words, o = hash_words(texts)
                f1, f2, n, sets, have = [], [], [], [], []
                for i, text in enumerate(texts):
                    own = words[o[i] : o[i + 1]]
                    digest = xxhash.xxh3_128_digest(own.tobytes() if len(own) else b"text:" + (text or "").encode())
                    f1.append(int.from_bytes(digest[:8], "little", signed=True) if text else None)
                    f2.append(int.from_bytes(digest[8:], "little", signed=True))
                    n.append(max(1, len(own) - SHINGLE + 1) if len(own) else 0)
                    if len(own):
                        have.append(i)
                        sets.append(weighted_shingles(own))
                keys, sketch = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), bands * rows // 32), np.int64)
                if sets:
                    signature = dart_signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(np.float64), _offsets([len(s[0]) for s in sets]), bands * rows)
                    band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
                    h = mix64(band.copy())
                    for r in range(rows):
                        h = mix64(h ^ signature[:, r::rows][:, :bands])
                    keys = h.view(np.int64)
                    sketch = _pack(signature)
                counts = np.zeros(len(texts), np.int64)
                counts[have] = 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int32()), ragged(keys.ravel(), counts * bands, pa.int64()), ragged(sketch.ravel(), counts * sketch.shape[1], pa.int64())], ["doc_id", "f1", "f2", "n", "keys", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(run, "doc_id bigint, f1 bigint, f2 bigint, n int, keys array<bigint>, sketch array<bigint>")


def _shingle_table(texts: DataFrame) -> DataFrame:
    """(node, shingles, counts) from (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", rows=256, chars=2_000_000):
                words, o = hash_words(batch.column(1).to_pylist())
                sets = [weighted_shingles(words[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)]
                sizes = np.array([len(s[0]) for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0), ragged(np.concatenate([s[0] for s in sets]).view(np.int64), sizes, pa.int64()), ragged(np.concatenate([s[1] for s in sets]).astype(np.int32), sizes, pa.int32())], ["node", "shingles", "counts"])

    return texts.mapInArrow(run, "node bigint, shingles array<bigint>, counts array<int>")


def _similar(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ra, rb) whose exact weighted Jaccard similarity reaches the threshold."""
    left, right = (shingles.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for x in (4, 6):
                column = batch.column(x)
                o = column.offsets.to_numpy()
                s, c = column.values.to_numpy().view(np.uint64), batch.column(x + 1).values.to_numpy()
                sets.append([(s[i:j], c[i:j]) for i, j in zip(o[:-1], o[1:], strict=True)])
            keep = np.array([weighted_jaccard(x, y) >= threshold for x, y in zip(*sets, strict=True)], bool)
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ra", "rb", "sa", "ca", "sb", "cb")
    return joined.mapInArrow(run, "a bigint, b bigint, ra bigint, rb bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node that has an edge, as a table of scratch.
    Each round, nodes take the smallest root among their neighbours' and, if that changes any, their root's root. Edges,
    roots and steps are written, so that no plan holds another round's or the edges' own, all of which the driver would
    keep and plan again while it runs, and so that what a node or root of many neighbours meets can be split."""
    edges = scratch.cut(edges.select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    over = [edges]
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = scratch.cut(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        over.append(step)
        if step.where("root <> old").isEmpty():
            scratch.drop(*over)
            return roots
        jump = step.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("top"))
        over.append(roots)
        roots = scratch.cut(step.join(jump, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _pack(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a 64-bit integer."""
    two = (signature >> _U(62)).reshape(len(signature), -1, 32) << (_U(2) * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(two, axis=2).view(np.int64)


def _may_agree(name: str, threshold: float, coordinates: int) -> Column:
    """Whether the sketches of x and y leave the threshold possible. Two bits of each coordinate agree with probability
    J + (1 - J) / 4; pairs four standard deviations below what the threshold makes expect are left out."""
    agree = threshold + (1 - threshold) / 4
    least = agree * coordinates - 4 * math.sqrt(agree * (1 - agree) * coordinates)
    pairs_of_bits = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for i in range(coordinates // 32):
        d = F.col(f"x.{name}")[i].bitwiseXOR(F.col(f"y.{name}")[i])
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(pairs_of_bits))
    return differ <= coordinates - least


def prefix_pairs(nodes: DataFrame, shingles: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, ra, rb): every pair of nodes (node, root, n) of different roots that can reach the threshold.

    All nodes order their shingles alike, rare ones first. With n counting repeats, a similarity of t asks for t n common
    ones, so a similar pair has a common shingle among the first n - t n + 1 of both. Shingles that only one root has
    come before all others and meet nothing; what text many nodes share comes last and is not looked at. At the first
    common shingle what is left of either node bounds what both have in common. A shingle's nodes of its most
    frequent root do not meet each other."""
    base = scratch.cut(nodes.join(shingles, "node"))
    tokens = base.select("node", "root", "n", F.explode(F.arrays_zip("shingles", "counts")).alias("s")).select("node", "root", "n", F.col("s.shingles").alias("token"), F.col("s.counts").alias("weight"))
    by_root = tokens.groupBy("token", "root").agg(F.count("*").alias("nodes"))
    stats = by_root.groupBy("token").agg(F.sum("nodes").alias("df"), F.max_by("root", F.struct("nodes", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    met = tokens.join(dealt_anew(stats, "token"), "token")
    own = Window.partitionBy("node")
    before = F.col("n") - F.sum("weight").over(own) + F.coalesce(F.sum("weight").over(own.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = lambda n: F.ceil(n * threshold - 1e-9)
    prefix = scratch.cut(met.withColumn("before", before).where(F.col("before") <= F.col("n") - least(F.col("n"))).select("token", "node", "root", "n", "before", (F.col("root") != F.col("top")).alias("minor")))
    x, y = prefix.alias("x"), prefix.where("minor").alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & (~F.col("x.minor") | (F.col("x.node") < F.col("y.node"))) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9)
    meets = meets & (F.least(F.col("x.n") - F.col("x.before"), F.col("y.n") - F.col("y.before")) >= (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9)
    pairs = scratch.cut(_ends(x.join(y, meets)))
    scratch.drop(base, prefix)
    return pairs


def _ends(met: DataFrame) -> DataFrame:
    """Distinct (a, b, ra, rb) of rows of x and y, a being the smaller node."""
    ends = F.array_sort(F.array(F.struct("x.node", "x.root"), F.struct("y.node", "y.root")))
    return met.select(ends.alias("e")).select(*[F.col("e")[i][c].alias(n) for i, c, n in ((0, "node", "a"), (1, "node", "b"), (0, "root", "ra"), (1, "root", "rb"))]).distinct()


def linked_roots(nodes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, coordinates: int = BANDS * ROWS) -> DataFrame:
    """(node, root) for nodes (node, n, keys, sketch) that share a bucket: the smallest node that verified links lead to.
    texts has (node, text) for every node. Components are found on the graph of components so far, of which each round
    adds links."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    keys = scratch.hold(dealt_anew(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"))
    shared = scratch.hold(rows.join(keys, "key"))
    central = scratch.cut(shared.groupBy("node").agg(F.sum("members").alias("central")))
    members = scratch.cut(shared.select("key", "node").join(nodes.select("node", "n", "sketch").join(central, "node"), "node"))
    scratch.release()
    shingles = scratch.cut(_shingle_table(texts.join(central.select("node"), "node").select("node", "text")))
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9) & _may_agree("sketch", threshold, coordinates)
    roots = central.select("node", F.col("node").alias("root"))
    state, known, tried, over = members.withColumn("root", F.col("node")), members, [], []
    before = math.inf
    while True:
        heads = state.groupBy("key").agg(F.max_by("root", F.struct("central", "node")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "head")
        heads = scratch.hold(dealt_anew(heads, "key"))
        # Minor are members outside the component of their bucket's most central member; at first none is known.
        minor = F.col("root") != F.col("head") if tried else F.lit(True)
        state = scratch.cut(state.join(heads, "key").withColumn("minor", minor).drop("head"))
        scratch.release()
        scratch.drop(known)
        known = state
        count = state.where("minor").count()
        if not count:
            break
        last = count > 0.9 * before
        if last:
            pairs = prefix_pairs(state.select("node", "root", "n").distinct(), shingles, scratch, threshold)
        else:
            picked = state.where("minor").groupBy("key").agg(F.max_by(F.struct("node", "n", "sketch", "root"), F.struct("central", "node")).alias("p")).select("key", "p.*")
            leaders = scratch.hold(dealt_anew(picked, "key"))
            pairs = _ends(state.alias("x").join(leaders.alias("y"), meets))
            for earlier in tried:
                pairs = pairs.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
            pairs = scratch.cut(pairs)
            tried.append(pairs)
        new = _similar(pairs, shingles, threshold).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        merged = components(new, scratch)
        over += [merged, roots]
        tops = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = scratch.cut(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        scratch.release()
        if last:
            break
        state = state.drop("root", "minor").join(roots, "node")
        before = count
    scratch.drop(known, shingles, *tried, *over)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id (the smallest doc_id among its near duplicates, its own if it has
    none), n_shingles. Null and empty texts are in no class but their own; texts without words match equal texts only.
    Rows that share a doc_id but not a text are looked up text by text, and what either links to the other's node counts
    for both. Rows with a null doc_id get the class of other rows' equal text, null if there is none."""
    scratch = Scratch(docs.sparkSession, "minhash")
    prints = scratch.cut(fingerprints(docs, id_col, text_col, bands, rows))
    copies = prints.where("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.count("*").alias("size"))
    copies = scratch.cut(copies)
    heads = copies.select("node", "f1", "f2").where("n > 0")
    nodes = scratch.cut(prints.withColumnRenamed("doc_id", "node").join(heads, ["node", "f1", "f2"]).dropDuplicates(["node", "f1", "f2"]).select("node", "n", "keys", "sketch"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text")).where("length(text) > 0")
    roots = linked_roots(nodes, texts, scratch, threshold, bands * rows)
    member = prints.join(copies.where("size > 1").select("f1", "f2", "node"), ["f1", "f2"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"), "n")
    joined = member.join(roots, "node", "left")
    return joined.select("doc_id", F.coalesce("root", "node").alias("class_id"), F.col("n").cast("bigint").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns as they are: that of the smallest id, of rows that repeat it the first; rows
    with a null id come last. Rows with a null or empty text all stay, as do texts without words that equal no other."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).groupBy("id").agg(F.count("*").alias("rows"))
    if ids.where("id is null or rows > 1").isEmpty():
        other = free_name(docs, "gone")
        gone = near_duplicates(docs, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(other))
        return docs.join(gone, F.col(id_col) == F.col(other), "left_anti")
    row, own = free_name(docs, "row"), free_name(docs, "class")
    rows = Scratch(docs.sparkSession, "keep_one").cut(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = near_duplicates(rows, row, text_col).select(F.col("doc_id").alias(row), F.col("class_id").alias(own))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))
    kept = rows.select(row, id_col).join(classes, row).groupBy(own).agg(F.min_by(row, order).alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
