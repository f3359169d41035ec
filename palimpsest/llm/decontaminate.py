"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words. Rolling hashes of `least` words (Karp-Rabin) that a
document and an item share are the seeds, once the words themselves have been compared; equal neighbours on a diagonal
join to maximal common runs. Tiling marks the
longest run whose words are all unmarked on both sides, over and over, cutting runs that marked words interrupt, down to
runs of `least` words (Wise 1993). The share of an item's words under tiles is its coverage, which reordering the
passage does not lower much. A document whose coverage of an item reaches the threshold is contaminated.

While the benchmark's seeds fit a stated number, they go to every worker and documents are read once, without a
shuffle. Beyond it, seeds of documents and items meet in a shuffled join instead, with the same result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, dealt_anew, free_name, hash_words, slices

RESULT = "doc_id bigint, item_id bigint, coverage double, matched_words bigint, tiles bigint, longest bigint"

#: An odd base and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_FREE = re.compile(rb"\0+")


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]), dtype=np.uint64)
    return [p[:n] for p in _POWERS]


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of words[i:i+n] for each i that has n words from there. Each comes from the one
    before in constant time, as the difference of two running sums."""
    count = len(words) - n + 1
    if count <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
    return (sums[n:] - sums[:count]) * inverse[:count]


def tile(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal common runs (document position, item position, length): longest first, then the
    earliest in the item, then in the document. Runs that lost words to a tile go on as their unmarked pieces."""
    todo = [(-n, q, p) for p, q, n in runs]
    heapq.heapify(todo)
    marked_p, marked_q = (bytearray(max((r[k] + r[2] for r in runs), default=0)) for k in (0, 1))
    out = []
    while todo:
        n, q, p = heapq.heappop(todo)
        n = -n
        if marked_q.find(0, q, q + n) < 0 or marked_p.find(0, p, p + n) < 0:
            continue
        if marked_q.find(1, q, q + n) < 0 and marked_p.find(1, p, p + n) < 0:
            marked_p[p : p + n] = marked_q[q : q + n] = b"\1" * n
            out.append((p, q, n))
            continue
        marked = (int.from_bytes(marked_p[p : p + n]) | int.from_bytes(marked_q[q : q + n])).to_bytes(n)
        for free in _FREE.finditer(marked):
            if free.end() - free.start() >= least:
                heapq.heappush(todo, (free.start() - free.end(), q + free.start(), p + free.start()))
    return out


@dataclass
class BenchmarkIndex:
    """Items as word hashes and their sorted seeds. Items of fewer than `least` words are their own single seed."""

    ids: list[int]
    words: list[np.ndarray]
    least: int

    def __post_init__(self) -> None:
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        self.seeds = {}
        for n in sorted({min(self.least, len(w)) for w in self.words if len(w)}):
            own = [(k, rolling_hashes(w, n)) for k, w in enumerate(self.words) if min(self.least, len(w)) == n]
            h = np.concatenate([x for _, x in own])
            item = np.concatenate([np.full(len(x), k) for k, x in own])
            at = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.argsort(h, kind="stable")
            bits = min(22, max(10, (16 * len(h)).bit_length()))
            filt = np.zeros(1 << bits, bool)
            filt[h >> np.uint64(64 - bits)] = True
            self.seeds[n] = (h[order], item[order], at[order], filt, np.uint64(64 - bits))

    def _hits(self, words: np.ndarray, n: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document position, item, item position) where n words are the same, compared word by word, about `block` at once."""
        h, item, at, filt, shift = self.seeds[n]
        own = rolling_hashes(words, n)
        pos = np.flatnonzero(filt[own >> shift])
        lo, hi = np.searchsorted(h, own[pos], "left"), np.searchsorted(h, own[pos], "right")
        hit = hi > lo
        pos, lo, count = pos[hit], lo[hit], (hi - lo)[hit]
        for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(np.cumsum(count) // block)) + 1):
            c = count[part]
            first = np.repeat(lo[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            p, k, q = np.repeat(pos[part], c), item[first], at[first]
            same = np.ones(len(p), bool)
            for j in range(n):
                same &= words[p + j] == self.flat[self.start[k] + q + j]
            yield p[same], k[same], q[same]

    def runs(self, words: np.ndarray, only: set[int] | None = None, block: int = 1 << 18) -> dict[int, list[tuple[int, int, int]]]:
        """item number -> maximal common runs with a text, from its word hashes. Of the seeds only those that begin or
        end a run are kept, so that repeated words, whose seeds are as many as the product of both lengths, need
        memory for their runs alone."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        padded = np.append(words, np.uint64(0))
        for n in self.seeds:
            begins, ends = [], []
            for p, k, q in self._hits(words, n, block):
                if only is not None:
                    among = np.isin(k, list(only))
                    p, k, q = p[among], k[among], q[among]
                at = self.start[k] + q
                rows = np.stack([k, p - q, p])
                begins.append(rows[:, (p == 0) | (q == 0) | (padded[p - 1] != self.flat[at - 1])])
                ends.append(rows[:, (p + n == len(words)) | (q + n == self.sizes[k]) | (padded[np.minimum(p + n, len(words))] != self.flat[at + n])])
            if not begins:
                continue
            (k, d, p), (_, _, e) = (x[:, np.lexsort((x[2], x[1], x[0]))] for x in (np.concatenate(begins, axis=1), np.concatenate(ends, axis=1)))
            for item, at, diagonal, size in zip(k.tolist(), p.tolist(), d.tolist(), (e - p + n).tolist(), strict=True):
                out.setdefault(item, []).append((at, at - diagonal, size))
        return out

    def covered(self, words: np.ndarray, threshold: float, only: set[int] | None = None) -> list[tuple[int, float, int, int, int]]:
        """(item id, coverage, matched words, tiles, longest tile) of the items that reach the threshold."""
        out = []
        for k, runs in self.runs(words, only).items():
            size = len(self.words[k])
            reach = np.zeros(size + 1, np.int64)  # words under any run: a bound on the words under tiles
            for _, q, n in runs:
                reach[q] += 1
                reach[q + n] -= 1
            if np.count_nonzero(np.cumsum(reach)[:size]) < threshold * size:
                continue
            tiles = tile(runs, min(self.least, size))
            matched = sum(n for _, _, n in tiles)
            if matched >= threshold * size:
                out.append((self.ids[k], matched / size, matched, len(tiles), max(n for _, _, n in tiles)))
        return sorted(out)


def _index(items: DataFrame, least: int, most_seeds: int) -> BenchmarkIndex | None:
    """The benchmark's index, or None where its characters could hold more than most_seeds seeds."""
    if (items.agg(F.sum(F.length("_text"))).first()[0] or 0) > 2 * most_seeds:
        return None
    rows = items.toArrow().to_pydict()
    words, offsets = hash_words(rows["_text"])
    return BenchmarkIndex(rows["_item"], [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], least)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("bigint").alias("_item"), F.col(text_col).alias("_text")).where("_item is not null and length(_text) > 0").distinct().orderBy("_item", "_text")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_seeds: int = 4_000_000) -> DataFrame:
    """One row per document row and item whose coverage reaches the threshold: doc_id, item_id, coverage, matched_words,
    tiles, longest. Null and empty texts and items, and items without words, match nothing; items shorter than `least`
    words must be there whole. Repeated rows are reported each, with a null doc_id too. Items that share an id count one
    by one, repeated ones once, those with a null id not at all. Other columns are not read."""
    items = _items(benchmark, item_col, item_text_col)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    index = _index(items, least, most_seeds)
    if index is None:
        return _by_join(docs, items, threshold, least)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                yield _rows(batch.column(0).to_pylist(), x.ids and _found(x, batch.column(1).to_pylist(), threshold))

    return docs.mapInArrow(run, RESULT)


def _found(index: BenchmarkIndex, texts: list[str | None], threshold: float) -> list[list[tuple]]:
    words, offsets = hash_words(texts)
    return [index.covered(words[a:b], threshold) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _rows(ids: list[int], found: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(i, *f) for i, fs in zip(ids, found, strict=False) for f in fs]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "coverage", "matched_words", "tiles", "longest"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_seeds: int = 4_000_000) -> DataFrame:
    """The documents that contain no item to the threshold, all columns as they are. Null and empty texts, and all rows
    where there are no items, stay; of repeated rows all stay or go."""
    items = _items(benchmark, item_col, item_text_col)
    index = _index(items, least, most_seeds)
    if index is None:
        row = free_name(docs, "row")
        rows = Scratch(docs.sparkSession, "decontaminate").cut(docs.withColumn(row, F.monotonically_increasing_id()))
        bad = _by_join(rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("_text")), items, threshold, least)
        return rows.join(bad.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array([not f for f in _found(x, batch.column(at).to_pylist(), threshold)], pa.bool_())) if x.ids else batch

    return docs.mapInArrow(run, docs.schema)


def _seed_rows(texts: DataFrame, id_col: str, least: int, whole: bool) -> DataFrame:
    """(id, seed, times, words) for each distinct seed of a text, how often it occurs and how many words the text has;
    whole: a text of fewer than `least` words is one seed, otherwise seeds of all shorter lengths are given, to meet such
    items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "_text"):
                words, offsets = hash_words(batch.column(1).to_pylist())
                ids, seeds, times, sizes = ([np.zeros(0, np.int64)] for _ in range(4))
                for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    for n in [min(least, b - a)] if whole else range(1, min(least, b - a) + 1):
                        own, count = np.unique(rolling_hashes(words[a:b], n) ^ np.uint64(n), return_counts=True)
                        for column, values in ((ids, np.full(len(own), i)), (seeds, own.view(np.int64)), (times, count), (sizes, np.full(len(own), b - a))):
                            column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, seeds, times, sizes)], [id_col, "_seed", "_times", "_words"])

    return texts.where(F.length("_text") > 0).mapInArrow(run, f"{id_col} bigint, _seed bigint, _times bigint, _words bigint")


def _by_join(docs: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """Seeds meet in a shuffled join; a document and the items it shares seeds with are tiled with their texts at hand.

    Tiles of at least `least` words that cover c words of an item hold c / least of its seeds or more, so a document that
    reaches the threshold has one of the item's seeds even where its commonest ones, fewer than that, are left out. A
    phrase that many documents and items have is thus looked up for few items."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.cut(items.select(F.monotonically_increasing_id().alias("_key"), "_item", "_text"))
    docs = scratch.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    seeds = scratch.cut(_seed_rows(items.select("_key", "_text"), "_key", least, True))
    known = scratch.cut(seeds.select("_seed").distinct())
    own = scratch.cut(_seed_rows(docs.select("_row", "_text"), "_row", least, False).select("_row", "_seed").join(known, "_seed", "left_semi"))
    common = own.groupBy("_seed").agg(F.count("*").alias("_docs"))
    ranked = seeds.join(dealt_anew(common, "_seed"), "_seed")
    upto = F.sum("_times").over(Window.partitionBy("_key").orderBy(F.desc("_docs"), "_seed"))
    needed = F.ceil(F.ceil(F.col("_words") * threshold - 1e-9) / F.least(F.lit(least), F.col("_words")))
    rare = scratch.cut(ranked.withColumn("_upto", upto).where(F.col("_upto") >= needed).select("_key", "_seed"))
    pairs = scratch.cut(own.join(rare, "_seed").select("_row", "_key").distinct())
    scratch.drop(seeds, known, own, rare)
    texts = pairs.join(items, "_key").join(docs.withColumnRenamed("_text", "_doc"), "_row").select("doc_id", "_row", "_doc", "_key", "_item", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_doc", rows=256):
                ids, rows, doc, keys, item, text = (batch.column(k).to_pylist() for k in range(6))
                number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                first = dict(zip(reversed(keys), zip(reversed(item), reversed(text), strict=True), strict=True))
                words, o = hash_words([first[k][1] for k in number])
                index = BenchmarkIndex([first[k][0] for k in number], [words[a:b] for a, b in zip(o[:-1], o[1:], strict=True)], least)
                wanted: dict[int, tuple[int, str, set[int]]] = {}
                for i, r, d, k in zip(ids, rows, doc, keys, strict=True):
                    wanted.setdefault(r, (i, d, set()))[2].add(number[k])
                words, o = hash_words([d for _, d, _ in wanted.values()])
                found = [index.covered(words[a:b], threshold, only) for a, b, (_, _, only) in zip(o[:-1], o[1:], wanted.values(), strict=True)]
                yield _rows([i for i, _, _ in wanted.values()], found)

    return texts.mapInArrow(run, RESULT)
