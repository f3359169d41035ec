"""Line dedup: lines that several documents share stay in the first of them alone.

A line's key is the line stripped of white space with A-Z in lower case; it stands as a 128-bit hash. One pass counts
documents by key, summed before the shuffle. Keys that cost any document a line, which are few among all, are dealt to
shards by hash, each of a bounded number of keys, and each shard becomes a minimal perfect hash (levels of bits; a key that
meets another one goes on to the next level) over arrays of fingerprints, document counts and first documents. Documents
don't join lines: they probe the arrays. Where the arrays are small enough they are broadcast, and the documents are read
once more. Beyond, documents are written in blocks, each block asks a shard once for its distinct keys, packed, shards pass
their arrays over the questions as they stream by, and the answers meet the blocks again. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, mix64, slices

#: White space at the ends of lines; fixed value.
WHITE = b" \t\n\x0b\x0c\r"
#: Keys of a shard, on average; bytes of arrays up to which they are broadcast; most documents that are counted of a key.
SHARD_KEYS, MOST_BYTES, MOST_COUNT = 65_536, 48_000_000, 65_535
#: Bits of a level for each of its keys, and levels at most: a 64th has about e**(-64/2) of the keys.
GAMMA, MOST_LEVELS = 2.0, 64


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def hash_lines(texts: list[bytes | None], least_chars: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The lines of each text, the text of each line that is long enough with its place there, and those lines' hashes:
    lists, an array (n, 2) of text and place, an array (n, 2) of 64-bit halves."""
    digest = xxhash.xxh3_128_digest
    lines, places, hashes = [], [], []
    for i, text in enumerate(texts):
        own = (text or b"").split(b"\n")
        lines.append(own)
        for j, line in enumerate(own):
            key = line.strip(WHITE).lower()
            if len(key) >= least_chars and _long_enough(key, least_chars):
                places.append((i, j))
                hashes.append(digest(key))
    return lines, np.array(places, np.int64).reshape(-1, 2), np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: each key has a place of its own below their number; others have any or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        start = 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(start + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            start += int(ones.sum())
        self.size = start

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return mix64(keys[:, 0] ^ mix64(keys[:, 1] + np.uint64(level))) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == MOST_LEVELS:
                raise ValueError("equal keys")
            bits = 64 * max(1, int(-(-GAMMA * len(keys) // 64)))
            at = cls._at(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = self._at(keys[left], level, 64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = words[word]
            here = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (before[word] + below)[here]
            left = left[~here]
            if not len(left):
                break
        return out


class Shard:
    """A perfect hash with the fingerprint, count and first document of each key."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["bits"], "<u8")
        self.hash = PerfectHash(np.split(words, np.cumsum(row["sizes"])[:-1]) if len(words) else [])
        self.prints, self.counts = np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u2")
        self.owners = _ids(row["owners"])

    def probe(self, keys: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there in enough documents, and those keys' places."""
        at = self.hash.places(keys)
        at = np.where((at >= 0) & (self.prints[at] == keys[:, 1]), at, -1) if len(self.prints) else np.full(len(keys), -1)
        found = np.flatnonzero(at >= 0)
        found = found[self.counts[at[found]] >= min(min_docs, MOST_COUNT)]
        return found, at[found]


SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary, owners array<{}>"


def _ids(values: list) -> np.ndarray:
    """Ids as they compare: whole numbers as such, others as objects; null ids as objects."""
    if all(type(x) is int and -(1 << 63) <= x < 1 << 63 for x in values):
        return np.array(values, np.int64)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _build(table: pa.Table) -> pa.Table:
    """A shard's row from its keys (shard, h1, h2, n, first)."""
    keys = np.stack([table[c].to_numpy().astype("<i8").view("<u8") for c in ("h1", "h2")], axis=1)
    made = PerfectHash.build(keys)
    order = np.argsort(made.places(keys))
    counts = np.minimum(table["n"].to_numpy(), MOST_COUNT).astype("<u2")[order]
    owners = table["first"].combine_chunks().take(pa.array(order))
    owners = owners.combine_chunks() if isinstance(owners, pa.ChunkedArray) else owners
    return pa.table({
        "shard": table["shard"].slice(0, 1), "sizes": pa.array([[len(x) for x in made.levels]], pa.list_(pa.int32())), "bits": pa.array([b"".join(x.tobytes() for x in made.levels)], pa.binary()),
        "prints": pa.array([keys[order, 1].tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "owners": pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners),
    })


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] >> np.uint64(32)) % np.uint64(shards)


def shared_lines(docs: DataFrame, min_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n, first): the hash of each key that min_docs documents or more hold, at least two of them by id, with
    their number and the smallest id. Rows of one id are one document as far as two are asked for, and are counted each
    beyond; rows without an id are one more document, behind all others."""
    schema = f"h1 bigint, h2 bigint, id {docs.schema[id_col].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, rows=4000):
                _, places, keys = hash_lines(batch.column(1).cast(pa.binary()).to_pylist(), least_chars)
                order = np.lexsort((keys[:, 1], keys[:, 0], places[:, 0]))
                doc, own = places[order, 0], keys[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]).any(axis=1)
                halves = own[fresh].view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column(0).take(pa.array(doc[fresh]))], ["h1", "h2", "id"])

    keys = docs.select(id_col, text_col).mapInArrow(run, schema)
    held = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("with_id"))
    several = (F.col("first") != F.col("last")) | (F.col("first").isNotNull() & (F.col("with_id") < F.col("n")))
    return held.where(several & (F.col("n") >= min_docs)).select("h1", "h2", "n", "first")


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of keys (h1, h2, n, first); see Shard."""
    kind = keys.schema["first"].dataType.simpleString()
    shard = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards)).cast("int")
    return keys.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, SHARD.format(kind))


#: From hashes (n, 2) to the numbers of those that are in the arrays and their first documents.
Lookup = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def lookup_in(shards: dict[int, Shard], count: int, min_docs: int) -> Lookup:
    def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = shard_of(keys, count).astype(np.int64)
        order = np.argsort(at, kind="stable")
        found, owners = [np.zeros(0, np.int64)], []
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            own = shards.get(int(at[part[0]])) if len(part) else None
            if own:
                hit, place = own.probe(keys[part], min_docs)
                found.append(part[hit])
                owners.append(own.owners[place])
        return np.concatenate(found), np.concatenate(owners) if owners else np.zeros(0, np.int64)

    return look


def _deduped(ids: pa.Array, texts: pa.Array, look: Lookup, least_chars: int, names: list[str]) -> pa.RecordBatch:
    """(id, kept text, n_lines, n_dropped) of some documents."""
    lines, places, keys = hash_lines(texts.cast(pa.binary()).to_pylist(), least_chars)
    found, owners = look(keys)
    own = _ids(ids.to_pylist())
    lost = found[np.asarray(own[places[found, 0]] != owners, bool)] if len(found) else found
    gone: dict[int, set[int]] = {}
    for i, j in places[lost].tolist():
        gone.setdefault(i, set()).add(j)
    kept = [b"\n".join([x for j, x in enumerate(parts) if j not in gone[i]] if i in gone else parts) for i, parts in enumerate(lines)]
    counts = [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(lines))], pa.int64())]
    return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()).cast(pa.string()), *counts], names)


def dedup_lines(docs: DataFrame, min_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: id, text without the lines that an earlier document has, n_lines before, n_dropped.

    Keys of least_chars code points or more that min_docs documents hold lose their lines in all documents but that with
    the smallest id, where all stay. Null and empty texts are one empty line. Rows of one id keep or lose a line together;
    rows without an id come after all others and lose nothing to each other. Texts that lose all lines become empty. Other
    columns are not read. Arrays of up to most_bytes are broadcast, larger ones stay where their shards are."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lines")
    kind = docs.schema[id_col].dataType.simpleString()
    keys = scratch.cut(shared_lines(docs, min_docs, least_chars, id_col, text_col))
    shards = 1 + keys.count() // SHARD_KEYS
    index = scratch.cut(build_shards(keys, shards))
    scratch.drop(keys)
    size = index.agg(F.sum(F.length("bits") + F.length("prints") + F.length("counts") + 8 * F.size("owners"))).first()[0] or 0
    names = [id_col, text_col, "n_lines", "n_dropped"]
    schema = f"`{id_col}` {kind}, `{text_col}` string, n_lines bigint, n_dropped bigint"
    if size > most_bytes:
        return _routed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), index, shards, scratch, kind, min_docs, least_chars).toDF(*names)
    rows = {r.shard: r.asDict() for r in index.collect()}
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = lookup_in({k: Shard(r) for k, r in shared.value.items()}, shards, min_docs)
        for whole in batches:
            for batch in slices(whole, text_col, rows=4000):
                yield _deduped(batch.column(0), batch.column(1), look, least_chars, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _routed(docs: DataFrame, index: DataFrame, shards: int, scratch: Scratch, kind: str, min_docs: int, least_chars: int) -> DataFrame:
    """The same for arrays that are too large to broadcast. What a shard and what a block gets streams by in an order that
    brings the arrays, or the answers, first; a task holds those of one shard or block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, at)), *batch.columns], ["block", "id", "text"])
                at += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    _, _, keys = hash_lines(batch.column(1).slice(part[0], len(part)).cast(pa.binary()).to_pylist(), least_chars)
                    keys = np.unique(keys, axis=0)
                    at = shard_of(keys, shards)
                    own = [keys[at == s].tobytes() for s in np.unique(at)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int32)), pa.array([int(block[part[0]])] * len(own), pa.int64()), pa.array(own, pa.binary())], ["shard", "block", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, arrays = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] is None:
                    number, arrays = r["shard"], Shard(r)
                elif r["shard"] == number:
                    keys = np.frombuffer(r["keys"], "<u8").reshape(-1, 2)
                    found, place = arrays.probe(keys, min_docs)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([keys[found].tobytes()], pa.binary()), pa.array([arrays.owners[place].tolist()], owners)], ["block", "keys", "owners"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first = None, {}

        def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = np.ascontiguousarray(keys).tobytes()
            hits = [(i, first[k]) for i in range(len(keys)) if (k := raw[16 * i : 16 * i + 16]) in first]
            return np.array([i for i, _ in hits], np.int64), _ids([x for _, x in hits])

        for batch in batches:
            block, asked = batch.column(0).to_numpy(), batch.column(3)
            is_answer = np.array(asked.is_valid())
            cuts = np.flatnonzero((np.diff(block) != 0) | is_answer[1:] | is_answer[:-1]) + 1
            for part in np.split(np.arange(len(block)), cuts):
                if not len(part):
                    continue
                if block[part[0]] != number:
                    number, first = block[part[0]], {}
                if is_answer[part[0]]:
                    raw = asked[int(part[0])].as_py()
                    first.update(zip([raw[i : i + 16] for i in range(0, len(raw), 16)], batch.column(4)[int(part[0])].as_py(), strict=True))
                else:
                    own = batch.slice(part[0], len(part))
                    yield _deduped(own.column(1), own.column(2), look, least_chars, ["id", "text", "n_lines", "n_dropped"])

    from pyspark.sql.pandas.types import to_arrow_type

    owners = pa.list_(to_arrow_type(docs.schema["id"].dataType))
    held = scratch.cut(docs.mapInArrow(blocks, f"block bigint, id {kind}, text string"))
    asked = held.select("block", "text").mapInArrow(ask, "shard int, block bigint, keys binary")
    met = index.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    answers = met.mapInArrow(answer, f"block bigint, keys binary, owners array<{kind}>")
    back = held.select("block", "id", "text").unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("keys").asc_nulls_last())
    return back.mapInArrow(finish, f"id {kind}, text string, n_lines bigint, n_dropped bigint")
