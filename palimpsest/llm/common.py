"""Helpers shared by the training-data operators: scratch tables, word hashes, ragged arrays."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import new_folder

WORD = re.compile(r"\w+")

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Arrow batches of fewer rows than the default, as texts can be long; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    name = f"__{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before them."""

    #: Seconds between two requests to collect garbage, and when the last one was made, of all scratches of the driver.
    collects_after, collected = 10.0, -math.inf

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0
        self.held: list[DataFrame] = []
        self.written: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Writes df as Parquet and reads it back: the lineage ends here and both sides of a later join get their own exchange."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*partition_by).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((table, path))
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that cut() returned and that nothing reads any more. What is left goes when the driver ends. The
        shuffles behind them keep files on the executors' disks until the driver collects its garbage, so it is asked to;
        not after every short step, as the JVM takes a larger heap where its pauses are a large share of the time."""
        gone = {id(t) for t in tables}
        for table, path in self.written:
            if id(table) in gone:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.written = [(t, p) for t, p in self.written if id(t) not in gone]
        if time.monotonic() - Scratch.collected >= self.collects_after:
            self.spark._jvm.System.gc()
            Scratch.collected = time.monotonic()

    def hold(self, df: DataFrame) -> DataFrame:
        """Keeps a table in the executors' memory and on their disks for a few uses; what is lost is computed again from
        the last written tables, so no more than one or two tables should be held on top of each other. release() lets
        all go."""
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(held)
        return held

    def release(self) -> None:
        for held in self.held:
            held.unpersist()
        self.held.clear()


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by a hash that no join or aggregation on the keys uses, so that a join on them deals both sides again and
    can split a key that is frequent on one of them."""
    return df.repartition(F.xxhash64(*keys, F.lit(17)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64); wraps around."""
    x = x + _MULT
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; forgets all once it holds `most` words, and keeps none of more than
    `longest` characters."""

    def __init__(self, most: int = 100_000, longest: int = 100):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; [] for null."""
    return WORD.findall(text.lower()) if text else []


def hash_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of some texts, end to end, and the offsets of each text."""
    parts, offsets = [], [0]
    get = _HASHES.__getitem__
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        offsets.append(offsets[-1] + len(words))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(offsets, np.int64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i that has n words from there."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = mix64(h ^ words[k : k + count])
    return h


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch so that a slice has a bounded number of rows and, a single row apart, of bytes in a text column."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, s in enumerate(size):
        if i > at and (i - at >= rows or total + s > chars):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(s)
    if at < batch.num_rows:
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its values end to end and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
