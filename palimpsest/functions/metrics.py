"""Transcription quality: character and word error rates, match percentage, edit operations.

Rates are percentages of the reference and can exceed 100. Distances are of code points and of words. Pairs of up to
SHORT characters are compared by SQL functions; longer ones and words in Arrow batches, by bits of whole numbers, many pairs
of nearly one length at a time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import words

#: Characters of the longer text up to which SQL functions compare a pair.
SHORT = 96
#: Elements of a pair's longer side above which it is compared alone, and of all pairs that are compared side by side.
ALONE, TOGETHER = 4096, 131_072


def _places(a: Sequence) -> dict:
    """The bit string of each element's places in a."""
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    places = {}
    for x, own in at.items():
        bits = bytearray((len(a) + 7) // 8)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        places[x] = int.from_bytes(bits, "little")
    return places


def _column(same: int, up: int, down: int, full: int) -> tuple[int, int, int, int]:
    """From a column's steps up and down, and the places that equal the next element, the steps to the right and left of it
    in each row, and the next column's steps up and down (Myers 1999)."""
    diagonal = (((same & up) + up) ^ up) | same | down
    right, left = down | (full & ~(diagonal | up)), up & diagonal
    r, l = right << 1 | 1, left << 1  # noqa: E741
    return right, left, (l | ~(diagonal | r)) & full, r & diagonal & full


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance. The column of the table that goes with each element of b is two bit strings, its steps up and
    down, and follows from the one before by a few operations on whole numbers."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    size = len(a)
    places = _places(a)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    for x in b:
        same = places.get(x, 0)  # as in _column, which would cost a call for each element
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
    return distance


def _side_by_side(pairs: Sequence[tuple[np.ndarray, np.ndarray]], letters: int) -> np.ndarray:
    """Distances of pairs of numbers below `letters`, as sequence_distance finds them, with the pairs' columns side by side in
    one bit string, so that a step costs a few operations for all pairs. Equal ends make the second ones equally long, which
    changes no distance; a bit between two columns takes what additions and shifts carry."""
    n, most = len(pairs), max(len(b) for _, b in pairs)
    sizes = np.array([len(a) + most - len(b) for a, b in pairs])
    width = (int(sizes.max()) + 8) // 8
    first = np.arange(n) * (letters + 1)
    steps = np.full((most, n), letters)
    for i, (_, b) in enumerate(pairs):
        steps[: len(b), i] = b
    steps += first
    rows = np.concatenate([np.concatenate([a, np.full(size - len(a), letters)]) + at for (a, _), size, at in zip(pairs, sizes, first, strict=True)])
    places = np.concatenate([np.arange(size) for size in sizes])
    table = np.zeros((n * (letters + 1), width), np.uint8)
    np.bitwise_or.at(table.reshape(-1), rows * width + (places >> 3), (1 << (places & 7)).astype(np.uint8))
    whole = lambda bits: int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")
    at = np.arange(width * 8)
    full, lowest = whole(at < sizes[:, None]), whole(np.repeat((at == 0)[None, :], n, axis=0))
    up, down = full, 0
    for step in steps:  # as in _column
        same = int.from_bytes(table.take(step, axis=0).tobytes(), "little")
        diagonal = (((same & up) + up) ^ up) | same | down
        left = (up & diagonal) << 1
        right = (down | (((diagonal | up) & full) ^ full)) << 1 | lowest
        up = (((diagonal | right) & full) ^ full) | (left & full)
        down = right & diagonal & full
    ones = lambda x: np.bitwise_count(np.frombuffer(x.to_bytes(n * width, "little"), np.uint8).reshape(n, width)).sum(axis=1, dtype=np.int64)
    return most + ones(up) - ones(down)


def _numbers(pairs: Sequence[tuple[Sequence, Sequence]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The elements of pairs, characters or words, as numbers from 0, and how many numbers there are. Equal words are equal
    numbers within a pair, equal characters within all."""
    if not all(isinstance(x, str) for pair in pairs for x in pair):
        out, letters = [], 0
        for pair in pairs:
            known: dict = {}
            out.append(tuple(np.array([known.setdefault(x, len(known)) for x in own], np.int64) for own in pair))
            letters = max(letters, len(known))
        return out, letters
    points = [[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in pair] for pair in pairs]
    seen = np.zeros(1 + max(int(x.max()) for pair in points for x in pair), bool)
    for pair in points:
        for x in pair:
            seen[x] = True
    known = np.flatnonzero(seen)
    number = np.zeros(len(seen), np.int64)
    number[known] = np.arange(len(known))
    return [(number[a], number[b]) for a, b in points], len(known)


def distances(pairs: Sequence[tuple[Sequence, Sequence]]) -> list[int]:
    """Levenshtein distance of each pair: those of nearly one length side by side, long ones alone."""
    out = [len(a) + len(b) for a, b in pairs]
    size = [max(len(a), len(b)) for a, b in pairs]
    todo = []
    for i in sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=size.__getitem__):
        if size[i] > ALONE:
            out[i] = sequence_distance(*pairs[i])
            continue
        if todo and (size[i] > size[todo[0]] * 1.25 + 8 or (len(todo) + 1) * size[i] > TOGETHER):
            _fill(out, pairs, todo)
            todo = []
        todo.append(i)
    if todo:
        _fill(out, pairs, todo)
    return out


def _fill(out: list[int], pairs: Sequence[tuple[Sequence, Sequence]], todo: list[int]) -> None:
    for i, d in zip(todo, _side_by_side(*_numbers([pairs[i] for i in todo])).tolist(), strict=True):
        out[i] = d


def _distances(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    own = [(r, h) for r, h in zip(reference, hypothesis, strict=True) if r is not None and h is not None]
    found = iter(distances(own))
    return pd.Series([None if r is None or h is None else next(found) for r, h in zip(reference, hypothesis, strict=True)], dtype="Int32")


_long_distance = F.pandas_udf(_distances, T.IntegerType())


def edit_distance(reference: Column, hypothesis: Column) -> Column:
    r, h = (F.coalesce(x, F.lit("")) for x in (reference, hypothesis))
    long = F.greatest(F.length(r), F.length(h)) > SHORT
    return F.when(long, _long_distance(F.when(long, r), F.when(long, h))).otherwise(F.levenshtein(r, h))


def _rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(100.0)).otherwise(distance / size * 100.0)


def rate(distance: Column, size: Column) -> Column:
    """A distance that is at hand, in percent of a positive reference size."""
    return distance / size * 100.0


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate in percent; for an empty reference 0 or 100."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return _rate(edit_distance(reference, hypothesis), size(reference), size(hypothesis))


def _word_distances(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series(distances([((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis, strict=True)]), dtype="int32")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of the word lists, which Python's split() makes as words() does."""
    return F.pandas_udf(_word_distances, T.IntegerType())(reference, hypothesis)


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate in percent; for a reference without words 0 or 100."""
    return _rate(word_distance(reference, hypothesis), F.size(words(reference)), F.size(words(hypothesis)))


def match_percent(reference: Column, hypothesis: Column) -> Column:
    """100 less the distance in percent of the longer text; 100 for two empty texts."""
    longer = F.greatest(F.coalesce(F.length(reference), F.lit(0)), F.coalesce(F.length(hypothesis), F.lit(0)))
    return F.when(longer == 0, 100.0).otherwise((longer - edit_distance(reference, hypothesis)) / longer * 100.0)


def comparison(reference: Column, hypothesis: Column) -> Column:
    """struct<cer,wer,match_percent,distance,reference_chars,hypothesis_chars,operations> of a pair of lines."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.struct(cer(reference, hypothesis).alias("cer"), wer(reference, hypothesis).alias("wer"), match_percent(reference, hypothesis).alias("match_percent"), edit_distance(reference, hypothesis).alias("distance"), size(reference).alias("reference_chars"), size(hypothesis).alias("hypothesis_chars"), diff_operations(reference, hypothesis).alias("operations"))


def overall(lines: DataFrame, *by: str, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Means of the lines' rates (macro), and edits over reference characters (micro). Without lines and groups: 0, 0, 100."""
    r, h = F.col(reference), F.col(hypothesis)
    rated = lines.select(*by, cer(r, h).alias("cer"), wer(r, h).alias("wer"), match_percent(r, h).alias("match"), edit_distance(r, h).alias("d"), F.coalesce(F.length(r), F.lit(0)).alias("n"))
    mean = lambda c, empty: F.coalesce(F.avg(c), F.lit(empty))
    return rated.groupBy(*by).agg(F.count("*").alias("lines"), mean("cer", 0.0).alias("cer"), mean("wer", 0.0).alias("wer"), mean("match", 100.0).alias("match"), F.sum("d").alias("edits"), (F.sum("d") / F.sum(F.greatest(F.lit(1), F.col("n")))).alias("micro_cer"))


def _greedy_path(longer: Sequence, shorter: Sequence, gap: bytes) -> bytes | None:
    """The path where the shorter one is left when elements of the longer one go; null where it is not. Then no cell on the
    way back costs more than the difference in length, so that the path keeps what is equal and else takes a gap."""
    out, j = bytearray(gap * len(longer)), len(shorter)
    if not j:
        return bytes(out)
    x = shorter[j - 1]
    for i in range(len(longer) - 1, -1, -1):
        if longer[i] == x:
            out[i] = 101  # e
            j -= 1
            if not j:
                return bytes(out)
            x = shorter[j - 1]
    return None


def edit_path(a: Sequence, b: Sequence) -> bytes:
    """One letter for each step of an alignment, from the beginning: e (equal), r (replace), d (delete), i (insert). Where
    alignments tie, going back from the end keeps or replaces, then deletes, then inserts.

    Columns are bit strings as for the distance. About the square root of their number are kept; going back, those between
    two of them are made again. So a pair of 30,000 characters takes some megabytes, not a table of 900 million cells. A pair
    of which one is a part of the other, with gaps, needs no columns: its path takes time in proportion to its length."""
    n, m = len(a), len(b)
    plain = _greedy_path(a, b, b"d") if n >= m else _greedy_path(b, a, b"i")
    if plain is not None:
        return plain
    places, full, width = _places(a), (1 << n) - 1, (n + 7) // 8
    every = max(1, int(m**0.5))
    kept = [(full, 0)]
    for j in range(1, m):
        _, _, up, down = _column(places.get(b[j - 1], 0), *(kept[-1] if (j - 1) % every == 0 else (up, down)), full)
        if j % every == 0:
            kept.append((up, down))
    out = bytearray()
    i, j = n, m
    while i and j:
        start = (j - 1) // every * every
        up, down = kept[start // every]
        columns = []
        for k in range(start, j):
            before = up, down
            right, left, up, down = _column(places.get(b[k], 0), up, down, full)
            columns.append([x.to_bytes(width, "little") for x in (*before, right, left, up)])
        while i and j > start:
            if a[i - 1] == b[j - 1]:
                out += b"e"
                i, j = i - 1, j - 1
                continue
            up_before, down_before, right, left, up_here = columns[j - 1 - start]
            byte, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
            step = lambda more, less: bool(more[byte] & bit) - bool(less[byte] & bit)  # noqa: E731, B023
            if step(right, left) + step(up_before, down_before) == 1:
                out += b"r"
                i, j = i - 1, j - 1
            elif up_here[byte] & bit:
                out += b"d"
                i -= 1
            else:
                out += b"i"
                j -= 1
    out += b"d" * i + b"i" * j
    return bytes(out[::-1])


_NAMES = {"e": "equal", "r": "replace", "d": "delete", "i": "insert"}


def edit_operations(reference: str, hypothesis: str) -> list[tuple[str, str, str]]:
    """(operation, reference part, hypothesis part) along edit_path, equal neighbours joined, others one character each."""
    out = []
    i = j = 0
    for own in re.findall("e+|.", edit_path(reference, hypothesis).decode()):
        di, dj = (len(own) if own[0] != "i" else 0), (len(own) if own[0] != "d" else 0)
        out.append((_NAMES[own[0]], reference[i : i + di], hypothesis[j : j + dj]))
        i, j = i + di, j + dj
    return out


def _operations(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Lists of operations, pair by pair, so that of one batch no more than its Arrow arrays is held."""
    keys = ("op", "reference", "hypothesis")
    kind = pa.list_(pa.struct([(k, pa.string()) for k in keys]))
    out = []
    for r, h in zip(reference, hypothesis, strict=True):
        columns = list(zip(*edit_operations(r.as_py() or "", h.as_py() or ""), strict=True)) or [()] * len(keys)
        parts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], keys)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts))
    return pa.concat_arrays(out).cast(kind) if out else pa.array([], kind)


def diff_operations(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit operations of each pair, whole documents too; null texts count as empty."""
    return F.arrow_udf(_operations, "array<struct<op:string,reference:string,hypothesis:string>>")(reference, hypothesis)
