"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learned from. With g(x) the classifier's margin, l the logistic
loss and p the share of toxic texts, the risk is  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]):  what the
unlabelled texts would cost if all were clean, less the toxic texts' expected share in it; when the difference turns
negative, the step undoes the overfit instead (Kiryo et al. 2017). The classifier is linear over hashed words and word
beginnings and is trained with numpy on the driver from bounded samples; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ragged, slices, words_of

#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A text that has this many distinct words of a feature has a feature of its own for it.
SEVERAL = (2, 4)
FEATURE_BITS = 31
_MASK = (1 << FEATURE_BITS) - 1


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    out = [xxhash.xxh3_64_intdigest("=" + word) & _MASK]
    out += [xxhash.xxh3_64_intdigest(f"{n}{word[:n]}") & _MASK for n in BEGINNINGS if len(word) >= n]
    return out


def several(feature: int, n: int) -> int:
    """The feature of n distinct words that have this one."""
    return (feature * 0x9E3779B1 + n * 0x85EBCA77) & _MASK


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a text, sorted."""
    base = Counter(f for w in set(words_of(text)) for f in word_features(w))
    more = [several(f, n) for f, c in base.items() if c > 1 for n in SEVERAL if c >= n]
    return np.unique(np.array([*base, *more], np.int32))


class WordFeatures(dict):
    """word -> those of its features that have a weight, alone or for several words; forgets all at `most` words, and keeps
    none of more than `longest` characters."""

    def __init__(self, weights: dict[int, float], most: int = 200_000, longest: int = 100):
        super().__init__()
        self.weights, self.most, self.longest = weights, most, longest

    def __missing__(self, word: str) -> tuple[int, ...]:
        w = self.weights
        out = tuple(f for f in word_features(word) if f in w or any(several(f, n) in w for n in SEVERAL))
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


@dataclass
class ToxicityModel:
    """bias + sum of the weights of a text's distinct features, through the logistic function."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    prior: float = 0.0

    def margins(self, texts: list[str | None], known: WordFeatures) -> np.ndarray:
        weight = self.weights
        get = known.__getitem__
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found = Counter(f for fs in filter(None, map(get, set(words_of(text)))) for f in fs)
            if found:
                every = {*found, *(several(f, n) for f, c in found.items() if c > 1 for n in SEVERAL if c >= n)}
                out[i] += sum(weight.get(f, 0.0) for f in sorted(every))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_lists(docs: DataFrame, text_col: str, known: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct features of each text of a bounded sample, all or those in a sorted array, gathered on the driver end to end;
    the lists are views of that."""
    shared = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def own(text: str | None) -> np.ndarray:
        found = text_features(text)
        return found if shared is None else shared.value[_slots(shared.value, found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [own(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([ragged(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(f) for f in found], np.int64), pa.int32())], ["features"])

    out: list[np.ndarray] = []
    for chunk in docs.select(text_col).mapInArrow(run, "features array<int>").toArrow().column(0).chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _slots(known: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in a sorted array of those features that are in it."""
    at = np.minimum(np.searchsorted(known, features), max(0, len(known) - 1))
    return at[known[at] == features] if len(known) else at[:0]


def nnpu_risk(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_pos: int, n: int, prior: float, decay: float = 0.0) -> tuple[float, float, np.ndarray]:
    """(risk of toxic texts as toxic, risk of the rest as clean, gradient of the step). w ends with the bias; (rows, cols)
    are the features of n texts, the first n_pos of them toxic. The gradient is that of both risks with weight decay; where
    the rest is negative it is that of minus the rest, which undoes the overfit."""
    is_pos = np.arange(n) < n_pos
    per_pos, per_unl = prior / n_pos, 1.0 / max(1, n - n_pos)
    g = np.bincount(rows, w[cols], n) + w[-1]
    p = _logistic(g)
    clean = np.logaddexp(0, g)  # loss if the text were clean
    toxic = per_pos * np.logaddexp(0, -g[is_pos]).sum()
    rest = per_unl * clean[~is_pos].sum() - per_pos * clean[is_pos].sum()
    d_rest = np.where(is_pos, -per_pos * p, per_unl * p)
    d = np.where(is_pos, -per_pos * (1 - p), 0.0) + d_rest if rest >= 0 else -d_rest
    grad = np.append(np.bincount(cols, d[rows], len(w) - 1), d.sum())
    grad[:-1] += decay * w[:-1]
    return float(toxic), float(rest), grad


def common_features(texts: list[np.ndarray], least_df: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The features that least_df texts or more have, sorted, and how many have each."""
    found, df = np.unique(np.concatenate([*texts, np.zeros(0, np.int32)]), return_counts=True)
    return found[df >= least_df].astype(np.int32), df[df >= least_df]


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 300, step: float = 0.05, decay: float = 1e-4, least_df: int = 4, least_share: float = 0.5, least_g: float = 16.0, most_features: int = 50_000) -> ToxicityModel:
    """Minimises the non-negative risk by Adam over all samples. A feature takes part if at
    least least_df positive texts have it, if the prior and its rates in both samples put the share of toxic texts among
    those that have it at least_share or more, and if its excess in positive texts is no chance: twice the log-likelihood
    ratio against the rate in unlabelled texts, as Poisson counts, is least_g or more."""
    prior = min(max(prior, 1e-4), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    if not positive:
        return ToxicityModel(-30.0, {}, 0.0)
    found, df_p = common_features(positive, least_df)
    df_u = np.zeros(len(found))
    for fs in unlabelled:
        df_u[_slots(found, fs)] += 1
    rate = (df_u + 1.0) / (len(unlabelled) + 2.0)
    lift = (df_p / len(positive)) / rate
    expected = rate * len(positive)
    g = 2 * (df_p * np.log(df_p / expected) - (df_p - expected))
    good = np.flatnonzero((lift * prior >= least_share) & (lift > 1) & (g >= least_g))
    keep = np.sort(found[good[np.argsort(-(df_p[good] * np.log(lift[good])), kind="stable")[:most_features]]])
    if not len(keep):
        return ToxicityModel(bias, {}, prior)
    own = [_slots(keep, fs) for fs in [*positive, *unlabelled]]
    rows, cols = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    w, m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    w[-1] = bias
    for t in range(1, epochs + 1):
        _, _, grad = nnpu_risk(w, rows, cols, len(positive), len(own), prior, decay)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    some = np.flatnonzero(np.abs(w[:-1]) > 1e-3)
    return ToxicityModel(float(w[-1]), {int(keep[i]): float(w[i]) for i in some}, prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 9000, seed: int = 7) -> ToxicityModel:
    """Fits on at most max_positive confirmed toxic texts and max_unlabelled texts of unknown label, both drawn by the
    order of a hash of the id, none of them held out. The prior is the toxic share among the labelled rows not held out.
    Of rows that repeat an id one text is taken, the first in order, so that the bounds hold for rows. Rows with a null id
    and null labels are not learned from; null and empty texts have no features. Without toxic labels every score is
    near 0."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    share = ids.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    if not share:
        return ToxicityModel(-30.0, {}, 0.0)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    order = F.xxhash64("_id", F.lit(seed))
    toxic = ids.where("_y = 1").groupBy("_id").agg(F.lit(1).alias("_one")).orderBy(order, "_id").limit(max_positive)
    drawn = texts.select("_id").distinct().orderBy(order, "_id").limit(max_unlabelled)
    positive, unlabelled = (texts.join(F.broadcast(ids), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text")) for ids in (toxic, drawn))
    own = _feature_lists(positive, "_text")
    # What too few positive texts have takes no part, so nobody else's is asked for.
    model = fit_nnpu(own, _feature_lists(unlabelled, "_text", common_features(own)[0]), float(share))
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted. Null and empty texts, and texts without a known
    feature, get the score of the bias alone. Repeated rows are scored each, null ids stay null and are not held out; other
    columns are not read. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = WordFeatures(m.weights)
        for whole in batches:
            for batch in slices(whole, text_col, rows=2000):
                p = _logistic(m.margins(batch.column(2).to_pylist(), known))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score is under the threshold, all columns as they are. Null and empty texts have the score of
    the bias alone; repeated rows all stay or go. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = WordFeatures(m.weights)
        for whole in batches:
            for batch in slices(whole, text_col, rows=2000):
                p = _logistic(m.margins(batch.column(at).to_pylist(), known))
                yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
