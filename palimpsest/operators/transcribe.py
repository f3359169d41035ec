"""Transcribers: what they must offer, a registry, and running them over line images in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "page string, line_id string, line_idx int, text string, confidence double, error string"


class Transcriber(Protocol):
    """load() runs once in each Python worker; predict gets rows (page, line_id, line_idx, content) and returns rows
    with text and confidence in the same order."""

    name: str
    by_page: bool

    def load(self) -> None: ...

    def predict(self, lines: pd.DataFrame) -> pd.DataFrame: ...


class EchoTranscriber:
    """Returns the content as text; deterministic, for tests and dry runs."""

    name, by_page = "echo", False

    def load(self) -> None:
        pass

    def predict(self, lines: pd.DataFrame) -> pd.DataFrame:
        texts = [c.decode("utf-8") if isinstance(c, (bytes, bytearray)) else str(c) for c in lines["content"]]
        return pd.DataFrame({"text": texts, "confidence": [min(1.0, len(t) / 100) for t in texts]})


_REGISTRY: dict[str, Callable[[], Transcriber]] = {"echo": EchoTranscriber}


def register(name: str, maker: Callable[[], Transcriber]) -> None:
    """Adds or replaces a transcriber by name."""
    _REGISTRY[name] = maker


def get(name: str) -> Transcriber:
    return _REGISTRY[name]()


def available(spark: SparkSession, prefix: str = "", only: bool = False) -> DataFrame:
    """(name, available, reason) of the transcribers whose name begins with the prefix: one that cannot be made is listed
    with the reason, or left out with only=True."""
    rows = []
    for name, maker in sorted(_REGISTRY.items()):
        try:
            maker()
            rows.append((name, True, None))
        except Exception as e:  # noqa: BLE001  any failure is the reason that is listed
            rows.append((name, False, f"{type(e).__name__}: {e}"))
    found = spark.createDataFrame(rows, "name string, available boolean, reason string").where(F.startswith("name", F.lit(prefix)))
    return found.where("available") if only else found


def guarded(transcriber: Transcriber, lines: pd.DataFrame) -> pd.DataFrame:
    """Predictions of a batch; where it fails, of its lines one by one, each failure an error row."""
    keys = lines[["page", "line_id", "line_idx"]].reset_index(drop=True)
    try:
        out = transcriber.predict(lines.reset_index(drop=True))
        if len(out) != len(lines):
            raise ValueError(f"{len(out)} results for {len(lines)} lines")
        return pd.concat([keys, out[["text", "confidence"]].reset_index(drop=True)], axis=1).assign(error=None)
    except Exception as e:  # noqa: BLE001  a transcriber's failure must not end the job
        if len(lines) > 1:
            return pd.concat([guarded(transcriber, lines.iloc[[i]]) for i in range(len(lines))], ignore_index=True)
        return keys.assign(text=None, confidence=None, error=f"{type(e).__name__}: {e}")


_LOADED: dict[str, Transcriber] = {}


def _loaded(key: str, transcriber: Transcriber) -> Transcriber:
    """The worker's transcriber of a call of transcribe(), loaded the first time it is asked for."""
    if key not in _LOADED:
        _LOADED.clear()
        transcriber.load()
        _LOADED[key] = transcriber
    return _LOADED[key]


def transcribe(lines: DataFrame, transcriber: Transcriber) -> DataFrame:
    """(page, line_id, line_idx, text, confidence, error) for lines (page, line_id, line_idx, content). Batches go through
    as they come, or, for transcribers that want a page's context, page by page."""
    columns = lines.select("page", "line_id", "line_idx", "content")
    key = uuid.uuid4().hex
    if transcriber.by_page:

        def page(rows: pd.DataFrame) -> pd.DataFrame:
            return guarded(_loaded(key, transcriber), rows.sort_values("line_idx"))

        return columns.groupBy("page").applyInPandas(page, RESULT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield guarded(_loaded(key, transcriber), batch)

    return columns.mapInPandas(run, RESULT)


SEGMENT = "page string, line_id string, line_idx int, x1 int, y1 int, x2 int, y2 int, error string"


class Segmenter(Protocol):
    """load() runs once in each Python worker; segment gets a page's grey pixels and returns the boxes (x1, y1, x2, y2) of
    its lines in order."""

    name: str

    def load(self) -> None: ...

    def segment(self, gray: np.ndarray) -> list[tuple[int, int, int, int]]: ...


class ProfileSegmenter:
    """Lines as runs of rows with ink, full width and padded: gaps of fewer than min_gap rows are filled, runs of fewer than
    min_height rows dropped, runs up to 2 * min_gap rows apart joined. rule is one of ink_mask's."""

    name = "profile"

    def __init__(self, min_height: int = 15, min_gap: int = 5, sensitivity: float = 0.02, pad: int = 8, rule: str = "otsu"):
        self.min_height, self.min_gap, self.sensitivity, self.pad, self.rule = min_height, min_gap, sensitivity, pad, rule

    def load(self) -> None:
        pass

    def segment(self, gray: np.ndarray) -> list[tuple[int, int, int, int]]:
        from palimpsest.operators.images import row_ink

        ink = row_ink(gray, self.rule)
        rows = np.flatnonzero(ink > ink.max(initial=0) * self.sensitivity)
        if not len(rows):
            return []
        runs = [(int(r[0]), int(r[-1])) for r in np.split(rows, np.flatnonzero(np.diff(rows) - 1 >= self.min_gap) + 1)]
        runs = [r for r in runs if r[1] - r[0] + 1 >= self.min_height]
        joined: list[tuple[int, int]] = []
        for first, last in runs:
            if joined and first - joined[-1][1] <= 2 * self.min_gap:
                joined[-1] = (joined[-1][0], last)
            else:
                joined.append((first, last))
        height, width = gray.shape
        return [(0, max(0, a - self.pad), width, min(height, b + self.pad)) for a, b in joined]


def segment_pages(images: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(page, line_id, line_idx, x1, y1, x2, y2, error) for images (page, height, width, pixels). A page where the segmenter
    fails is one row with the error; a page without lines has none."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for page, height, width, data in batch.itertuples(index=False, name=None):
                try:
                    boxes = _loaded(key, segmenter).segment(np.frombuffer(data, np.uint8).reshape(height, width))
                    rows += [(page, f"line_{i}", i, *map(int, box), None) for i, box in enumerate(boxes)]
                except Exception as e:  # noqa: BLE001  a segmenter's failure must not end the job
                    rows.append((page, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")], dtype=object)

    return images.select("page", "height", "width", "pixels").mapInPandas(run, SEGMENT)
