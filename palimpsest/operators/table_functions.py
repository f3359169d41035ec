"""Transcribers and segmenters as table functions that SQL can call.

    SELECT * FROM transcribe(TABLE(lines), 'echo')
    SELECT * FROM transcribe(TABLE(lines) PARTITION BY page ORDER BY (line_idx), 'context')
    SELECT * FROM segment(TABLE(images), 'profile')

Batches of rows go through as Arrow batches. With PARTITION BY a transcriber that wants a page's context gets each page as a
whole, in the order that the call asks for; a page must fit a task. Without it such a transcriber gets the pages of the batch.
A function knows the engines it was registered with: they go to the workers with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from palimpsest.operators.transcribe import RESULT, SEGMENT, EchoTranscriber, ProfileSegmenter, Segmenter, Transcriber, guarded

_TEXTS = pa.schema([("page", pa.string()), ("line_id", pa.string()), ("line_idx", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("error", pa.string())])
_BOXES = pa.schema([("page", pa.string()), ("line_id", pa.string()), ("line_idx", pa.int32()), *[(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")], ("error", pa.string())])
TRANSCRIBERS: dict[str, Callable[[], Transcriber]] = {"echo": EchoTranscriber}
SEGMENTERS: dict[str, Callable[[], Segmenter]] = {"profile": ProfileSegmenter}


def _made(makers: dict, name: str):
    if name not in makers:
        raise ValueError(f"no engine {name!r}; there are: {', '.join(sorted(makers))}")
    engine = makers[name]()
    engine.load()
    return engine


def transcribe_function(makers: dict[str, Callable[[], Transcriber]]):
    """A table function of lines (page, line_id, line_idx, content) and an engine's name that gives transcribe()'s rows."""

    @arrow_udtf(returnType=RESULT)
    class Transcribe:
        def __init__(self) -> None:
            self.engine, self.held = None, []

        def eval(self, rows: pa.RecordBatch, engine: pa.Array) -> Iterator[pa.Table]:
            if self.engine is None:
                self.engine = _made(makers, engine[0].as_py())
            lines = rows.select(["page", "line_id", "line_idx", "content"]).to_pandas()
            if self.engine.by_page:
                self.held.append(lines)
            elif len(lines):
                yield self._texts(lines)

        def terminate(self) -> Iterator[pa.Table]:
            lines = pd.concat(self.held) if self.held else pd.DataFrame({"page": []})
            for _, page in lines.groupby("page", sort=False, dropna=False):
                yield self._texts(page)

        def _texts(self, lines: pd.DataFrame) -> pa.Table:
            out = guarded(self.engine, lines)
            columns = [pa.array([None if pd.isna(x) else x for x in out[f.name]], f.type) for f in _TEXTS]
            return pa.table(columns, schema=_TEXTS)

    return Transcribe


def segment_function(makers: dict[str, Callable[[], Segmenter]]):
    """A table function of images (page, height, width, pixels) and an engine's name that gives segment_pages()'s rows."""

    @arrow_udtf(returnType=SEGMENT)
    class Segment:
        def __init__(self) -> None:
            self.engine = None

        def eval(self, rows: pa.RecordBatch, engine: pa.Array) -> Iterator[pa.Table]:
            if self.engine is None:
                self.engine = _made(makers, engine[0].as_py())
            found: list[tuple] = []
            for page, height, width, data in zip(*(rows.column(c).to_pylist() for c in ("page", "height", "width", "pixels")), strict=True):
                try:
                    boxes = self.engine.segment(np.frombuffer(data, np.uint8).reshape(height, width))
                    found += [(page, f"line_{i}", i, *map(int, box), None) for i, box in enumerate(boxes)]
                except Exception as e:  # noqa: BLE001  a segmenter's failure must not end the query
                    found.append((page, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if found:
                yield pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*found, strict=True), _BOXES, strict=True)], schema=_BOXES)

    return Segment


def register(spark: SparkSession, transcribers: dict[str, Callable[[], Transcriber]] | None = None, segmenters: dict[str, Callable[[], Segmenter]] | None = None) -> None:
    """Makes transcribe and segment known to the session's SQL, with the given engines beside echo and profile."""
    spark.udtf.register("transcribe", transcribe_function(TRANSCRIBERS | (transcribers or {})))
    spark.udtf.register("segment", segment_function(SEGMENTERS | (segmenters or {})))
