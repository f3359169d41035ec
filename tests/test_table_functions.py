"""Transcribers and segmenters called from SQL."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import table_functions
from palimpsest.operators.transcribe import EchoTranscriber, ProfileSegmenter, segment_pages, transcribe

LINES = "page string, line_id string, line_idx int, content binary, extra int"


def engines():
    """Classes that go to the workers by value, as those of a notebook do."""

    class Neighbours:
        """Each line with how many lines its page has and the line before it."""

        name, by_page = "neighbours", True

        def load(self):
            self.loaded = True

        def predict(self, lines):
            assert self.loaded and lines["page"].nunique(dropna=False) == 1
            texts = [c.decode() for c in lines["content"]]
            return pd.DataFrame({"text": [f"{len(texts)}:{b}<{a}" for a, b in zip(["", *texts], texts)], "confidence": [1.0] * len(texts)})

    class Picky(EchoTranscriber):
        name = "picky"

        def predict(self, lines):
            if any(c == b"bad" for c in lines["content"]):
                raise RuntimeError("cannot read")
            return super().predict(lines)

    return {"neighbours": Neighbours, "picky": Picky}


@pytest.fixture
def lines(spark):
    rows = [(f"p{k % 7}", f"l{k}", k, f"text {k}".encode(), 5) for k in range(500)] + [("q", "x", 0, b"bad", 1), (None, "y", 1, "é".encode(), None)]
    df = spark.createDataFrame(rows, LINES)
    df.repartition(5).createOrReplaceTempView("lines")
    table_functions.register(spark, engines())
    return df


def rows_of(df):
    return sorted(map(str, df.select("page", "line_id", "line_idx", "text", "confidence", "error").collect()))


def test_lines_go_through_an_engine(spark, lines):
    got = spark.sql("SELECT * FROM transcribe(TABLE(lines), 'echo')")
    assert got.columns == ["page", "line_id", "line_idx", "text", "confidence", "error"] and rows_of(got) == rows_of(transcribe(lines, EchoTranscriber()))
    joined = spark.sql("SELECT page, count(*) AS n FROM transcribe(TABLE(SELECT * FROM lines WHERE page = 'p1'), 'echo') GROUP BY page").collect()
    assert [tuple(r) for r in joined] == [("p1", 72)]
    assert spark.sql("SELECT * FROM transcribe(TABLE(SELECT * FROM lines WHERE page = 'none'), 'echo')").count() == 0


def test_failures_are_rows(spark, lines):
    got = {r.line_id: r for r in spark.sql("SELECT * FROM transcribe(TABLE(lines), 'picky')").collect()}
    assert len(got) == 502 and got["x"].error == "RuntimeError: cannot read" and got["l3"].text == "text 3" and got["l3"].error is None
    with pytest.raises(Exception, match="no engine 'other'"):
        spark.sql("SELECT * FROM transcribe(TABLE(lines), 'other')").collect()


def test_pages_are_whole_with_a_partition(spark, lines):
    got = {r.line_id: r.text for r in spark.sql("SELECT * FROM transcribe(TABLE(lines) PARTITION BY page ORDER BY (line_idx DESC), 'neighbours')").collect()}
    assert len(got) == 502 and got["x"] == "1:bad<" and got["l0"] == "72:text 0<text 7" and got["l497"] == "72:text 497<" and got["l3"] == "71:text 3<text 10"


def test_pages_are_segmented(spark):
    shot = np.full((120, 60), 255, np.uint8)
    shot[20:40], shot[70:95] = 0, 0
    images = spark.createDataFrame([("a", 120, 60, shot.tobytes()), ("blank", 10, 10, bytes([255] * 100)), ("broken", 9, 9, b"xx")], "page string, height int, width int, pixels binary")
    images.createOrReplaceTempView("images")
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM segment(TABLE(images), 'profile')")
    want = segment_pages(images, ProfileSegmenter())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where(F.col("error").isNull()).count() == 2
