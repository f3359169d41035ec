"""Page images as grey or colour pixels, turned as their EXIF tag asks; files that are no images give no row."""

from __future__ import annotations

import importlib.util
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "page string, height int, width int, orientation int, pixels binary"
#: EXIF orientation tag, and the turns (quarter turns counter-clockwise, then mirrored left to right); fixed values.
ORIENTATION = 0x0112
TURNS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}


def exif_orientation(content: bytes) -> int:
    """The orientation tag of a JPEG file, 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\0\0" and len(body) > 14:
            tiff, order = body[6:], "<" if body[6:8] == b"II" else ">"
            start = struct.unpack(order + "I", tiff[4:8])[0]
            for k in range(struct.unpack(order + "H", tiff[start : start + 2])[0] if start + 2 <= len(tiff) else 0):
                entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == ORIENTATION:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if value in TURNS else 1
        at += 2 + size
    return 1


def turned(gray: np.ndarray, orientation: int) -> np.ndarray:
    quarter, mirror = TURNS.get(orientation, (0, False))
    out = np.rot90(gray, quarter)
    return np.ascontiguousarray(out[:, ::-1] if mirror else out)


def pillow_gray(content: bytes) -> np.ndarray:
    """Grey pixels of an image file by the Pillow package."""
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


def pillow_colour(content: bytes) -> np.ndarray:
    """Red, green and blue of an image file by the Pillow package."""
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


def _pillow(colour: bool) -> Callable[[bytes], np.ndarray] | None:
    return (pillow_colour if colour else pillow_gray) if importlib.util.find_spec("PIL") else None


def channels_of(data: bytes, height: int, width: int, channels: int, colour: bool) -> np.ndarray:
    """Pixels of Spark's image source, which are blue, green, red (and opacity), as colour or as grey."""
    values = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if colour:
        return np.repeat(values, 3, axis=2) if channels == 1 else values[..., 2::-1]
    return values[..., 0] if channels == 1 else (values[..., :3] @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)


def page_pixels(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] | None = None, colour: bool = False) -> DataFrame:
    """(page, height, width, orientation, pixels): images in grey, or in colour with red, green and blue of each pixel,
    upright. A decoder of one's own says itself which it gives.

    With a decoder (Pillow's, where that is installed) each file is read and decoded once, in Arrow batches, without a
    shuffle. Without one Spark's image source decodes; the turns, which it leaves out, are then read from JPEG files'
    beginnings and joined to the images, only those that ask for a turn."""
    decode = decode or _pillow(colour)
    if decode is not None:

        def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for page, content in batch.itertuples(index=False, name=None):
                    try:
                        gray = decode(bytes(content))
                    except Exception:  # noqa: BLE001  a file that is no image gives no row
                        continue
                    tag = exif_orientation(bytes(content))
                    upright = turned(gray, tag)
                    rows.append((page, *upright.shape[:2], tag, upright.tobytes()))
                yield pd.DataFrame(rows, columns=["page", "height", "width", "orientation", "pixels"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decoded, PIXELS)
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two sources write local paths differently
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").withColumn("_at", same(F.col("origin")))
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(path).select(same(F.col("path")).alias("_at"), F.substring("content", 1, 65536).alias("head"))

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame({"_at": batch["_at"], "tag": [exif_orientation(bytes(h)) for h in batch["head"]]})
            yield found[found["tag"] != 1]

    joined = images.join(heads.mapInPandas(tags, "_at string, tag int"), "_at", "left").select(F.col("origin").alias("page"), "height", "width", "nChannels", "data", F.coalesce("tag", F.lit(1)).alias("tag"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, height, width, channels, data, tag in batch.itertuples(index=False, name=None):
                upright = turned(channels_of(data, height, width, channels, colour), tag)
                rows.append((page, *upright.shape[:2], tag, upright.tobytes()))
            yield pd.DataFrame(rows, columns=["page", "height", "width", "orientation", "pixels"])

    return joined.mapInPandas(run, PIXELS)
