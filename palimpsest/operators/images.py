"""Pixel kernels on grey and colour images (rows with height, width and the pixels as bytes, in colour three to a pixel), in
numpy within Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def otsu_threshold(gray: np.ndarray) -> int:
    """The grey value with the largest variance between classes; both classes count the threshold's own bin. With n and m
    pixels of sums s and t the variance is (s m - t n)^2 / (n m), and the upper class is all less the lower one and once the
    bin again."""
    own = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    mass = np.stack([own, own * np.arange(256)])  # pixels and their grey
    dark = mass.cumsum(axis=1)
    bright = mass.sum(axis=1, keepdims=True) - dark + mass
    pairs = dark[0] * bright[0]
    apart = (dark[1] * bright[0] - bright[1] * dark[0]) ** 2
    return int(np.argmax(np.divide(apart, pairs, out=np.zeros(256), where=pairs > 0)))


def inside_polygon(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies inside, by the even-odd rule."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def crop(gray: np.ndarray, box: tuple[int, int, int, int], pad: int = 5, polygon: list[tuple[float, float]] | None = None, outside: int = 255) -> np.ndarray:
    """The padded box within the image; with a polygon, pixels outside it are filled."""
    height, width = gray.shape
    x1, y1, x2, y2 = max(0, box[0] - pad), max(0, box[1] - pad), min(width, box[2] + pad), min(height, box[3] + pad)
    out = gray[y1:y2, x1:x2].copy()
    if polygon:
        out[~inside_polygon([(x - x1, y - y1) for x, y in polygon], x2 - x1, y2 - y1)] = outside
    return out


def ink_extent(gray: np.ndarray, box: tuple[int, int, int, int], dark: int = 200, share: float = 0.05) -> tuple[int, int]:
    """First and last row of the box with more dark pixels than a share of its width; the box's own rows without any."""
    x1, y1, x2, y2 = box
    part = gray[y1:y2, x1:x2]
    rows = np.flatnonzero((part < dark).sum(axis=1) > (x2 - x1) * share)
    return (y1 + int(rows[0]), y1 + int(rows[-1])) if len(rows) else (y1, y2)


def smoothed(values: np.ndarray, sigma: float = 1.0, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Gaussian mean along the axes, cut at four deviations, edges mirrored."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = values.astype(np.float64)
    for axis in axes if axes is not None else range(out.ndim):
        padded = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)], mode="symmetric")
        size = out.shape[axis]
        out = sum(w * np.take(padded, np.arange(k, k + size), axis) for k, w in enumerate(weights))
    return out


def locally_dark(gray: np.ndarray, block: int = 35, offset: float = 10.0) -> np.ndarray:
    """Pixels darker than the mean of the block around them less an offset, by sums over the area before each pixel."""
    half = block // 2
    padded = np.pad(gray.astype(np.float64), half, mode="edge")
    sums = np.pad(padded.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    h, w = gray.shape
    size = 2 * half + 1
    mean = (sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]) / size**2
    return gray < mean - offset


def darker_than_around(gray: np.ndarray, block: int = 15, offset: float = 8.0) -> np.ndarray:
    """Pixels no brighter than the rounded Gaussian mean of the block around them less an offset. The deviation follows from
    the block's size, edges are repeated."""
    reach, sigma = block // 2, 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    mean = gray.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(mean, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        mean = sum(w * np.take(padded, np.arange(k, k + gray.shape[axis]), axis) for k, w in enumerate(weights))
    return gray <= np.rint(mean) - offset


def grown(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels with a true one in the rectangle around them, outside counting as false."""
    out = mask
    for axis, size in ((0, height), (1, width)):
        before = size // 2
        padded = np.pad(out, [(before, size - 1 - before) if k == axis else (0, 0) for k in (0, 1)])
        out = np.any([np.take(padded, np.arange(k, k + out.shape[axis]), axis) for k in range(size)], axis=0)
    return out


def closed(mask: np.ndarray, height: int, width: int, times: int = 1) -> np.ndarray:
    """Morphological closing by a rectangle: grown, then shrunk as often. Outside counts as empty while growing and as full
    while shrinking, so that ink at the edges stays."""
    out = mask
    for _ in range(times):
        out = grown(out, height, width)
    for _ in range(times):
        out = ~grown(~out[::-1, ::-1], height, width)[::-1, ::-1]
    return out


def ink_mask(gray: np.ndarray, rule: str = "otsu") -> np.ndarray:
    """Ink pixels. otsu: below the Otsu threshold. combined: below that of the smoothed image or locally dark, closed twice
    by 3 x 5 pixels. wide: darker than the Gaussian mean of small blocks, closed by 1 x 30 and 3 x 1 pixels."""
    if rule == "combined":
        soft = np.rint(smoothed(gray)).astype(np.uint8)
        return closed((soft < otsu_threshold(soft)) | locally_dark(gray), 3, 5, 2)
    if rule == "wide":
        return closed(closed(darker_than_around(gray, 15, 8.0), 1, 30), 3, 1)
    return gray < otsu_threshold(gray)


def row_ink(gray: np.ndarray, rule: str = "otsu") -> np.ndarray:
    """Ink pixels of each row, smoothed: by a median of three, or, where the rule is wide, by a Gaussian mean."""
    ink = ink_mask(gray, rule).sum(axis=1).astype(np.float64)
    if rule == "wide":
        return smoothed(ink, 1.0)
    padded = np.pad(ink, 1, mode="edge")
    return np.median(np.stack([padded[:-2], padded[1:-1], padded[2:]]), axis=0)


def png(image: np.ndarray) -> bytes:
    """A grey or colour image as a PNG file."""
    height, width = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()  # each behind its filter, none
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pixels_of(data: bytes, height: int, width: int) -> np.ndarray:
    """Pixels as an array: grey, or with three channels where there are three bytes to a pixel."""
    return np.frombuffer(data, np.uint8).reshape((height, width) if len(data) == height * width else (height, width, 3))


def channelwise(kernel: Callable[[np.ndarray], np.ndarray], image: np.ndarray) -> np.ndarray:
    """A grey image's kernel on each channel."""
    return kernel(image) if image.ndim == 2 else np.stack([kernel(image[..., k]) for k in range(image.shape[2])], axis=-1)


def png_files(images: DataFrame, target_height: int | None = None) -> DataFrame:
    """Adds png, the image (height, width, pixels) as a PNG file, on demand resized to a height first. Images of three bytes
    to a pixel are colour files."""
    schema = T.StructType([*images.schema.fields, T.StructField("png", T.BinaryType())])

    def one(height: int, width: int, data: bytes) -> bytes | None:
        if data is None or not height or not width:
            return None
        image = pixels_of(data, int(height), int(width))
        return png(resized_to_height(image, target_height) if target_height else image)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(png=[one(*x) for x in zip(batch["height"].fillna(0), batch["width"].fillna(0), batch["pixels"], strict=True)])

    return images.mapInPandas(run, schema)


def row_profiles(images: DataFrame, sensitivity: float = 0.02, rule: str = "otsu") -> DataFrame:
    """(page, y, ink, is_text): smoothed ink pixels of each row by a rule of ink_mask, and whether they exceed the share of
    the page's largest row. Runs and merges of the rows are window functions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, height, width, data in zip(batch["page"], batch["height"], batch["width"], batch["pixels"], strict=True):
                smooth = row_ink(np.frombuffer(data, np.uint8).reshape(height, width), rule)
                yield pd.DataFrame({"page": page, "y": np.arange(height), "ink": smooth, "is_text": smooth > smooth.max(initial=0) * sensitivity})

    return images.select("page", "height", "width", "pixels").mapInPandas(run, "page string, y int, ink double, is_text boolean")


def profile_thresholds(profiles: DataFrame) -> DataFrame:
    """Adds is_text by the other rule: ink above max(3rd percentile, mean + a tenth of the standard deviation)."""
    t = profiles.groupBy("page").agg(F.greatest(F.percentile("ink", F.lit(0.03)), F.avg("ink") + 0.1 * F.stddev_pop("ink")).alias("_t"))
    return profiles.join(t, "page").withColumn("is_text", F.col("ink") > F.col("_t")).drop("_t")


def segment_rows(profiles: DataFrame, min_gap: int = 5, min_height: int = 15, max_gap: int | None = None) -> DataFrame:
    """(page, start, end): text rows joined to lines, close lines merged."""
    from palimpsest.operators.sequences import merge_close, runs

    found = runs(profiles, "page", "y", "is_text", min_gap, min_height).withColumnsRenamed({"first": "start", "last": "end"})
    return merge_close(found, "page", "start", "end", 2 * min_gap if max_gap is None else max_gap).drop("parts")


def tightened_lines(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Adds ink_top and ink_bottom to lines (page, x1, y1, x2, y2) from their page's pixels, page by page: an image is
    held once, its lines are bounded."""
    schema = T.StructType([*lines.schema.fields, T.StructField("ink_top", T.IntegerType()), T.StructField("ink_bottom", T.IntegerType())])
    names = lines.columns

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return left.assign(ink_top=left["y1"], ink_bottom=left["y2"])[[*names, "ink_top", "ink_bottom"]]
        image = right.iloc[0]
        gray = np.frombuffer(image["pixels"], np.uint8).reshape(image["height"], image["width"])
        found = [ink_extent(gray, box) for box in left[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)]
        return left.assign(ink_top=[f[0] for f in found], ink_bottom=[f[1] for f in found])[[*names, "ink_top", "ink_bottom"]]

    return lines.groupBy("page").cogroup(images.groupBy("page")).applyInPandas(run, schema)


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear; pixel centres of both grids are matched. Exact resampling of other libraries is not promised."""
    rows, columns = gray.shape
    y = np.clip((np.arange(height) + 0.5) * rows / height - 0.5, 0, rows - 1)
    x = np.clip((np.arange(width) + 0.5) * columns / width - 0.5, 0, columns - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, columns - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    g = gray.astype(np.float64)
    top = g[np.ix_(y0, x0)] * (1 - fx) + g[np.ix_(y0, x1)] * fx
    bottom = g[np.ix_(y1, x0)] * (1 - fx) + g[np.ix_(y1, x1)] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def _lanczos(size: int, wanted: int, lobes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (wanted x taps) of Lanczos resampling: the pixels within the window around each wanted one, which
    widens where the size shrinks."""
    scale = max(1.0, size / wanted)
    centre = (np.arange(wanted) + 0.5) * size / wanted
    taps = int(2 * lobes * scale) + 2
    at = np.floor(centre - lobes * scale).astype(int)[:, None] + np.arange(taps)
    x = (at + 0.5 - centre[:, None]) / scale
    weights = np.where((np.abs(x) < lobes) & (at >= 0) & (at < size), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return np.clip(at, 0, size - 1), weights / weights.sum(axis=1, keepdims=True)


def resampled(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling, columns before rows, rounded after each. What it needs grows with the image, not with its square."""
    step = gray.astype(np.float64)
    for axis, wanted in ((1, width), (0, height)):
        at, weights = _lanczos(gray.shape[axis], wanted)
        own = weights if axis else weights[:, :, None]
        step = sum(np.take(step, at[:, k], axis) * own[:, k] for k in range(at.shape[1]))
        step = np.clip(np.rint(step), 0, 255)
    return step.astype(np.uint8)


def resized_to_height(image: np.ndarray, target: int, most: int = 10_000) -> np.ndarray:
    """Keeps the aspect ratio by Lanczos resampling; the width is cut to a whole number, from 1 to most."""
    rows, columns = image.shape[:2]
    return channelwise(lambda c: resampled(c, target, min(most, max(1, int(target * (columns / rows))))), image)


def rotated(gray: np.ndarray, degrees: float, fill: int = 0) -> np.ndarray:
    """Turned counter-clockwise around the centre by nearest pixels, the size kept; uncovered pixels are filled."""
    rows, columns = gray.shape
    cy, cx, a = (rows - 1) / 2, (columns - 1) / 2, np.radians(degrees)
    y, x = np.mgrid[:rows, :columns]
    sx = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < columns) & (sy >= 0) & (sy < rows)
    return np.where(inside, gray[np.clip(sy, 0, rows - 1), np.clip(sx, 0, columns - 1)], fill).astype(np.uint8)


def equalised(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: each tile's histogram is cut at clip times its mean, the rest is spread evenly,
    and pixels take the mix of the four nearest tiles' mappings."""
    rows, columns = gray.shape
    edges_y, edges_x = np.linspace(0, rows, tiles + 1).astype(int), np.linspace(0, columns, tiles + 1).astype(int)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = gray[edges_y[i] : edges_y[i + 1], edges_x[j] : edges_x[j + 1]]
            histogram = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * part.size / 256)
            over = np.maximum(histogram - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(histogram, limit) + over / 256) * 255 / max(1, part.size)
    y = np.clip((np.arange(rows) + 0.5) * tiles / rows - 0.5, 0, tiles - 1)
    x = np.clip((np.arange(columns) + 0.5) * tiles / columns - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], gray]
    mixed = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


#: From linear RGB to XYZ relative to daylight white (D65); the constants of CIE L*a*b*; fixed values.
RGB_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE_POINT = np.array([0.950456, 1.0, 1.088754])
SMALL, SLOPE, SHIFT = 0.008856, 7.787, 16 / 116


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """L*a*b* of colours from 0 to 255: lightness from 0 to 100 in the first channel."""
    c = rgb / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    f = linear @ RGB_TO_XYZ.T / WHITE_POINT
    f = np.where(f > SMALL, np.cbrt(f), SLOPE * f + SHIFT)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def rgb_of(lab: np.ndarray) -> np.ndarray:
    """Colours from 0 to 255 of L*a*b*, rounded; colours that a screen has not are cut to the next one."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f > np.cbrt(SMALL), f**3, (f - SHIFT) / SLOPE) * WHITE_POINT
    linear = np.clip(xyz @ np.linalg.inv(RGB_TO_XYZ).T, 0, 1)
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)


def equalised_colour(rgb: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of a colour image: its lightness is equalised, in 256 steps, its hues stay."""
    lab = lab_of(rgb)
    steps = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalised(steps, clip, tiles) / 2.55
    return rgb_of(lab)


def line_images(lines: DataFrame, images: DataFrame, target_height: int | None = None, mask: bool = False, deskew: bool = False, equalise: bool = False, pad: int = 5) -> DataFrame:
    """(page, line_id, height, width, pixels): crops of lines (page, line_id, x1, y1, x2, y2, coords, angle) from their
    page's pixels, page by page. mask fills what is outside coords, white, or black where lines are turned upright; deskew
    turns by angles of more than half a degree before the mask, and cuts to the mask. Empty crops, and upright ones of
    fewer than 5 pixels either way, give no row. Pages of three bytes to a pixel give colour crops, whose lightness is
    what equalise equalises."""
    names = ["page", "line_id", "height", "width", "pixels"]

    def cut(gray: np.ndarray, line) -> np.ndarray:
        polygon = [(p["x"], p["y"]) for p in line.coords] if mask and line.coords is not None and len(line.coords) > 2 else None
        box = (line.x1, line.y1, line.x2, line.y2)
        out = crop(gray, box, pad, None if deskew else polygon)
        if deskew and out.size:
            out = rotated(out, line.angle, 0) if abs(line.angle or 0.0) > 0.5 else out
            if polygon:
                left, top = max(0, box[0] - pad), max(0, box[1] - pad)
                inside = inside_polygon([(x - left, y - top) for x, y in polygon], out.shape[1], out.shape[0])
                rows, columns = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
                out = np.where(inside, out, 0).astype(np.uint8)
                out = out[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else out[:0]
            out = out if min(out.shape) >= 5 else out[:0]
        return out

    def one(image: np.ndarray, line) -> np.ndarray:
        out = channelwise(lambda c: cut(c, line), image)
        if equalise and out.size:
            out = (equalised if out.ndim == 2 else equalised_colour)(out, tiles=min(8, *out.shape[:2]))
        return resized_to_height(out, target_height) if target_height and out.size else out

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right):
            image = right.iloc[0]
            whole = pixels_of(image["pixels"], image["height"], image["width"])
            for line in left.itertuples(index=False):
                out = one(whole, line)
                if out.size:
                    rows.append((line.page, line.line_id, *out.shape[:2], out.tobytes()))
        return pd.DataFrame(rows, columns=names)

    wanted = lines.select("page", "line_id", "x1", "y1", "x2", "y2", "coords", "angle")
    return wanted.groupBy("page").cogroup(images.select("page", "height", "width", "pixels").groupBy("page")).applyInPandas(run, "page string, line_id string, height int, width int, pixels binary")
