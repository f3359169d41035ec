"""Colour pixels, and the ink and resampling kernels against plain versions."""

import numpy as np
import pytest

from palimpsest.operators import images
from palimpsest.sources import images as source


def picture(seed, height=40, width=60):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (height, width, 3), dtype=np.uint8)


def png_reader():
    """A function that goes to the workers by value."""
    import struct
    import zlib

    import numpy as np

    def read(data):
        """Pixels of a PNG whose rows have no filter."""
        at, body = 8, b""
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                width, height, depth, colour = struct.unpack(">IIBB", data[at + 8 : at + 18])
            body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += size + 12
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
        assert depth == 8 and not rows[:, 0].any()
        return rows[:, 1:].reshape((height, width, 3) if colour == 2 else (height, width))

    return read


read_png = png_reader()


def plain_lab(r, g, b):
    line = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    x, y, z = (sum(m * c for m, c in zip(row, line)) / w for row, w in zip(images.RGB_TO_XYZ.tolist(), images.WHITE_POINT.tolist()))
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def test_lab_against_a_plain_version():
    rgb = picture(1, 8, 8)
    lab = images.lab_of(rgb)
    for i in range(8):
        for j in range(8):
            assert lab[i, j] == pytest.approx(plain_lab(*map(int, rgb[i, j])), abs=1e-9)
    every = np.stack(np.meshgrid(*[np.arange(0, 256, 15)] * 3), axis=-1).reshape(-1, 1, 3)
    assert (images.rgb_of(images.lab_of(every)) == every).all()
    assert images.lab_of(np.array([[[255, 255, 255], [0, 0, 0]]]))[0] == pytest.approx(np.array([[100, 0, 0], [0, 0, 0]]), abs=0.02)


def plain_equalised(gray, clip, tiles):
    rows, columns = gray.shape
    at = lambda n, k: n * k // tiles
    maps = {}
    for i in range(tiles):
        for j in range(tiles):
            own = [int(gray[y, x]) for y in range(at(rows, i), at(rows, i + 1)) for x in range(at(columns, j), at(columns, j + 1))]
            limit = max(1.0, clip * len(own) / 256)
            counts = [own.count(v) for v in range(256)]
            over = sum(max(0, c - limit) for c in counts) / 256
            total, maps[i, j] = 0.0, []
            for c in counts:
                total += min(c, limit) + over
                maps[i, j].append(total * 255 / len(own))
    out = np.zeros_like(gray)
    for y in range(rows):
        for x in range(columns):
            v, u = (min(max((k + 0.5) * tiles / n - 0.5, 0), tiles - 1) for k, n in ((y, rows), (x, columns)))
            i, j = int(v), int(u)
            k, m = min(i + 1, tiles - 1), min(j + 1, tiles - 1)
            a, b = v - i, u - j
            g = int(gray[y, x])
            out[y, x] = np.clip(np.rint((maps[i, j][g] * (1 - b) + maps[i, m][g] * b) * (1 - a) + (maps[k, j][g] * (1 - b) + maps[k, m][g] * b) * a), 0, 255)
    return out


def test_equalised_colours_are_equalised_in_lightness():
    rgb = (picture(2, 24, 32) // 4 + 60).astype(np.uint8)
    lab = images.lab_of(rgb)
    steps = np.rint(lab[..., 0] * 2.55).astype(np.uint8)
    want = lab.copy()
    want[..., 0] = plain_equalised(steps, 2.0, 4) / 2.55
    got = images.equalised_colour(rgb, 2.0, 4)
    assert np.abs(got.astype(int) - images.rgb_of(want).astype(int)).max() <= 1
    gray = rgb[..., 0]
    assert (images.equalised(gray, 2.0, 4) == plain_equalised(gray, 2.0, 4)).all()
    shades = images.equalised_colour(np.repeat(gray[..., None], 3, axis=2))
    assert np.ptp(shades.astype(int), axis=2).max() <= 1


def test_resampling_equals_a_full_matrix():
    def full(size, wanted):
        scale = max(1.0, size / wanted)
        x = (np.arange(size)[None, :] + 0.5 - ((np.arange(wanted) + 0.5) * size / wanted)[:, None]) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    for height, width, new in ((40, 60, (10, 15)), (7, 300, (64, 2743)), (3, 2, (50, 1)), (128, 9, (64, 4))):
        gray = picture(height, height, width)[..., 0]
        step = np.clip(np.rint(gray.astype(float) @ full(width, new[1]).T), 0, 255)
        assert (images.resampled(gray, *new) == np.clip(np.rint(full(height, new[0]) @ step), 0, 255)).all()
        rgb = picture(width, height, width)
        both = images.resized_to_height(rgb, 16)
        assert both.shape[0] == 16 and all((both[..., k] == images.resized_to_height(rgb[..., k].copy(), 16)).all() for k in range(3))


def test_otsu_by_its_definition():
    rng = np.random.default_rng(4)
    for gray in (rng.integers(0, 256, (30, 30), dtype=np.uint8), np.where(rng.random((40, 40)) < 0.3, 20, 200).astype(np.uint8), rng.normal(120, 30, (50, 50)).clip(0, 255).astype(np.uint8), np.full((5, 5), 7, np.uint8)):
        flat, best = gray.ravel().astype(float), (0.0, 0)
        for t in range(256):
            low, high = flat[flat <= t], flat[flat >= t]
            if len(low) and len(high):
                v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                best = (v, t) if v > best[0] * (1 + 1e-12) else best
        assert images.otsu_threshold(gray) == best[1]


def test_wide_ink_is_darker_than_a_gaussian_mean():
    gray = picture(9, 33, 41)[..., 0]
    sigma = 0.3 * (14 * 0.5 - 1) + 0.8
    taps = [np.exp(-0.5 * (k / sigma) ** 2) for k in range(-7, 8)]
    got = images.darker_than_around(gray, 15, 8.0)
    for y in range(0, 33, 4):
        for x in range(0, 41, 5):
            mean = sum(taps[i] * taps[j] * gray[min(max(y + i - 7, 0), 32), min(max(x + j - 7, 0), 40)] for i in range(15) for j in range(15)) / sum(taps) ** 2
            assert got[y, x] == (gray[y, x] <= np.rint(mean) - 8.0)


def test_colour_pages_and_crops(spark, tmp_path):
    rgb = picture(5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(images.png(rgb))
    assert (read_png(images.png(rgb)) == rgb).all() and (read_png(images.png(rgb[..., 0])) == rgb[..., 0]).all()
    for decode in (read_png, None):
        page = source.page_pixels(spark, str(tmp_path / "in"), decode, colour=True)
        row = page.first()
        assert (row.height, row.width, row.orientation) == (40, 60, 1) and (images.pixels_of(row.pixels, 40, 60) == rgb).all()
    name = row.page
    lines = spark.createDataFrame([(name, "l", 10, 10, 30, 20, [(10, 10), (30, 10), (10, 20)], 0.0)], "page string, line_id string, x1 int, y1 int, x2 int, y2 int, coords array<struct<x:int,y:int>>, angle double")
    crop = images.line_images(lines, page, pad=2).first()
    assert (images.pixels_of(crop.pixels, crop.height, crop.width) == rgb[8:22, 8:32]).all()
    masked = images.line_images(lines, page, pad=2, mask=True).first()
    for k in range(3):
        assert (images.pixels_of(masked.pixels, 14, 24)[..., k] == images.crop(rgb[..., k], (10, 10, 30, 20), 2, [(10, 10), (30, 10), (10, 20)])).all()
    bright = images.png_files(images.line_images(lines, page, 32, pad=2, equalise=True)).first()
    want = images.resized_to_height(images.equalised_colour(rgb[8:22, 8:32], tiles=8), 32)
    assert (read_png(bright.png) == want).all() and bright.height == 32


def test_spark_decodes_colours_in_order():
    data = np.array([[[1, 2, 3, 9], [4, 5, 6, 9]]], np.uint8)
    assert source.channels_of(data.tobytes(), 1, 2, 4, True).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert source.channels_of(data[..., :1].tobytes(), 1, 2, 1, True).tolist() == [[[1, 1, 1], [4, 4, 4]]]
    assert source.channels_of(data[..., :1].tobytes(), 1, 2, 1, False).tolist() == [[1, 4]]
