import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from palimpsest.functions import metrics
from palimpsest.operators import api_log, images, layout, pairing, quality, splits, transcribe, vocabulary
from palimpsest.plans import jobs
from palimpsest.sources import files, layout_xml, sinks
from tests.test_sources import PAGE

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def gray(*rows):
    return np.array(rows, np.uint8)


def read_png(data):
    """Pixels of a grey PNG without filters."""
    import struct
    import zlib

    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        body += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:]


class PngText:
    """Reads the darkest pixel of an image as a letter."""

    name, by_page = "png", False

    def load(self):
        pass

    def predict(self, lines):
        import pandas as pd

        found = [read_png(bytes(c)).min() for c in lines["content"]]
        return pd.DataFrame({"text": [chr(97 + int(x)) if x < 26 else "" for x in found], "confidence": [0.5] * len(found)})


def test_distances_of_long_pairs(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("abé 日"), n)), "".join(rng.choice(list("abé 日"), m))) for n, m in ((0, 300), (3, 400), (256, 256), (257, 250), (600, 580), (1, 1), (0, 0))] + [(None, "x" * 300), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: (r.d, r.w) for r in df.select("i", metrics.edit_distance(F.col("a"), F.col("b")).alias("d"), metrics.word_distance(F.col("a"), F.col("b")).alias("w")).collect()}
    for i, (a, b) in enumerate(pairs):
        a, b = a or "", b or ""
        assert got[i] == (plain(a, b), plain(a.split(), b.split()))
    many = [" ".join(f"w{k}" for k in range(s, s + 40_000)) for s in (0, 100)]
    row = spark.createDataFrame([tuple(many)], "a string, b string").select(metrics.word_distance(F.col("a"), F.col("b")).alias("w")).first()
    assert row.w == 200
    bundle = spark.createDataFrame([("hello you", "helo you")], "a string, b string").select(metrics.comparison(F.col("a"), F.col("b")).alias("c")).first().c
    assert (bundle.distance, bundle.wer, bundle.reference_chars) == (1, 50.0, 9) and "".join(o.reference for o in bundle.operations) == "hello you"


def test_character_counts(spark):
    df = spark.createDataFrame([("aab", "x"), ("é日\na", None), (None, "x"), ("", "y"), ("b", "x")], "text string, g string")
    got = sorted((str(r.g), r.ch, r.n) for r in vocabulary.char_counts(df, "text", "g").collect())
    assert got == sorted([("x", "a", 2), ("x", "b", 2), ("None", "é", 1), ("None", "日", 1), ("None", "\n", 1), ("None", "a", 1)])
    assert vocabulary.char_counts(df.limit(0)).count() == 0


def test_arrow_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", [1.0 * i, None]) for i in range(1000)], "i bigint, t string, v array<double>").repartition(3)
    sinks.write_arrow(rows, str(tmp_path / "a"))
    names = sorted(p.name for p in (tmp_path / "a").glob("*.arrow"))
    assert len(names) == 3
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "a" / names[0])) as f:
        assert pa.ipc.open_stream(f).read_all().column_names == ["i", "t", "v"]
    back = files.read_arrow(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, back.select("i", "t").collect())) == sorted((i, f"t{i}") for i in range(1000)) and back.schema.simpleString() == rows.schema.simpleString()
    counts = jobs.arrow_split(spark, str(tmp_path / "a"), str(tmp_path / "s"), F.col("i"))
    assert counts == {"train": 800, "val": 200}
    assert (files.read_arrow(spark, str(tmp_path / "s/train")).count(), files.read_arrow(spark, str(tmp_path / "s/val")).count()) == (800, 200)
    (tmp_path / "none").mkdir()
    try:
        files.read_arrow(spark, str(tmp_path / "none"))
        raise AssertionError("no error")
    except ValueError as e:
        assert "no Arrow files" in str(e)


def test_export_folders(spark, tmp_path):
    (tmp_path / "page").mkdir()
    (tmp_path / "a.xml").write_text("<x/>")
    (tmp_path / "mets.xml").write_text("<x/>")
    names = lambda: sorted(r.path.rsplit("/", 1)[1] for r in layout_xml.read_export(spark, str(tmp_path)).collect())
    assert names() == ["a.xml"]
    (tmp_path / "page/metadata.xml").write_text("<x/>")
    assert names() == ["metadata.xml"]


def test_pairing_by_names(spark):
    pages = spark.createDataFrame([("d/a.xml", " other.tif ", None), ("d/b.xml", None, None), ("d/page/c.xml", "gone.png", None), ("d/e.xml", "", "no Page element"), ("d/f.xml", "F.png", None)], "path string, image_name string, error string")
    files_ = spark.createDataFrame([(p,) for p in ("d/other.tif", "d/a.png", "d/b.jpg", "d/b.png", "d/c.tif", "d/page/other.png", "x/F.png")], "path string")
    got = sorted((r.xml_path, r.image_path, r.priority) for r in pairing.alto_with_images(pages, files_).collect())
    assert got == [("d/a.xml", "d/other.tif", 0), ("d/b.xml", "d/b.jpg", 1), ("d/page/c.xml", "d/c.tif", 2)]
    named = {r.xml_path: (r.image_path, r.error) for r in pairing.xml_with_named_images(pages, files_).collect()}
    assert named == {"d/a.xml": (None, "no image  other.tif "), "d/b.xml": (None, "no image name"), "d/page/c.xml": (None, "no image gone.png"), "d/e.xml": (None, "no Page element"), "d/f.xml": ("x/F.png", None)}


def test_csv_to_trainer(spark, tmp_path):
    (tmp_path / "set.csv").write_text('a.png, one b \nmissing.png,two\nb.png," "\nb.png,"say ""b"""\n')
    pixels = spark.createDataFrame([(f"file:{tmp_path}/img/{n}.png", 2, 4, bytes(range(8))) for n in "ab"], "page string, height int, width int, pixels binary")
    summary = jobs.csv_to_trainer(spark, str(tmp_path / "set.csv"), pixels, str(tmp_path / "img"), str(tmp_path / "out"), 4).first()
    assert (summary.converted, summary.failed, summary.symbols) == (2, 2, len(set("onebsay\"")) + 1)
    assert sorted(p.name for p in (tmp_path / "out/images").iterdir()) == ["000000.png", "000003.png"]
    assert read_png((tmp_path / "out/images/000000.png").read_bytes()).shape == (4, 8)
    assert (tmp_path / "out/gt/000003.txt").read_text() == 'say "b"' and (tmp_path / "out/gt/000000.txt").read_text() == "one b"
    lines = lambda name: [r.value for r in spark.read.text(str(tmp_path / "out" / name)).collect()]
    assert lines("lines.txt") == ["000000", "000003"] and lines("symbols.txt")[0] == "<SPACE>" and lines("failed.log") == [f"1: Image not found: {tmp_path}/img/missing.png", "2: Empty text"]
    assert "converted: 2" in lines("conversion_summary.txt")


def test_page_inference(spark):
    page = np.full((60, 50), 255, np.uint8)
    page[5:15], page[30:42] = 2, 7
    table = spark.createDataFrame([("p", 60, 50, page.tobytes()), ("white", 5, 5, bytes([255] * 25))], "page string, height int, width int, pixels binary")
    got = jobs.page_inference(None, table, PngText(), transcribe.ProfileSegmenter(min_height=5, min_gap=2, pad=1)).collect()
    assert [(r.page, r.text) for r in got] == [("p", "c\nh")]
    xml = '<PcGts><Page imageWidth="50" imageHeight="60"><TextRegion id="r"><TextLine id="l2"><Coords points="0,32 50,32 50,40 0,40"/></TextLine><TextLine id="l1"><Coords points="0,6 50,6 50,14 0,14"/></TextLine></TextRegion></Page></PcGts>'
    pages = layout_xml.parse_pages(spark.createDataFrame([("p", xml.encode())], "path string, content binary"))
    assert [r.text for r in jobs.page_inference(pages, table, PngText(), pad=0).collect()] == ["c\nh"]


class Broken:
    name = "broken"

    def load(self):
        pass

    def segment(self, gray):
        raise ValueError("no") if gray.shape[0] == 2 else None


def test_segmenters(spark):
    table = spark.createDataFrame([("a", 2, 2, bytes(4))], "page string, height int, width int, pixels binary")
    assert [(r.page, r.error) for r in transcribe.segment_pages(table, Broken()).collect()] == [("a", "ValueError: no")]
    found = images.segment_rows(images.row_profiles(spark.createDataFrame([("a", 40, 3, bytes(x for y in range(40) for x in [0 if 4 <= y < 24 else 255] * 3))], table.schema)))
    assert [(r.start, r.end) for r in found.collect()] == [(4, 23)]
    assert transcribe.ProfileSegmenter(pad=0).segment(np.array([[0 if 4 <= y < 24 else 255] * 3 for y in range(40)], np.uint8)) == [(0, 4, 3, 23)]


def test_batch_job(spark, tmp_path):
    xml = PAGE.format(year="2013-07-15", order="")
    pages = layout_xml.parse_pages(spark.createDataFrame([("d/a.xml", xml.encode()), ("d/b.xml", xml.encode()), ("d/page/c.xml", b"<broken")], "path string, content binary"))
    shots = spark.createDataFrame([("d/a.png", 200, 100), ("d/b.png", 300, 100), ("d/c.png", 10, 10), ("d/e.png", 10, 10)], "path string, height int, width int")
    auto = spark.createDataFrame([(f"d/{n}.png", "s0", 0, 0, 0, 10, h) for n, h in (("a", 90), ("b", 90), ("c", 90), ("e", 39))], "page string, line_id string, line_idx int, x1 int, y1 int, x2 int, y2 int")
    found, sources = jobs.batch_lines(shots, pages, auto, least_height=15)
    assert {r.page: r.line_source for r in sources.collect()} == {"d/a.png": "xml_used", "d/b.png": "xml_failed", "d/c.png": "xml_failed", "d/e.png": "auto_seg"}
    assert sorted((r.page, r.line_id) for r in found.collect()) == [("d/a.png", "l1"), ("d/a.png", "l2"), ("d/a.png", "l3"), ("d/b.png", "s0"), ("d/c.png", "s0"), ("d/e.png", "s0")]
    assert sorted(r.page for r in jobs.batch_lines(shots, pages, auto)[0].collect()) == ["d/b.png", "d/c.png"]
    work = spark.createDataFrame([("a", "0", 0, b"first"), ("a", "1", 1, b""), ("a", "2", 2, b"third"), ("b", "0", 0, b"\xff"), ("c", "0", 0, b"done")], "page string, line_id string, line_idx int, content binary")
    counts = jobs.run_batch(work, transcribe.EchoTranscriber(), str(tmp_path / "o"), spark.createDataFrame([("c",)], "page string"), engine="echo").first()
    assert (counts.succeeded, counts.failed) == (3, 1)
    assert [(r.value, r.page) for r in spark.read.text(str(tmp_path / "o/transcriptions"), wholetext=True).collect()] == [("first\nthird\n", "a")]
    summary = spark.read.json(str(tmp_path / "o/batch_results.json")).first()
    assert (summary.total_images, summary.total_errors, summary.engine) == (1, 1, "echo")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "o/batch_results.csv")).collect()] == [("a", "3", "10", "0.0333")]
    assert spark.read.option("header", True).csv(str(tmp_path / "o/failures.csv")).first().page == "b"


class Counting:
    """Counts how often it is loaded, by a file for each."""

    name = "counting"

    def __init__(self, folder, by_page):
        self.folder, self.by_page = folder, by_page

    def load(self):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()

    def predict(self, lines):
        return transcribe.EchoTranscriber().predict(lines)


def test_transcribers_load_once_a_worker(spark, tmp_path):
    work = spark.createDataFrame([(f"p{i}", "0", 0, b"x") for i in range(60)], "page string, line_id string, line_idx int, content binary")
    for by_page in (True, False):
        folder = tmp_path / str(by_page)
        folder.mkdir()
        assert transcribe.transcribe(work, Counting(str(folder), by_page)).count() == 60
        transcribe.transcribe(work, Counting(str(folder), by_page)).write.format("noop").mode("overwrite").save()
        assert 1 <= len(list(folder.iterdir())) <= 8
    assert transcribe.available(spark, "ec", only=True).count() == 1 and transcribe.available(spark, "zz").count() == 0


def test_progress_is_observed(spark):
    work = spark.createDataFrame([("a", "0", 0, b"x"), ("b", "0", 0, b"\xff")], "page string, line_id string, line_idx int, content binary")
    rows, seen = quality.observed(transcribe.transcribe(work, transcribe.EchoTranscriber()))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"lines": 2, "failures": 1, "pages": 2}


def test_stream_outcomes(spark):
    events = [("early", 0, " ", 10, 0, 10), ("early", 1, "hi", 10, 1, 11), ("early", 2, " more", 10, 2, 12), ("abort", 0, None, 10, 0, 20), ("abort", 1, None, 10, 0, 80), ("abort", 2, "late", 10, 1, 90), ("none", 0, None, None, None, None), ("blank", 0, "\n", 5, 0, 5), ("text", 0, "a", None, None, None), ("text", 1, "b", 7, 1, 99)]
    df = spark.createDataFrame(events, "call string, seq int, text string, prompt_tok int, cand_tok int, total_tok int")
    got = {r.call: (r.outcome, r.text, r.used, r.prompt_tok) for r in api_log.stream_outcomes(df, budget=100).collect()}
    assert got == {"early": ("early exit", "hi", 2, 10), "abort": ("reasoning abort", "", 2, 10), "none": ("fallback", "", 1, None), "blank": ("fallback", "", 1, 5), "text": ("early exit", "a", 1, None)}
    full = {r.call: (r.outcome, r.text) for r in api_log.stream_outcomes(df, budget=100, early_exit=False).collect()}
    assert full["early"] == ("full", "hi more") and full["text"] == ("full", "ab") and full["abort"] == ("reasoning abort", "")
    assert spark.range(1).select(api_log.encoded_image(F.lit(b"\x00\xff"))).first()[0] == "AP8="


def test_settings_rules(spark):
    base = {"input_exists": True, "model_path": "m", "model_exists": True, "model_id": None, "adapter": None, "adapter_exists": None, "adapter_is_folder": None, "api_key": None, "formats": ["txt"], "only_one": False, "remote": False}
    cases = [({}, None), ({"input_exists": False}, "input folder does not exist"), ({"model_path": None}, "no model"), ({"only_one": True, "model_id": "q"}, "model path and model id"), ({"only_one": True, "model_path": "My-Adapter"}, "model path is an adapter"), ({"only_one": True, "model_path": None, "model_id": "Qwen/Qwen3-8B"}, "model id is of a text model"), ({"only_one": True, "adapter": "a.safetensors"}, "adapter is a file"), ({"remote": True}, "no key"), ({"remote": True, "api_key": "k"}, "no model id"), ({"model_exists": False}, "model file does not exist"), ({"adapter": "a", "adapter_exists": False}, "adapter does not exist"), ({"adapter": "a", "adapter_exists": True, "adapter_is_folder": False}, "adapter is a file"), ({"formats": []}, "no output format")]
    schema = "n int, input_exists boolean, model_path string, model_exists boolean, model_id string, adapter string, adapter_exists boolean, adapter_is_folder boolean, api_key string, formats array<string>, only_one boolean, remote boolean"
    df = spark.createDataFrame([(i, *({**base, **change}.values())) for i, (change, _) in enumerate(cases)], schema)
    assert {r.n: r.error for r in quality.settings_errors(df).collect()} == {i: e for i, (_, e) in enumerate(cases)}


def test_small_operators(spark, tmp_path):
    rows = spark.createDataFrame([("p", "r10", "a", 5, 0), ("p", "r9", "b", 9, 0), ("p", "r10", "c", 1, 0)], "page string, region_id string, line_id string, y1 int, x1 int")
    assert sorted((r.region, r.line_number, r.line_id) for r in layout.regions_by_id(rows).collect()) == [("r_1", 1, "c"), ("r_1", 2, "a"), ("r_2", 1, "b")]
    q = spark.createDataFrame([(3, 1.0, True), (5, 2.0, False)], "lines int, seconds double, fallback boolean")
    assert tuple(layout.segmentation_summary(q).first()) == (2, 1.5, 4.0, 1)
    h = spark.createDataFrame([(10, 4), (30, 4)], "height_before int, height_after int")
    assert tuple(layout.height_ranges(h).first()) == (2, 10, 30, 4, 4)
    file, own = (spark.createDataFrame(x, "idx int, symbol string") for x in ([(1, "a"), (2, "<space>")], [(1, "<SPACE>")]))
    assert [tuple(r) for r in vocabulary.overridden(file, own).collect()] == [(1, " ")]
    assert sorted(map(tuple, vocabulary.overridden(file, own.limit(0), False).collect())) == [(1, "a"), (2, "<space>")]
    widths = spark.createDataFrame([(i, w) for i, w in enumerate([5, 9, 2, 4, 1])], "number int, width int")
    assert [(r.batch, r.padded_width, r.padding) for r in splits.padded_widths(widths, 2).orderBy("number").collect()] == [(0, 9, 4), (0, 9, 0), (1, 4, 2), (1, 4, 0), (2, 1, 0)]
    assert [r.path for r in splits.first_pages(spark.createDataFrame([("b",), ("a",), ("c",)], "path string"), 2).collect()] == ["a", "b"]
    assert spark.range(2).select(layout.region_key(F.when(F.col("id") == 1, "text"), F.col("id"))).collect()[1][0] == "text_1"
    files.write_settings(spark, {"b": 1, "a": [1, "x"]}, str(tmp_path / "s"))
    assert files.read_settings(spark, str(tmp_path / "s")) == {"a": [1, "x"], "b": 1}
    (tmp_path / "t.yaml").write_text("rate: 0.5\nname: x\n")
    assert files.read_settings(spark, str(tmp_path / "t.yaml")) == {"rate": 0.5, "name": "x"}


def test_page_pixels_with_a_decoder(spark, tmp_path):
    from palimpsest.sources import images as source

    (tmp_path / "a.png").write_bytes(images.png(gray([1, 2], [3, 4])))
    (tmp_path / "b.png").write_bytes(b"no image")
    for decode in (read_png, None):
        got = source.page_pixels(spark, str(tmp_path), decode).collect()
        assert [(r.height, r.width, bytes(r.pixels)) for r in got] == [(2, 2, bytes([1, 2, 3, 4]))]


def test_ink_rules():
    rng = np.random.default_rng(2)
    mask = rng.random((12, 15)) < 0.2

    def at(m, y, x, outside):
        return m[y, x] if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] else outside

    def plain_closed(m, h, w):
        span = lambda n: range(-(n // 2), n - n // 2)
        big = np.array([[any(at(m, y + i, x + j, False) for i in span(h) for j in span(w)) for x in range(m.shape[1])] for y in range(m.shape[0])])
        return np.array([[all(at(big, y - i, x - j, True) for i in span(h) for j in span(w)) for x in range(m.shape[1])] for y in range(m.shape[0])])

    for h, w in ((3, 5), (1, 4), (3, 1)):
        assert (images.closed(mask, h, w) == plain_closed(mask, h, w)).all()
        assert (images.closed(mask, h, w) >= mask).all()
    gray_ = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    padded = np.pad(gray_.astype(float), 2, mode="edge")
    want = np.array([[gray_[y, x] < padded[y : y + 5, x : x + 5].mean() - 10 for x in range(11)] for y in range(9)])
    assert (images.locally_dark(gray_, 5, 10) == want).all()
    assert np.allclose(images.smoothed(np.full((6, 7), 9.0)), 9) and images.smoothed(np.eye(1, 21, 10)).argmax() == 10
    page = np.full((60, 80), 250, np.uint8)
    page[10:20, 5:70:3] = page[40:52, 5:70:3] = 10
    for rule in ("otsu", "combined", "wide"):
        found = transcribe.ProfileSegmenter(min_height=5, pad=0, rule=rule).segment(page)
        assert len(found) == 2 and all(abs(a - b) <= 5 for (_, y1, _, y2), (s, e) in zip(found, ((10, 19), (40, 51)), strict=True) for a, b in ((y1, s), (y2, e)))


def test_resampling():
    flat = np.full((7, 9), 77, np.uint8)
    assert (images.resampled(flat, 3, 20) == 77).all() and images.resized_to_height(flat, 14).shape == (14, 18)
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    assert (images.resampled(ramp, 4, 20) == ramp).all() and abs(images.resampled(ramp, 4, 10)[0, 1:-1].astype(int) - np.arange(25, 185, 20)).max() <= 2


def test_upright_crops(spark):
    page = np.full((80, 80), 200, np.uint8)
    table = spark.createDataFrame([("p", 80, 80, page.tobytes())], "page string, height int, width int, pixels binary")
    box = [{"x": x, "y": y} for x, y in ((10, 20), (60, 20), (60, 40), (10, 40))]
    thin = [{"x": x, "y": y} for x, y in ((10, 20), (60, 20), (60, 23), (10, 23))]
    rows = spark.createDataFrame([("p", "a", 10, 20, 60, 40, box, 0.2), ("p", "b", 10, 20, 60, 23, thin, 0.0), ("p", "c", 10, 20, 60, 40, box, 30.0), ("p", "d", 10, 20, 60, 40, None, None)], "page string, line_id string, x1 int, y1 int, x2 int, y2 int, coords array<struct<x:int,y:int>>, angle double")
    got = {r.line_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in images.line_images(rows, table, mask=True, deskew=True).collect()}
    assert got.keys() == {"a", "c", "d"} and got["a"].shape == got["c"].shape == (20, 50) and (got["a"] == 200).all()
    assert got["d"].shape == (30, 60) and 0 < (got["c"] == 200).mean() < 1


def test_corpus_and_evaluation(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("ab b\n\n c\n")
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.xml").write_text(PAGE.format(year="2013-07-15", order=""))
    corpus, counts = jobs.language_model_counts(spark, str(tmp_path / "t"), "text")
    assert sorted(r.tokens for r in corpus.collect()) == ["a b <SPACE> b", "c"]
    assert {r.gram: r["count"] for r in counts.collect()} == {"a": 1, "b": 2, " ": 1, "c": 1, "ab": 1, "b ": 1, " b": 1, "ab ": 1, "b b": 1, "ab b": 1}
    assert jobs.language_model_counts(spark, str(tmp_path / "x"))[0].count() == 3
    rows = spark.createDataFrame([(1, "abcd", "abxd"), (2, "", "x")], "id int, reference string, hypothesis string")
    total = jobs.write_evaluation(rows, str(tmp_path / "e")).first()
    assert (total.samples, total.cer, total.micro_cer) == (2, 0.625, 0.5)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "e")).collect()] == [("1", "abcd", "abxd", "0.25"), ("2", None, "x", "1.0")]
    assert [r.id for r in jobs.preview(rows, "id", most=1).collect()] == [1]


def test_document_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / f"in/{name}.xml").write_text(PAGE.format(year="2013-07-15", order=""))
    shots = spark.createDataFrame([(f"file:{tmp_path}/in/{n}.png",) for n in "ab"], "path string")
    n, counts = jobs.page_to_parquet(spark, str(tmp_path / "in"), shots, str(tmp_path / "out"), most_pages=1)
    assert n == 3 and {r.ch: r.n for r in counts.collect()}["&"] == 1
    pages = layout_xml.parse_pages(layout_xml.read_xml(spark, str(tmp_path / "in")))
    pixels = spark.createDataFrame([(f"file:{tmp_path}/in/{x}.png", 200, 100, bytes([9]) * 20_000) for x in "ab"], "page string, height int, width int, pixels binary")
    summary = jobs.polygon_set(pages, shots, pixels, str(tmp_path / "set"), 16).first()
    assert (summary.converted, summary.failed) == (4, 2)
    found = spark.createDataFrame([("p", "r", 0, "l", 0, 1, 2, 30, 20, "neural")], "page string, region_id string, region_idx int, line_id string, line_idx int, x1 int, y1 int, x2 int, y2 int, mode string").withColumns({"image_name": F.lit("i.png"), "page_width": F.lit(50), "page_height": F.lit(40), "text": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "coords": F.lit(None).cast("array<struct<x:int,y:int>>"), "baseline": F.array(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")), F.struct(F.lit(30).alias("x"), F.lit(2).alias("y")))})
    totals = jobs.segmentation_batch(found, str(tmp_path / "seg")).first()
    assert (totals.pages, totals.avg_lines, totals.fallbacks) == (1, 1.0, 0) and spark.read.text(str(tmp_path / "seg/page_xml")).count() > 0
    regions = layout.segmented_regions(found, "page", F.lit(50)).first()
    assert (regions.region, regions.lines, len(regions.hull)) == ("col_1", 1, 4)
