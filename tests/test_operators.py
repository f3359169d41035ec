from pyspark.sql import functions as F

from palimpsest.operators import api_log, images, layout, lines, pairing, quality, sequences, splits, training_log, vocabulary
from palimpsest.operators.transcribe import EchoTranscriber, available, transcribe


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ctc(spark):
    steps = spark.createDataFrame([("l", t, c) for t, c in enumerate([0, 1, 1, 0, 1, 2, 2, 0])], "line string, t int, idx int")
    assert rows(sequences.ctc_collapse(steps, "line"), "pos", "idx") == [(0, 1), (1, 1), (2, 2)]
    logits = spark.createDataFrame([("l", t, c, -1.0 if c != best else -0.1) for t, best in enumerate([1, 1, 0, 9]) for c in (0, 1, 9)] + [("m", 0, 0, -0.1)], "line_id string, t int, cls int, logp double")
    symbols = spark.createDataFrame([(1, "a")], "idx int, symbol string")
    got = {r.line_id: r for r in sequences.ctc_decode(logits, symbols).collect()}
    assert got["l"].text == "a" and abs(got["l"].confidence - 0.904837) < 1e-5
    assert (got["m"].text, got["m"].confidence) == ("", 0.0)


def test_repeats_and_padding(spark):
    texts = spark.createDataFrame([("p", i, t) for i, t in enumerate(["a", "a", "", "", "b", "a"])], "page string, idx int, text string")
    assert [t for _, t in rows(sequences.keep_first_of_repeats(texts, "page", ["idx"], "text"), "idx", "text")] == ["a", "", "", "b", "a"]
    assert [t for _, t in rows(sequences.keep_first_of_repeats(texts, "page", ["idx"], "text", blank=True), "idx", "text")] == ["a", "", "", "", "b", "a"]
    wanted = spark.createDataFrame([("p", 8), ("q", 0)], "page string, n int")
    assert sequences.padded_results(texts, wanted, "page").count() == 8


def test_runs_and_merges(spark):
    profile = spark.createDataFrame([("p", y, y in (1, 2, 4, 8, 9, 10)) for y in range(12)], "page string, y int, on boolean")
    assert rows(sequences.runs(profile, "page", "y", "on", 2, 2), "first", "last") == [(1, 4), (8, 10)]
    parts = spark.createDataFrame([("p", 0, 20), ("p", 30, 50), ("p", 61, 80)], "page string, s int, e int")
    assert rows(sequences.merge_close(parts, "page", "s", "e", 10), "start", "end") == [(0, 50), (61, 80)]


def test_columns(spark):
    lines = spark.createDataFrame([("p", f"l{i}", c - 10, 5 * i, c + 10, 5 * i + 20) for i, c in enumerate([100, 110, 120, 600, 610, 620])], "page string, line_id string, x1 int, y1 int, x2 int, y2 int")
    assert [c for _, c in rows(layout.columns_of_lines(lines, "page", F.lit(1000)), "line_id", "column")] == [0, 0, 0, 1, 1, 1]
    assert rows(layout.segmented_pages(lines, "page", F.lit(1000)), "line_id", "region", "line_number")[3] == ("l3", "col_2", 1)
    regions = spark.createDataFrame([("p", "left", 0, 0, 0, 300, 900), ("p", "all", 1, 0, 0, 605, 900)], "page string, region_id string, region_idx int, x1 int, y1 int, x2 int, y2 int")
    assert [r for _, r in rows(layout.region_of_lines(lines, regions, "page"), "line_id", "region_id")] == ["left", "left", "left", "all", "r_1", "r_1"]


def test_reading_order(spark):
    regions = spark.createDataFrame([("p", r, i) for i, r in enumerate("abcd")], "page string, region_id string, region_idx int")
    order = spark.createDataFrame([("p", "c", 0, 0), ("p", "a", 1, 1), ("p", "gone", 2, 2)], "page string, region_id string, order_idx int, ref_idx int")
    assert rows(layout.order_regions(regions, order), "position", "region_id") == [(0, "c"), (1, "a"), (2, "b"), (3, "d")]


def test_quality(spark):
    base = "array<struct<x:int,y:int>>"
    lines = spark.createDataFrame([("p", "r", 0, 0, 10, 10, [(0, 0), (3, 4)]), ("p", "r", 0, 0, 10, 20, None)], f"page string, region_id string, x1 int, y1 int, x2 int, y2 int, baseline {base}")
    got = layout.segmentation_quality(lines, "page").first()
    assert (got.regions, got.lines, got.mean_line_height, got.height_variance, got.baseline_ratio) == (1, 2, 15.0, 25.0, 0.5)
    valid = lambda *v: spark.range(1).select(quality.page_is_valid(*[F.lit(x) for x in v])).first()[0]
    assert valid(True, 100, 100, 110, 90, 1) and not valid(True, 100, 100, 111, 100, 1) and not valid(True, 100, 100, 100, 100, 0)


def test_early_stopping(spark):
    history = spark.createDataFrame([("r", e, v) for e, v in enumerate([0.5, 0.4, 0.45, 0.41, 0.42], 1)], "run string, epoch int, val_cer double")
    assert rows(training_log.early_stopping(history, patience=2), "epoch", "is_best", "stopped") == [(1, True, False), (2, True, False), (3, False, False), (4, False, True)]
    rates = [r for _, r in rows(training_log.plateau_rates(history, metric="val_cer", rate=1.0, patience=1), "epoch", "learning_rate")]
    assert rates == [1.0, 1.0, 1.0, 0.5, 0.5]


def test_split_is_exact_and_stable(spark):
    data = spark.range(1003).withColumn("text", F.lit("x"))
    got = splits.train_val_split(data, "id")
    assert got.where("split = 'train'").count() == 802 and got.count() == 1003
    assert rows(got, "id", "split") == rows(splits.train_val_split(data.repartition(7), "id"), "id", "split")
    assert {r[1] for r in rows(splits.train_val_split(data.limit(0), "id"), "id", "split")} == set()


def test_vocabulary(spark):
    lines = spark.createDataFrame([(0, "<ctc> 0"), (1, "a 1"), (2, "<space> 2")], "line_idx int, text string")
    assert rows(vocabulary.parse_vocabulary_lines(lines), "idx", "symbol") == [(1, "a"), (2, " ")]
    listed = spark.createDataFrame([(0, "<ctc>"), (1, "b")], "line_idx int, text string")
    assert rows(vocabulary.parse_vocabulary_lines(listed), "idx", "symbol") == [(1, "b")]


def test_priority_pairing(spark):
    xml = spark.createDataFrame([("/d/page/a.xml",), ("/d/b.xml",), ("/d/c.xml",)], "path string")
    images_df = spark.createDataFrame([("/d/a.png",), ("/d/a.jpg",), ("/d/page/b.png",), ("/d/b.png",)], "path string")
    assert rows(pairing.xml_with_images(xml, images_df), "xml_path", "image_path") == [("/d/b.xml", "/d/b.png"), ("/d/page/a.xml", "/d/a.jpg")]
    found = {r.image_path: r.xml_path for r in pairing.images_with_xml(images_df, xml).collect()}
    assert found == {"/d/a.png": "/d/page/a.xml", "/d/a.jpg": "/d/page/a.xml", "/d/page/b.png": None, "/d/b.png": "/d/b.xml"}


def test_transcription_isolates_failures(spark):
    class Picky(EchoTranscriber):
        def predict(self, lines):
            if any(c == b"bad" for c in lines["content"]):
                raise ValueError("bad line")
            return super().predict(lines)

    work = spark.createDataFrame([("p", str(i), i, c) for i, c in enumerate([b"one", b"bad", b"two"])], "page string, line_id string, line_idx int, content binary")
    got = {r.line_id: (r.text, r.error) for r in transcribe(work, Picky()).collect()}
    assert got == {"0": ("one", None), "1": (None, "ValueError: bad line"), "2": ("two", None)}
    assert transcribe(work.limit(0), EchoTranscriber()).count() == 0
    assert available(spark).first().name == "echo"


def test_chunks(spark):
    chunks = spark.createDataFrame([("k", 0, "hello wor"), ("k", 1, "world, "), ("k", 2, ""), ("k", 3, "never")], "key string, chunk int, text string")
    assert tuple(api_log.joined_chunks(chunks, "key").first()) == ("k", "hello world, ", 2)


def test_image_segmentation(spark):
    import numpy as np

    page = np.full((60, 40), 255, np.uint8)
    page[5:20, 4:36] = 0
    page[40:58, 4:36] = 0
    one = spark.createDataFrame([("p", 60, 40, page.tobytes())], "page string, height int, width int, pixels binary")
    assert rows(images.segment_rows(images.row_profiles(one)), "start", "end") == [(5, 19), (40, 57)]
    assert images.ink_extent(page, (0, 0, 40, 30)) == (5, 19)
    lines = spark.createDataFrame([("p", 0, 0, 40, 30), ("q", 1, 2, 3, 4)], "page string, x1 int, y1 int, x2 int, y2 int")
    assert rows(images.tightened_lines(lines, one), "page", "ink_top", "ink_bottom") == [("p", 5, 19), ("q", 2, 4)]


def test_line_images(spark):
    import numpy as np

    page = np.tile(np.arange(100, dtype=np.uint8), (50, 1))
    coords = [(10, 10), (30, 10), (30, 30), (10, 30)]
    lines = spark.createDataFrame([("p", "a", 10, 10, 30, 30, coords, 0.0), ("p", "gone", 200, 10, 230, 30, None, 0.0), ("q", "b", 0, 0, 5, 5, None, 0.0)], "page string, line_id string, x1 int, y1 int, x2 int, y2 int, coords array<struct<x:int,y:int>>, angle double")
    one = spark.createDataFrame([("p", 50, 100, page.tobytes())], "page string, height int, width int, pixels binary")
    got = images.line_images(lines, one, mask=True).collect()
    assert [(r.line_id, r.height, r.width) for r in got] == [("a", 30, 30)]
    pixels = np.frombuffer(got[0].pixels, np.uint8).reshape(30, 30)
    assert pixels[0, 0] == 255 and pixels[10, 10] == 15
    assert images.line_images(lines, one, target_height=15, deskew=True, equalise=True).first().width == 15
    assert images.rotated(np.array([[1, 2], [3, 4]], np.uint8), 90).tolist() == [[2, 4], [1, 3]]
    assert (images.resized(page, 50, 100) == page).all() and images.equalised(page).shape == page.shape


def test_upserts(spark):
    store = spark.createDataFrame([("a", 1, "old"), ("b", 1, "stays")], "name string, at int, value string")
    changes = spark.createDataFrame([("a", 1, "new"), ("c", 2, "more")], "name string, at int, value string")
    assert rows(pairing.upserted(store, changes, "name", "at"), "name", "value") == [("a", "new"), ("b", "stays"), ("c", "more")]


def test_grouped_regions(spark):
    rows = [("many", f"l{k:02}", 10 + 300 * (k % 2), 20 * (k // 2), 90 + 300 * (k % 2), 20 * (k // 2) + 15, None) for k in range(40)]
    rows += [("few", "a", 0, 50, 9, 70, None), ("few", "b", 0, 10, 9, 30, None), ("two", "c", 0, 50, 9, 70, "text_1"), ("two", "d", 0, 10, 9, 30, "note_0"), ("two", "flat", 0, 0, 9, 7, "note_0")]
    df = spark.createDataFrame(rows, "page string, line_id string, x1 int, y1 int, x2 int, y2 int, region_id string")
    got = {(r.page, r.line_id): (r.region, r.line_number) for r in layout.grouped_regions(df, "page", F.lit(400)).collect()}
    want = {("many", f"l{k:02}"): (f"r_{k % 2 + 1}", k // 2 + 1) for k in range(40)} | {("few", "b"): ("r_1", 1), ("few", "a"): ("r_1", 2), ("two", "d"): ("r_1", 1), ("two", "c"): ("r_2", 1)}
    assert got == want
    whole = {(r.page, r.region) for r in layout.grouped_regions(df, "page", F.lit(400), crowded=41).where("page = 'many'").collect()}
    assert whole == {("many", "r_1")}


def test_lines_end_at_every_kind_of_line_break(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n\r\r\nd"), (2, "e\nf"), (3, None), (4, ""), (5, "\r")], "id int, text string")
    assert rows(lines.text_lines(docs, "id"), "id", "line_idx", "text") == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 5, "d"), (2, 0, "e"), (2, 1, "f")]
    assert rows(lines.text_lines(docs, "id", keep_blank=True).where("id > 2"), "id", "line_idx", "text") == [(4, 0, ""), (5, 0, ""), (5, 1, "")]
