from pyspark.sql import functions as F

from palimpsest.operators.transcribe import EchoTranscriber
from palimpsest.plans import pipelines
from palimpsest.sources import files, layout_xml, lines, sinks
from palimpsest.streaming.ingest import transcribe_stream, watched_files

PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/{year}"><Page imageFilename="a.jpg" imageWidth="100" imageHeight="200">
{order}<TextRegion id="r1"><Coords points="0,90 50,100"/><TextLine id="l1"><Coords points="0,90 60,90 60,100 0,100"/><Word><TextEquiv><Unicode>word</Unicode></TextEquiv></Word><TextEquiv conf="0.5"><Unicode> first &amp; line </Unicode></TextEquiv></TextLine>
<TextRegion id="in"><Coords points="0,95 5,99"/><TextLine><Coords points="0,95 19,95 19,99"/><TextEquiv><Unicode>thin</Unicode></TextEquiv></TextLine></TextRegion></TextRegion>
<TextRegion id="r2"><Coords points="0,10 50,20"/><TextLine id="l2"><Coords points="0,10 30,10 30,20"/></TextLine><TextLine id="l3"><Coords points="0,10 20,10 20,20"/><TextEquiv><Unicode>second</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="r3"/></Page></PcGts>"""
ORDER = '<ReadingOrder><OrderedGroup id="o"><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="0" regionRef="r2"/><RegionRefIndexed index="2" regionRef="gone"/></OrderedGroup></ReadingOrder>'


def pages(spark, *contents):
    return layout_xml.parse_pages(spark.createDataFrame([(f"p{i}", c.encode()) for i, c in enumerate(contents)], "path string, content binary"), "auto")


def test_page_lines(spark):
    got = lines.page_lines(pages(spark, PAGE.format(year="2013-07-15", order=""), PAGE.format(year="2019-07-15", order=ORDER), "<broken"))
    assert sorted((r.path, r.region_id, r.line_id, r.text, r.width) for r in got.collect()) == [(p, *x) for p in ("p0", "p1") for x in [("r1", "l1", "first & line", 60), ("r2", "l3", "second", 20)]]
    assert pages(spark, "<broken", "<PcGts/>").where("error is not null").count() == 2


def test_page_texts(spark):
    got = {r.path: r.text for r in lines.page_texts(pages(spark, PAGE.format(year="2013-07-15", order=ORDER), PAGE.format(year="2013-07-15", order=""), "<PcGts><Page/></PcGts>")).collect()}
    assert got == {"p0": "\nsecond\nfirst & line\nthin\n", "p1": "\nsecond\nfirst & line\nthin\n", "p2": ""}


def test_nested_lines_twice(spark):
    found = lines.exploded_lines(pages(spark, PAGE.format(year="2013-07-15", order="")), nested_twice=True)
    assert sorted(r.region_id for r in found.where("text = 'thin'").collect()) == ["in", "r1"]


def test_alto(spark):
    alto = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><sourceImageInformation><fileName>x.jpg</fileName></sourceImageInformation></Description><Layout><Page WIDTH="500" HEIGHT="400"><PrintSpace><TextBlock ID="b">
    <TextLine ID="l" HPOS="10" VPOS="20" WIDTH="100" HEIGHT="30"><String CONTENT="ab"/><SP/><String CONTENT="c"/></TextLine><TextLine HPOS="1" VPOS="2" WIDTH="19" HEIGHT="3"><String CONTENT="thin"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""
    got = lines.alto_lines(pages(spark, alto)).collect()
    assert [(r.line_id, r.text, r.x1, r.y1, r.x2, r.y2, r.image_name) for r in got] == [("l", "ab c", 10, 20, 110, 50, "x.jpg")]


def test_page_xml_round_trip(spark):
    found = lines.page_lines(pages(spark, PAGE.format(year="2013-07-15", order="")))
    out = sinks.page_xml(found.withColumnRenamed("path", "page").withColumn("confidence", F.col("conf")))
    again = lines.page_lines(layout_xml.parse_pages(out.select(F.col("page").alias("path"), F.col("xml").cast("binary").alias("content"))))
    key = ["region_id", "line_id", "text", "x1", "y1", "x2", "y2"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, found.select(*key).collect()))


def test_line_lists(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a b.png some .png text\n000001\n")
    got = sorted(map(tuple, files.read_line_list(spark, str(tmp_path / "lines.txt")).collect()))
    assert got == [("000001", None, True), ("a b.png", "some .png text", False)]
    (tmp_path / "t.csv").write_text('x.png,NA\ny.png,"a ""b"""\n')
    assert sorted(map(tuple, files.read_pairs_csv(spark, str(tmp_path / "t.csv")).collect())) == [("x.png", "NA"), ("y.png", 'a "b"')]


def test_datasets(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.xml").write_text(PAGE.format(year="2013-07-15", order=""))
    (tmp_path / "mets.xml").write_text("<x/>")
    got = pipelines.line_dataset(spark, str(tmp_path))
    info = pipelines.dataset_summary(got).first()
    assert (info.num_train, info.num_val, info.pages_processed) == (8, 2, 5)


def test_comparison(spark):
    r = spark.createDataFrame([("p", 1, "hello"), ("p", 2, "world"), ("p", 3, "more")], "page string, line int, text string")
    h = spark.createDataFrame([("p", 1, "helo"), ("p", 2, "world")], "page string, line int, text string")
    got = [(x.line, x.cer, x.match, x.distance) for x in pipelines.comparison(r, h).collect()]
    assert got == [("1", 20.0, 80.0, 1), ("2", 0.0, 100.0, 0), ("OVERALL", 10.0, 90.0, 1)]


def test_watched_folder_is_done_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")

    def go():
        work = watched_files(spark, str(inbox), "*.txt").select(F.col("path").alias("page"), F.lit("l").alias("line_id"), F.lit(0).alias("line_idx"), "content")
        transcribe_stream(work, EchoTranscriber(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out/lines")).collect())

    assert go() == ["one"]
    (inbox / "b.txt").write_text("two")
    assert go() == ["one", "two"]


def test_images(spark, tmp_path):
    import struct
    import zlib

    from palimpsest.sources import images

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes([10 * y] * 3) for y in range(2))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = images.page_pixels(spark, str(tmp_path)).collect()
    assert [(r.height, r.width, r.orientation, bytes(r.pixels)) for r in got] == [(2, 3, 1, bytes([0] * 3 + [10] * 3))]
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHIHH", images.ORIENTATION, 3, 1, 6, 0)
    body = b"Exif\0\0" + tiff
    assert images.exif_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda") == 6
    assert images.turned(images.np.array([[1, 2], [3, 4]]), 6).tolist() == [[3, 1], [4, 2]]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    import pytest

    from palimpsest.session import shared_dir

    def session(master, folder=None):
        conf = Fake(get=lambda *_: folder)
        return Fake(conf=conf, sparkContext=Fake(master=master, getConf=lambda: conf))

    assert shared_dir(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y" and shared_dir(session("local[*]")) == shared_dir(session("local"))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))
