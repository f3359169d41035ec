"""Layout files parsed by SQL functions against the XML parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import layout_columns, layout_xml

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
NS = {2013: ' xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"', 2019: ' xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"'}
LINE = '<TextLine id="l{0}" custom="readingOrder {{index:{0};}}"><Coords points="0,{0} 20,{0} 20,9"/><Baseline points="1,2 3,4"/><TextEquiv conf="0.{0}"><Unicode> text {0} &amp; so </Unicode></TextEquiv></TextLine>'


def page(body, ns=NS[2013], size='imageWidth="100" imageHeight="50"', head=HEAD):
    return f'{head}<PcGts{ns}><Metadata><Creator>x</Creator></Metadata><Page imageFilename="a.png" {size}>{body}</Page></PcGts>'


def region(name, *lines, more=""):
    return f'<TextRegion id="{name}" type="paragraph" custom="readingOrder {{index:1;}}"><Coords points="0,0 9,9"/>{"".join(lines)}{more}</TextRegion>'


ORDER = '<ReadingOrder><OrderedGroup id="o"><RegionRefIndexed index="1" regionRef="b"/><RegionRefIndexed index="0" regionRef="a"/><RegionRefIndexed index="x" regionRef="gone"/></OrderedGroup></ReadingOrder>'
PAGES = {
    "order": page(ORDER + region("a", LINE.format(1), LINE.format(2)) + region("b", LINE.format(3)) + region("free")),
    "no order, no coords": page('<TextRegion id="q"/>' + region("b", LINE.format(3)), ns=NS[2019]),
    "no namespace, no ids": page("<TextRegion><TextLine/><TextLine id=''><TextEquiv/></TextLine></TextRegion>", ns=""),
    "blank texts": page(region("a", "<TextLine id='x'><TextEquiv><Unicode/></TextEquiv></TextLine>", "<TextLine id='y'><TextEquiv><Unicode>  \n </Unicode></TextEquiv></TextLine>", "<TextLine id='z'><Coords/><TextEquiv><Unicode></Unicode></TextEquiv></TextLine>")),
    "several texts": page(region("a", "<TextLine id='x'><TextEquiv conf='1'/><TextEquiv conf='.5'><Unicode>second</Unicode><Unicode>third</Unicode></TextEquiv></TextLine>", more="<TextEquiv><Unicode>of the region</Unicode></TextEquiv>")),
    "floats": page(region("a", '<TextLine id="p"><Coords points="1.5,2 x,3 4,5"/><TextEquiv conf="high"><Unicode>é 😀 &lt;x&gt; &#228;</Unicode></TextEquiv></TextLine>'), size='imageWidth="100.7" imageHeight="no"'),
    "other regions": page('<ImageRegion id="i"><Coords points="1,1"/></ImageRegion>' + region("a", LINE.format(1)) + "<SeparatorRegion/>" + region("b")),
    "no size": page(region("a"), size=""),
    "no regions": page(""),
}
ODD = {
    "nested region": page(region("a", LINE.format(1), more=region("inner", LINE.format(2)))),
    "region in a table": page(f'<TableRegion id="t">{region("cell", LINE.format(1))}</TableRegion>' + region("b")),
    "words first": page(region("a", "<TextLine id='x'><Word id='w'><TextEquiv><Unicode>word</Unicode></TextEquiv></Word><TextEquiv><Unicode>whole line</Unicode></TextEquiv></TextLine>")),
    "unordered group": page('<ReadingOrder><OrderedGroup><UnorderedGroup><RegionRefIndexed index="0" regionRef="a"/></UnorderedGroup></OrderedGroup></ReadingOrder>' + region("a")),
    "prefix": '<p:PcGts xmlns:p="u"><p:Page imageWidth="1"><p:TextRegion id="a"/></p:Page></p:PcGts>',
    "comment": page("<!-- <TextRegion id='no'/> -->" + region("a")),
    "section": page(region("a", "<TextLine><TextEquiv><Unicode><![CDATA[<TextLine>]]></Unicode></TextEquiv></TextLine>")),
    "no page": HEAD + "<PcGts/>",
    "broken": page(region("a"))[:-20],
    "empty": "",
    "no xml": "text",
    "other encoding": page(region("a", LINE.format(1)).replace("text", "täxt"), head='<?xml version="1.0" encoding="ISO-8859-1"?>\n').encode("latin-1"),
    "byte order mark": "﻿" + page(region("a")),
}


def alto(body, head=HEAD, ns=' xmlns="http://www.loc.gov/standards/alto/ns-v4#"', name="<fileName>b.jpg</fileName>"):
    return f'{head}<alto{ns}><Description><sourceImageInformation>{name}</sourceImageInformation></Description><Layout><Page WIDTH="10" HEIGHT="20.5"><PrintSpace>{body}</PrintSpace></Page></Layout></alto>'


ALTO = {
    "alto lines": alto('<TextBlock ID="r"><Shape><Polygon POINTS="1 2 3 4"/></Shape><TextLine ID="l" BASELINE="1 2" HPOS="1" VPOS="2.5" WIDTH="x" HEIGHT="4"><String CONTENT="Vsaki"/><SP/><String CONTENT="člov&quot;k"/><SP WIDTH="3"/></TextLine><TextLine/></TextBlock><TextBlock/>'),
    "alto spaces": alto('<TextBlock><TextLine><SP/><SP/><String CONTENT=" a "/><SP/><SP/><String/><String CONTENT="b"/></TextLine></TextBlock>', name=""),
    "alto bare": alto("", ns=""),
}
ODD_ALTO = {
    "alto deep": alto('<TextBlock><TextLine><Group><String CONTENT="deep"/></Group></TextLine></TextBlock>'),
    "alto composed": alto('<ComposedBlock><TextBlock ID="c"><TextLine ID="q"><String CONTENT="in"/></TextLine></TextBlock></ComposedBlock>'),
    "alto long space": alto('<TextBlock><TextLine><String CONTENT="a"/><SP></SP><String CONTENT="b"/></TextLine></TextBlock>'),
}


def files_of(spark, docs):
    return spark.createDataFrame([(k, v if isinstance(v, bytes) else v.encode()) for k, v in docs.items()], "path string, content binary")


def rows_of(df):
    return {r.path: json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect()}


@pytest.mark.parametrize("kind, docs", [("page", PAGES | ODD), ("alto", ALTO | ODD_ALTO | {"broken alto": alto("")[:-3]}), ("auto", PAGES | ODD | ALTO | ODD_ALTO)])
def test_all_files_come_out_as_from_the_parser(spark, kind, docs):
    files = files_of(spark, docs)
    got, want = rows_of(layout_xml.parse_pages(files, kind)), rows_of(layout_xml.parse_pages_by_parser(files, kind))
    for name in docs:
        assert got[name] == want[name], name


def test_only_odd_files_need_the_parser(spark):
    for docs, odd, columns in ((PAGES, ODD, layout_columns.page_columns), (ALTO, ODD_ALTO, layout_columns.alto_columns)):
        files = files_of(spark, docs | odd)
        left = {r.path for r in files.select("path", columns(F.col("content")).alias("x")).where("x is null").collect()}
        assert left == set(odd)


def test_random_pages(spark):
    rng = random.Random(2)
    docs = {}
    for k in range(60):
        lines = lambda: [rng.choice([LINE.format(rng.randint(0, 9)), "<TextLine/>", "<TextLine><TextEquiv><Unicode>a</Unicode></TextEquiv></TextLine>", "<TextLine custom='c'><Word><TextEquiv><Unicode>w</Unicode></TextEquiv></Word></TextLine>"]) for _ in range(rng.randint(0, 5))]
        docs[str(k)] = page(rng.choice(["", ORDER]) + "".join(region(f"r{i}", *lines(), more=rng.choice(["", "", region("n", *lines())])) for i in range(rng.randint(0, 4))), ns=rng.choice([*NS.values(), ""]))
    files = files_of(spark, docs)
    assert rows_of(layout_xml.parse_pages(files)) == rows_of(layout_xml.parse_pages_by_parser(files))
    plan = layout_xml.parse_pages(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
