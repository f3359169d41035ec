"""PAGE and ALTO layout XML parsed by Spark's from_xml: no file leaves the JVM unless columns would lose something of it.

A schema keeps neither what stands outside of it nor the order of different children. So the elements that matter are counted
in the text and in what the schema took: where the numbers are equal, nothing is nested, doubled or elsewhere. Spaces between
the words of an ALTO line (SP) are made words of one space beforehand, which keeps their place. Files of other encodings, with
prefixed names, comments or sections around elements, broken files, and those with other counts get a null here, and go
through the parser in layout_xml."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = "_id STRING, _custom STRING, Coords ARRAY<STRUCT<_points STRING>>, Baseline ARRAY<STRUCT<_points STRING>>, TextEquiv ARRAY<STRUCT<_conf STRING, Unicode ARRAY<STRING>>>"
PAGE_SCHEMA = f"""
Page ARRAY<STRUCT<_imageFilename STRING, _imageWidth STRING, _imageHeight STRING,
  ReadingOrder ARRAY<STRUCT<OrderedGroup ARRAY<STRUCT<RegionRefIndexed ARRAY<STRUCT<_index STRING, _regionRef STRING>>>>>>,
  TextRegion ARRAY<STRUCT<_id STRING, _type STRING, _custom STRING, Coords ARRAY<STRUCT<_points STRING>>,
    TextLine ARRAY<STRUCT<{_LINE}>>, TextEquiv ARRAY<STRUCT<Unicode ARRAY<STRING>>>>>>>
"""
_SHAPE = "Shape ARRAY<STRUCT<Polygon ARRAY<STRUCT<_POINTS STRING>>>>"
ALTO_SCHEMA = f"""
Description ARRAY<STRUCT<sourceImageInformation ARRAY<STRUCT<fileName ARRAY<STRING>>>>>,
Layout ARRAY<STRUCT<Page ARRAY<STRUCT<_WIDTH STRING, _HEIGHT STRING, PrintSpace ARRAY<STRUCT<TextBlock ARRAY<STRUCT<_ID STRING, _TYPE STRING, {_SHAPE},
  TextLine ARRAY<STRUCT<_ID STRING, _BASELINE STRING, _HPOS STRING, _VPOS STRING, _WIDTH STRING, _HEIGHT STRING, {_SHAPE},
    String ARRAY<STRUCT<_CONTENT STRING>>>>>>>>>>>>
"""
_OPTIONS = {"mode": "PERMISSIVE", "attributePrefix": "_", "ignoreSurroundingSpaces": "false", "nullValue": "\x01"}

#: Shapes of what comes out, as in layout_xml.PAGES.
_REGION_ORDER = "array<struct<region_id:string,order_idx:int,ref_idx:int>>"


def _number(text: Column, kind: str = "double") -> Column:
    return text.try_cast("double").cast(kind)


def _sum(items: Column, size) -> Column:
    """The sum of size(x) over an array that may be null."""
    return F.aggregate(F.coalesce(items, F.array()), F.lit(0), lambda s, x: s + size(x))


def _n(array: Column) -> Column:
    return F.when(array.isNull(), 0).otherwise(F.size(array))


def _elements(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(f"<{name}[\\s>/]"))


def _whole(text: Column, root: str) -> Column:
    """Documents that a schema can take: UTF-8, without prefixes, comments, sections and entities of their own."""
    head = F.left(text, F.lit(2000))
    encoding = F.lower(F.regexp_extract(head, "^<\\?xml[^>]*?encoding=[\"']([^\"']*)", 1))
    return F.startswith(text, F.lit("<")) & encoding.isin("", "utf-8", "utf8") & F.contains(head, F.lit(f"<{root}")) & ~text.rlike("<!|<\\w+:|\\x01")


def _namespace(text: Column, root: str) -> Column:
    found = F.regexp_extract(F.left(text, F.lit(2000)), f"<{root}\\b[^>]*?\\sxmlns=[\"']([^\"']*)", 1)
    return F.when(found != "", found)


def _or_id(own: Column, other: Column) -> Column:
    return F.coalesce(F.when(own != "", own), other)


def _nothing(shape: str) -> Column:
    return F.array().cast(shape)


def page_columns(content: Column) -> Column:
    """A struct with the columns of layout_xml.PAGES but the path, null where the parser is needed."""
    text = content.cast("string")
    parsed = F.when(_whole(text, "PcGts"), F.from_xml(text, PAGE_SCHEMA, _OPTIONS | {"rowTag": "PcGts"}))
    bound = F.transform(F.array(F.struct(text.alias("t"), parsed.alias("x"))), _page_of)
    return bound[0]


def _page_of(doc: Column) -> Column:
    text, page = doc["t"], F.get(doc["x"]["Page"], 0)
    regions = F.coalesce(page["TextRegion"], F.array())
    groups = F.flatten(F.transform(F.coalesce(page["ReadingOrder"], F.array()), lambda o: F.coalesce(o["OrderedGroup"], F.array())))
    refs = F.flatten(F.transform(groups, lambda g: F.coalesce(g["RegionRefIndexed"], F.array())))
    equivs = lambda r: _n(r["TextEquiv"]) + _sum(r["TextLine"], lambda q: _n(q["TextEquiv"]))
    unicodes = lambda r: _sum(r["TextEquiv"], lambda e: _n(e["Unicode"])) + _sum(r["TextLine"], lambda q: _sum(q["TextEquiv"], lambda e: _n(e["Unicode"])))
    same = (
        (_n(doc["x"]["Page"]) == 1) & (_elements(text, "Page") == 1) & (_elements(text, "TextRegion") == F.size(regions)) & (_elements(text, "RegionRefIndexed") == F.size(refs))
        & (_elements(text, "TextLine") == _sum(regions, lambda r: _n(r["TextLine"]))) & (_elements(text, "TextEquiv") == _sum(regions, equivs)) & (_elements(text, "Unicode") == _sum(regions, unicodes))
    )

    def line_of(region: Column, at: Column) -> Column:
        name = _or_id(region["_id"], F.concat(F.lit("region_"), at.cast("string")))

        def one(q: Column, i: Column) -> Column:
            first = F.get(q["TextEquiv"], 0)
            # An empty element is an element: what is there at all is told by the sizes.
            own = F.when(_n(q["TextEquiv"]) > 0, F.when(_n(first["Unicode"]) > 0, F.coalesce(F.get(first["Unicode"], 0), F.lit(""))))
            every = F.flatten(F.transform(F.coalesce(q["TextEquiv"], F.array()), lambda e: F.coalesce(e["Unicode"], F.array())))
            nested = F.when(F.size(every) > 0, F.coalesce(F.get(every, 0), F.lit("")))
            none = F.lit(None).cast("double")
            return F.struct(
                name.alias("region_id"), at.alias("region_idx"), _or_id(q["_id"], F.concat(name, F.lit("_line_"), i.cast("string"))).alias("line_id"), i.alias("line_idx"), q["_custom"].alias("custom"),
                F.get(q["Coords"], 0)["_points"].alias("points"), F.get(q["Baseline"], 0)["_points"].alias("baseline"), own.alias("text"), nested.alias("nested_text"),
                F.when(_n(q["TextEquiv"]) > 0, _number(first["_conf"])).alias("conf"), none.alias("hpos"), none.alias("vpos"), none.alias("w"), none.alias("h"),
            )

        return F.transform(F.coalesce(region["TextLine"], F.array()), one)

    region = lambda r, i: F.struct(_or_id(r["_id"], F.concat(F.lit("region_"), i.cast("string"))).alias("region_id"), i.alias("region_idx"), r["_type"].alias("type"), r["_custom"].alias("custom"), F.lit(None).cast("string").alias("parent_id"), F.get(r["Coords"], 0)["_points"].alias("points"))
    order = F.transform(refs, lambda r, i: F.struct(r["_regionRef"].alias("region_id"), _number(r["_index"], "int").alias("order_idx"), i.alias("ref_idx")))
    return F.when(same, F.struct(
        _namespace(text, "PcGts").alias("ns"), page["_imageFilename"].alias("image_name"), _number(page["_imageWidth"], "int").alias("width"), _number(page["_imageHeight"], "int").alias("height"),
        F.lit(None).cast("string").alias("error"), order.alias("region_order"), F.transform(regions, region).alias("regions"), F.flatten(F.transform(regions, line_of)).alias("lines"),
    ))


def alto_columns(content: Column) -> Column:
    """The same for ALTO."""
    raw = content.cast("string")
    words = F.regexp_replace(raw, re.escape("<SP") + "([\\s/>])", '<String CONTENT=" "$1')
    # An SP element of two tags would leave its end behind.
    parsed = F.when(_whole(raw, "alto") & ~F.contains(raw, F.lit("</SP")), F.from_xml(words, ALTO_SCHEMA, _OPTIONS | {"rowTag": "alto"}))
    return F.transform(F.array(F.struct(words.alias("t"), parsed.alias("x"))), _alto_of)[0]


def _alto_of(doc: Column) -> Column:
    text = doc["t"]
    layouts = F.coalesce(doc["x"]["Layout"], F.array())
    pages = F.flatten(F.transform(layouts, lambda x: F.coalesce(x["Page"], F.array())))
    page = F.get(pages, 0)
    blocks = F.flatten(F.transform(F.coalesce(page["PrintSpace"], F.array()), lambda s: F.coalesce(s["TextBlock"], F.array())))
    sources = F.flatten(F.transform(F.coalesce(doc["x"]["Description"], F.array()), lambda d: F.coalesce(d["sourceImageInformation"], F.array())))
    names = F.flatten(F.transform(sources, lambda s: F.coalesce(s["fileName"], F.array())))
    same = (
        (F.size(pages) == 1) & (_elements(text, "Page") == 1) & (_elements(text, "TextBlock") == F.size(blocks)) & (_elements(text, "fileName") == F.size(names))
        & (_elements(text, "TextLine") == _sum(blocks, lambda b: _n(b["TextLine"]))) & (_elements(text, "String") == _sum(blocks, lambda b: _sum(b["TextLine"], lambda q: _n(q["String"]))))
    )
    polygon = lambda e: F.get(F.get(e["Shape"], 0)["Polygon"], 0)["_POINTS"]
    white = r"[\x1c-\x1f\x85\p{IsWhite_Space}]"

    def line_of(block: Column, at: Column) -> Column:
        name = _or_id(block["_ID"], F.concat(F.lit("block_"), at.cast("string")))

        def one(q: Column, i: Column) -> Column:
            joined = F.array_join(F.transform(F.coalesce(q["String"], F.array()), lambda s: F.coalesce(s["_CONTENT"], F.lit(""))), "")
            own = F.regexp_replace(joined, f"^{white}+|{white}+$", "")
            return F.struct(
                name.alias("region_id"), at.alias("region_idx"), _or_id(q["_ID"], F.concat(name, F.lit("_line_"), i.cast("string"))).alias("line_id"), i.alias("line_idx"), F.lit(None).cast("string").alias("custom"),
                polygon(q).alias("points"), q["_BASELINE"].alias("baseline"), own.alias("text"), own.alias("nested_text"), F.lit(None).cast("double").alias("conf"),
                *[_number(q[a]).alias(k) for k, a in (("hpos", "_HPOS"), ("vpos", "_VPOS"), ("w", "_WIDTH"), ("h", "_HEIGHT"))],
            )

        return F.transform(F.coalesce(block["TextLine"], F.array()), one)

    none = F.lit(None).cast("string")
    region = lambda b, i: F.struct(_or_id(b["_ID"], F.concat(F.lit("block_"), i.cast("string"))).alias("region_id"), i.alias("region_idx"), b["_TYPE"].alias("type"), none.alias("custom"), none.alias("parent_id"), polygon(b).alias("points"))
    return F.when(same, F.struct(
        _namespace(text, "alto").alias("ns"), F.get(names, 0).alias("image_name"), _number(page["_WIDTH"], "int").alias("width"), _number(page["_HEIGHT"], "int").alias("height"), none.alias("error"),
        _nothing(_REGION_ORDER).alias("region_order"), F.transform(blocks, region).alias("regions"), F.flatten(F.transform(blocks, line_of)).alias("lines"),
    ))
