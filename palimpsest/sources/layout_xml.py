"""PAGE and ALTO layout XML as lines, regions and pages.

Files are read by Spark's binaryFile source and parsed by its XML functions, those with nested regions, nested text or mixed
children that columns would lose by a standard XML parser in Arrow batches. Any namespace is accepted. A file that cannot be
parsed is a page with an error and no lines."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = (
    "path string, ns string, image_name string, width int, height int, error string, "
    "region_order array<struct<region_id:string,order_idx:int,ref_idx:int>>, "
    "regions array<struct<region_id:string,region_idx:int,type:string,custom:string,parent_id:string,points:string>>, "
    "lines array<struct<region_id:string,region_idx:int,line_id:string,line_idx:int,custom:string,points:string,baseline:string,text:string,nested_text:string,conf:double,hpos:double,vpos:double,w:double,h:double>>"
)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c.tag) == name]


def _first(e: ET.Element, *names: str) -> ET.Element | None:
    for name in names:
        found = _children(e, name)
        if not found:
            return None
        e = found[0]
    return e


def _text(e: ET.Element | None) -> str | None:
    return None if e is None else (e.text or "")


def _number(s: str | None, kind=float):
    try:
        return kind(float(s))
    except (TypeError, ValueError):
        return None


def parse_page_xml(content: bytes) -> dict:
    """Regions in document order, nested ones with their parent; each line belongs to its nearest region."""
    root = ET.fromstring(content)
    page = next((e for e in root.iter() if _local(e.tag) == "Page"), None)
    out = {"ns": root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None, "image_name": None, "width": None, "height": None, "error": None if page is not None else "no Page element", "region_order": [], "regions": [], "lines": []}
    if page is None:
        return out
    out |= {"image_name": page.get("imageFilename"), "width": _number(page.get("imageWidth"), int), "height": _number(page.get("imageHeight"), int)}
    refs = [e for e in page.iter() if _local(e.tag) == "RegionRefIndexed"]
    out["region_order"] = [{"region_id": r.get("regionRef"), "order_idx": _number(r.get("index"), int), "ref_idx": i} for i, r in enumerate(refs)]

    def visit(e: ET.Element, parent: str | None) -> None:
        for child in e:
            name = _local(child.tag)
            if name == "TextRegion":
                at = len(out["regions"])
                region = child.get("id") or f"region_{at}"
                coords = _first(child, "Coords")
                out["regions"].append({"region_id": region, "region_idx": at, "type": child.get("type"), "custom": child.get("custom"), "parent_id": parent, "points": None if coords is None else coords.get("points")})
                for i, line in enumerate(_children(child, "TextLine")):
                    c, b = _first(line, "Coords"), _first(line, "Baseline")
                    equiv = _first(line, "TextEquiv")
                    nested = next((u for t in line.iter() if _local(t.tag) == "TextEquiv" for u in _children(t, "Unicode")), None)
                    out["lines"].append({"region_id": region, "region_idx": at, "line_id": line.get("id") or f"{region}_line_{i}", "line_idx": i, "custom": line.get("custom"), "points": None if c is None else c.get("points"), "baseline": None if b is None else b.get("points"), "text": None if equiv is None else _text(_first(equiv, "Unicode")), "nested_text": _text(nested), "conf": None if equiv is None else _number(equiv.get("conf")), "hpos": None, "vpos": None, "w": None, "h": None})
                visit(child, region)
            elif name != "TextLine":
                visit(child, parent)

    visit(page, None)
    return out


def parse_alto(content: bytes) -> dict:
    """Blocks as regions and their direct lines; text of String and SP children in order, else of the first String
    below. Line ids are the ID attributes, else block and number."""
    root = ET.fromstring(content)
    page = next((e for e in root.iter() if _local(e.tag) == "Page"), None)
    name = next((e.text for e in root.iter() if _local(e.tag) == "fileName"), None)
    out = {"ns": root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None, "image_name": name, "width": None, "height": None, "error": None if page is not None else "no Page element", "region_order": [], "regions": [], "lines": []}
    if page is None:
        return out
    out |= {"width": _number(page.get("WIDTH"), int), "height": _number(page.get("HEIGHT"), int)}
    for at, block in enumerate(e for e in page.iter() if _local(e.tag) == "TextBlock"):
        region = block.get("ID") or f"block_{at}"
        polygon = _first(block, "Shape", "Polygon")
        out["regions"].append({"region_id": region, "region_idx": at, "type": block.get("TYPE"), "custom": None, "parent_id": None, "points": None if polygon is None else polygon.get("POINTS")})
        for i, line in enumerate(_children(block, "TextLine")):
            parts = [c.get("CONTENT") or "" if _local(c.tag) == "String" else " " for c in line if _local(c.tag) in ("String", "SP")]
            text = "".join(parts).strip()
            if not text:
                text = next((c.get("CONTENT") or "" for c in line.iter() if _local(c.tag) == "String"), "").strip()
            shape = _first(line, "Shape", "Polygon")
            box = {k: _number(line.get(a)) for k, a in (("hpos", "HPOS"), ("vpos", "VPOS"), ("w", "WIDTH"), ("h", "HEIGHT"))}
            out["lines"].append({"region_id": region, "region_idx": at, "line_id": line.get("ID") or f"{region}_line_{i}", "line_idx": i, "custom": None, "points": None if shape is None else shape.get("POINTS"), "baseline": line.get("BASELINE"), "text": text, "nested_text": text, "conf": None} | box)
    return out


def read_xml(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of the *.xml files of a folder, but those named metadata.xml and mets.xml."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(~F.lower(F.substring_index("path", "/", -1)).isin("metadata.xml", "mets.xml")).select("path", "content")


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of an export: all *.xml of its page folder if there are any, else those of the folder itself but
    metadata.xml and mets.xml. Only names are listed on the driver."""
    inner = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/page")
    fs = inner.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.globStatus(inner.suffix("/*.xml")):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(inner.toString()).select("path", "content")
    return read_xml(spark, folder)


def _parsed(path: str, content: bytes, kind: str) -> dict:
    try:
        alto = kind == "alto" or kind == "auto" and b"<alto" in content[:2000].lower()
        return {"path": path} | (parse_alto if alto else parse_page_xml)(bytes(content))
    except (ET.ParseError, ValueError, TypeError, OverflowError) as e:
        return {"path": path, "ns": None, "image_name": None, "width": None, "height": None, "error": f"{type(e).__name__}: {e}", "region_order": [], "regions": [], "lines": []}


def _names() -> list[str]:
    return [c.strip().split(" ")[0] for c in PAGES.replace("<", " <").split(", ")]


def parse_pages(files: DataFrame, kind: str = "page") -> DataFrame:
    """One row per file (path, content): see PAGES. kind is page, alto, or auto, which goes by the root element. Files are
    parsed by SQL functions; those of which these would lose something (see layout_columns) by an XML parser in Arrow
    batches, to which no other file is sent."""
    from palimpsest.sources.layout_columns import alto_columns, page_columns

    names = _names()[1:]
    shape = PAGES.partition(", ")[2]

    def rest(content: pd.Series) -> pd.DataFrame:
        rows = [None if c is None else _parsed("", c, kind) for c in content]
        return pd.DataFrame([dict.fromkeys(names) if r is None else {k: r[k] for k in names} for r in rows], columns=names)

    is_alto = F.lit(kind == "alto") if kind != "auto" else F.contains(F.lower(F.left(F.col("content").cast("string"), F.lit(2000))), F.lit("<alto"))
    alto, page = (F.col("content") if kind == name else F.when(is_alto if name == "alto" else ~is_alto, F.col("content")) for name in ("alto", "page"))
    own = alto_columns(alto) if kind == "alto" else page_columns(page) if kind == "page" else F.coalesce(page_columns(page), alto_columns(alto))
    tried = files.select("path", "content", own.alias("own"))
    # Said to be nondeterministic so that no later explode or filter takes it in, where Python can't run.
    left = F.pandas_udf(rest, shape).asNondeterministic()(F.when(F.col("own").isNull(), F.col("content")))
    both = tried.select("path", "own", left.alias("rest"))
    return both.select("path", *[F.when(F.col("own").isNull(), F.col("rest")[c]).otherwise(F.col("own")[c]).alias(c) for c in names])


def parse_pages_by_parser(files: DataFrame, kind: str = "page") -> DataFrame:
    """The same, all by the XML parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_parsed(p, c, kind) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=_names())

    return files.select("path", "content").mapInPandas(run, PAGES)
