"""WARC archives: writing captures, reading records back and assembling them into one nested row per capture.

Each page is written as a response (or a revisit of an earlier equal payload), the request that asked for it and a
metadata record; the last two name the first in WARC-Concurrent-To. Records are built by SQL functions, compressed to a
gzip member each, and written by Spark's text writer, so archives can go wherever Spark writes; as that writer puts a
separator behind each line, an empty member stands between records. Reading takes archives (plain, or gzip with any
number of members) apart by their Content-Length fields, a record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch
from palimpsest.sources.sinks import write_bytes

#: Fixed values of the format.
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")

RECORDS = (
    "record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, "
    "payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"
)


def marked_pages(rows: DataFrame, scratch: Scratch, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, first, keeper) from (page_id, digest, bytes, row), where one of the last two is not null: first is
    the smallest page_id with that payload, if it is another and the payload has least_bytes; keeper is the first of
    several rows that share page_id and payload. A payload shared by many pages is counted by partial sums; the join back
    can be split, both sides being tables."""
    digests = scratch.cut(rows.select("page_id", "digest", "bytes", "row").where("page_id is not null"))
    heads = scratch.cut(digests.where(f"bytes >= {least_bytes}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    none = F.lit(None).cast("bigint")
    revisits = digests.join(heads, "digest").where("page_id <> first").select("page_id", "digest", "first", none.alias("keeper"))
    repeats = digests.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.min("row").alias("keeper")).where("n > 1").select("page_id", "digest", none.alias("first"), "keeper")
    return scratch.cut(revisits.unionByName(repeats).groupBy("page_id", "digest").agg(F.max("first").alias("first"), F.max("keeper").alias("keeper")))


def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, date: str, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A WARC record up to its end mark; a field whose value is null is left out."""
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), block)


#: What stands between records: a gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [gzip.compress(r, 6, mtime=0) for r in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100, file_mb: int = 8) -> None:
    """Writes pages (page_id, url, html) as WARC files (.warc.gz) of about file_mb before compression.

    Null html is an empty payload, a null url leaves its field out. Of pages with equal payloads of at least least_bytes
    those with the smallest page_id are responses and the others revisit them; rows with a null page_id are responses.
    A repeated row is a capture of its own with record ids of its own; of several rows of the smallest page_id the first
    one is what others revisit, rows being told apart by their place, as Spark reads them. Other columns are not read."""
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = rows.join(marked_pages(rows, scratch, least_bytes), ["page_id", "digest"], "left")
    average = pages.agg(F.avg(F.octet_length(html))).first()[0] or 1.0
    uri = F.col("url")
    for raw, encoded in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        uri = F.replace(uri, F.lit(raw), F.lit(encoded))
    response_id = _urn(F.lit("response"), F.col("page_id"), F.when(F.col("page_id").isNull(), F.col("row")), F.col("digest"))
    own = F.when(F.col("first").isNotNull(), _urn(F.lit("revisit"), F.col("page_id"), F.col("row"))).when(F.col("keeper") != F.col("row"), _urn(F.lit("again"), F.col("page_id"), F.col("row"), F.col("digest"))).otherwise(response_id)
    size = F.col("bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    capture = ("X-Capture-ID", _urn(F.lit("capture"), F.col("page_id"), F.col("row")))
    response = _record("response", own, uri, date, "application/http;msgtype=response", F.concat(http, F.col("html")), digest, capture)
    revisit = _record("revisit", own, uri, date, "application/http;msgtype=response", http, digest, capture, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _urn(F.lit("response"), F.col("first"), F.lit(None), F.col("digest"))))
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    beside = ("WARC-Concurrent-To", own)
    request = _record("request", _urn(F.lit("request"), F.col("page_id"), F.col("row")), uri, date, "application/http;msgtype=request", get, beside, capture)
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("page_id"), F.col("row")), uri, date, "application/warc-fields", about, beside, capture)
    records = rows.select(F.explode(F.array(F.when(F.col("first").isNull(), response).otherwise(revisit), request, metadata)).alias("record"))
    packed = records.select(F.concat("record", F.lit(END)).cast("binary").alias("record")).mapInArrow(_members, "member binary")
    write_bytes(packed, "member", path, EMPTY_MEMBER, most=3 * max(1, int(file_mb * 1e6 / max(average, 500.0))), suffix=".warc.gz")


def _chunks(content: bytes, size: int = 65_536) -> Iterator[bytes]:
    """The content in pieces, decompressed member by member if it is gzip."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + size] for i in range(0, len(content), size))
        return
    at, one = 0, zlib.decompressobj(31)
    while at < len(content):
        piece = content[at : at + size]
        at += len(piece)
        yield one.decompress(piece)
        if one.eof:
            at -= len(one.unused_data)
            while content[at : at + 1] == b"\0":
                at += 1
            one = zlib.decompressobj(31)


def parse_fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields, names in lower case; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_archive(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of each record of one archive, of which no more than a record and a piece is held decompressed; a
    ValueError if it breaks off."""
    held, at, fields, need = bytearray(), 0, None, 0
    for chunk in _chunks(content):
        held += chunk
        while held:
            if fields is None:
                if held[:2] == b"\r\n":
                    del held[:2]
                    at += 2
                    continue
                if not held.startswith(b"WARC/"[: len(held)]):
                    raise ValueError(f"no WARC record at byte {at}")
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = parse_fields(bytes(held[held.index(b"\r\n") + 2 : end]))
                start = end + 4
                need = start + int(dict(fields)["content-length"])
            if len(held) < need:
                break
            yield fields, bytes(held[start:need])
            del held[:need]
            at, fields = at + need, None
    if fields is not None or bytes(held) not in (b"", b"\r"):
        raise ValueError(f"the record at byte {at} breaks off")


def _row(fields: list[tuple[str, str]], block: bytes, with_payload: bool) -> tuple:
    one = dict(fields)
    kind, inner, payload = one.get("warc-type", ""), {}, block
    if one.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        inner = dict(parse_fields(head.partition(b"\r\n")[2]))
    elif one.get("content-type") == "application/warc-fields":
        inner = dict(parse_fields(block))
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":
        size, digest = int(inner.get("content-length", 0)), one.get("warc-payload-digest", "").rpartition(":")[2]
    elif kind == "response" and one.get("warc-payload-digest", "").startswith("sha256:") and one["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"the payload of {one.get('warc-record-id')} differs from its digest")
    inner |= {k: v for k, v in one.items() if k.startswith("x-")}
    beside = [v for k, v in fields if k == "warc-concurrent-to"]
    return kind, one.get("warc-record-id"), beside, one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"), one.get("content-type"), size, digest, list(inner.items()), payload if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record of the archives under a path; see RECORDS. payload_bytes and payload_digest are computed
    from the payload, for revisits taken from their fields. A payload that differs from its digest raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                for fields, block in parse_archive(content.as_py()):
                    rows.append(_row(fields, block, with_payload))
                    held += len(block)
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, response (struct), request (struct or null), requests and metadata (arrays of structs).

    A response, revisit or resource anchors a capture. Requests and metadata join the anchor that they name in
    WARC-Concurrent-To, or that names them. Where writers give captures an X-Capture-ID, equal anchors' captures are
    kept apart by it. Records that lead to no anchor, or whose id is null, are in no capture; of several requests, request is
    the one with the smallest id. A repeated record is there as often in its capture."""
    capture = F.coalesce(F.col("fields")["x-capture-id"], F.lit(""))
    records = records.withColumn("capture", capture)
    is_anchor = F.col("record_type").isin(*ANCHORS)
    anchors = records.where(is_anchor)
    others = records.where(F.col("record_type").isin("request", "metadata"))
    named = others.select("record_id", "capture", F.explode("concurrent_to").alias("anchor"))
    naming = anchors.select(F.explode("concurrent_to").alias("record_id"), "capture", F.col("record_id").alias("anchor"))
    pairs = named.unionByName(naming).distinct()
    whole = F.struct("record_type", "record_id", "target_uri", "date", "fields", "payload_bytes", "payload_digest", "payload")
    beside = others.select("record_id", "capture", whole.alias("one")).join(pairs, ["record_id", "capture"])
    of_type = lambda kind: F.filter(F.array_sort(F.collect_list("one"), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)), lambda x: x["record_type"] == kind)
    grouped = beside.groupBy("anchor", "capture").agg(of_type("request").alias("requests"), of_type("metadata").alias("metadata")).withColumnRenamed("anchor", "record_id")
    main = anchors.select("record_id", "capture", F.struct("record_type", "record_id", "refers_to", "target_uri", "date", "fields", "payload_bytes", "payload_digest", "payload").alias("response"))
    return main.join(grouped, ["record_id", "capture"], "left").select("record_id", "response", F.get("requests", 0).alias("request"), "requests", "metadata")


def page_captures(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and returns one row per page: page_id,
    payload_bytes, payload_digest, record_type, refers_to (the response's page_id for revisits)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    write_archives(pages, f"{scratch.root}/warc")
    captures = assemble(scratch.cut(read_archives(spark, f"{scratch.root}/warc", with_payload=False)))  # read once for both sides of the joins
    flat = captures.select("record_id", F.get("metadata", 0)["fields"]["page_id"].alias("page"), "response.refers_to", "response.payload_bytes", "response.payload_digest", "response.record_type")
    flat = scratch.cut(flat.select("record_id", F.when(F.col("page") != "", F.col("page")).cast("bigint").alias("page_id"), F.col("refers_to").alias("target"), "payload_bytes", "payload_digest", "record_type"))
    heads = scratch.cut(flat.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")).distinct())
    linked = flat.where("target is not null").join(heads, "target", "left")
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return flat.where("target is null").withColumn("refers_to", F.lit(None).cast("bigint")).select(*result).unionByName(linked.select(*result))
