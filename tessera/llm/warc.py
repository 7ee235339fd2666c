"""A content-addressed WARC archive: payloads once, headers apart, records rebuilt by joins.

Writing makes two tables. ``headers`` has one row per page: the exact bytes of the record's WARC and HTTP headers and the digest of its payload.
``payloads`` has each different payload's bytes once, under its SHA-256, which is computed anew and compared whenever payloads are read.
A record's bytes are its headers and, for a response, its payload; a revisit's record has no payload, but ``read`` gives the one it refers to.

The page that a group of equal payloads is stored under is found by a partial aggregation of digests and pages, so a group that holds a third of all rows is
reduced before it is shuffled. Payloads that no other page has are written where they are read; only those of several pages are shuffled, dealt out by digest and page together, so the copies
of a large group go to different tasks. Joins are of two shuffled sides, so the adaptive planner can split a digest that many pages share.

Defined results: a null payload is the empty one, of which, as of all payloads under ``LEAST`` bytes, every record is a response; a null url is the empty target; rows that repeat a page_id each have a record,
and where they are equal in payload too, all of them are responses if one is; a null page_id counts as the largest; extra columns are ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, without

#: Payloads of fewer bytes are stored once too, but never recorded as revisits.
LEAST = 100
#: The place of a null page_id in the order of pages.
LAST = 2**63 - 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame


def _uuid(*parts: Column) -> Column:
    """A record's id, from what names it."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> Archive:
    """Archives every page."""
    scratch = Scratch(pages.sparkSession, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"), body.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "order": F.coalesce("page_id", F.lit(LAST))})

    groups = rows.groupBy("digest").agg(F.min(F.struct("order", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.write(groups.select("digest", F.col("first.order").alias("first"), F.col("first.url").alias("first_url")), "shared")
    # Of the pages of a shared payload only the first's bytes go on, and rows equal to it are then in the same task, so they take no second shuffle.
    firsts = rows.select("digest", "order", "payload").join(shared.select("digest", F.col("first").alias("order")), ["digest", "order"], "left_semi")
    singles = without(rows.select("digest", "payload"), shared.select("digest"), ["digest"])
    payloads = scratch.write(singles.unionByName(firsts.dropDuplicates(["digest", "order"]).select("digest", "payload")), "payloads")

    small = rows.select("page_id", "order", "url", "digest", "bytes").join(shared, "digest", "left")
    revisit = (F.col("bytes") >= LEAST) & F.col("first").isNotNull() & (F.col("order") != F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, F.col("first"))
    lines = lambda *pairs: F.concat_ws("\r\n", *[p if isinstance(p, Column) else F.lit(p) for p in pairs])
    http = lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes")), "", "")
    names = small.withColumns({"record_type": kind, "refers_to": refers, "http": http})
    first_page = F.when(F.col("refers_to") == LAST, F.lit("null")).otherwise(F.col("refers_to").cast("string"))
    body_bytes = F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.lit(0))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    header = lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(page, F.col("url"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("X-Page-ID: "), page),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _uuid(first_page, F.col("first_url"), F.col("digest")), F.lit("\r\nX-Refers-To-Page-ID: "), first_page, F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http") + body_bytes)),
        "",
        F.col("http"),
    )
    return Archive(scratch.write(names.select(header.cast("binary").alias("header"), "digest"), "headers"), payloads)


def _field(text: Column, name: str) -> Column:
    """A header's value, or null."""
    found = F.regexp_extract(text, rf"(?s)^WARC/1\.1\r\n(?:.*?\r\n)??{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read(archive: Archive) -> DataFrame:
    """Every record rebuilt: page_id, url, record_type, refers_to, payload, payload_digest, payload_bytes, verified and record (the exact bytes of the WARC record).

    payload_digest is computed from the stored bytes; ``verified`` tells whether it is the digest that the record's header names.
    """
    payloads = archive.payloads.select(F.col("digest"), "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    text = F.col("header").cast("string")
    fields = archive.headers.select(
        "header",
        "digest",
        _field(text, "X-Page-ID").try_cast("long").alias("page_id"),
        F.coalesce(_field(text, "WARC-Target-URI"), F.lit("")).alias("url"),
        _field(text, "WARC-Type").alias("record_type"),
        _field(text, "X-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        F.substring_index(_field(text, "WARC-Payload-Digest"), ":", -1).alias("named"),
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"").cast("binary"))
    record = F.concat(F.col("header"), body, F.lit(b"\r\n\r\n").cast("binary"))
    return fields.join(payloads, "digest", "left").select(
        "page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes", (F.col("payload_digest") == F.col("named")).alias("verified"), record.alias("record")
    )
