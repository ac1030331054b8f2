"""Derivative records of archived responses: metadata and plain-text conversion, linked to their source."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What is cut from markup, in this order, and what stands in its place. What has no end goes to the end.
MARKUP = [
    (r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))", " "),
    (r"(?is)<script(?=[\s/>])[^>]*+(?:>.*?(?:</script(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)", " "),
    (r"(?is)<style(?=[\s/>])[^>]*+(?:>.*?(?:</style(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)", " "),
]
#: The same of single tags. Each of them is asked only where a > follows, so none looks for one in vain.
TAGS = [
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(\s[^>]*)?/?>", "\n"),
    (r"(?s)<[^>]*>", ""),
]
#: References to a no-break space, which becomes a plain one.
BLANK_REFERENCE = re.compile(r"&(?:nbsp|#0*160(?![0-9])|#[xX]0*[aA]0(?![0-9a-fA-F]));?")


def record_id(kind: str, *parts: Column) -> Column:
    """A URN of UUID form that a kind and its source determine, so that a rerun gives the same records."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


@F.arrow_udf(StringType())
def decode(texts: pa.Array) -> pa.Array:
    """Every numeric and named character reference of HTML decoded, once."""
    return pa.array([x if x is None or "&" not in x else entities.unescape(BLANK_REFERENCE.sub(" ", x)) for x in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    """Markup removed, references decoded, blanks squeezed, empty lines dropped; time grows with the length alone.

    A < that no > follows is text. A script or style whose tag has no end goes to the end.
    """
    for pattern, to in MARKUP:
        html = F.regexp_replace(html, pattern, to)
    rest = F.substring_index(html, ">", -1)
    tagged = F.substr(html, F.lit(1), F.char_length(html) - F.char_length(rest))
    for pattern, to in TAGS:
        tagged = F.regexp_replace(tagged, pattern, to)
    html = F.concat(tagged, rest)
    html = F.regexp_replace(F.regexp_replace(decode(html), r"[ \t\r\f\x0b]+", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(html, F.lit(" \n"))


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records, metadata and conversion, for each response record.

    `responses` has record_id, target_uri, warc_date (text), http_header (status line and header lines, as
    they came) and payload (text). The metadata record lists the source's header lines and its digests; the
    conversion record is the payload as plain text. Both name the response in `refers_to` and carry its
    address, date and payload digest.

    Columns: warc_type, record_id, refers_to, target_uri, warc_date, content_type, block, content_length
    (bytes), block_digest, source_digest. Nulls in a response count as empty text, and its records are still
    made; repeated responses give equal records. Other columns of the input are left out.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "target_uri", "warc_date", "http_header", "payload")}
    own = responses.select(*keep, *[c.alias(k) for k, c in text.items()]).withColumns({"source_digest": digest(F.col("payload")), "_plain": plain_text(F.col("payload"))})
    fields = F.concat(
        F.lit("sourceDigest: "), F.col("source_digest"), F.lit("\r\nsourceBlockDigest: "), digest(F.concat("http_header", F.lit("\r\n\r\n"), "payload")), F.lit("\r\nsourceLength: "), F.octet_length("payload").cast("string"), F.lit("\r\n"),
        F.lit("http-"), F.replace("http_header", F.lit("\r\n"), F.lit("\r\nhttp-")), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("_plain").alias("block")),
    )
    each = own.select(*keep, "record_id", "target_uri", "warc_date", "source_digest", F.inline(kinds))
    new_id = F.when(F.col("warc_type") == "metadata", record_id("metadata", F.col("record_id"))).otherwise(record_id("conversion", F.col("record_id")))
    return each.select(*keep, "warc_type", new_id.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "content_type", "block", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest")


def serialise(records: DataFrame) -> DataFrame:
    """(record_id, record): each record as it stands in a WARC/1.1 file, header lines, block and end."""
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length")]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in lines])
    return records.select("record_id", F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as the response records that a crawl of them would hold."""
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select("page_id", record_id("response", F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), header.alias("http_header"), F.col("html").alias("payload"))
