"""A content-addressed web archive: payload bytes once per digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, merged, save

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_of_hex(digest: Column, characters: int = 40) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of 5: 20 bits, 4 base32 digits, at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, k + 1, 5), 16, 32), 4, "0") for k in range(0, characters, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


#: A payload of many pages is joined to so many of them in a task.
SALT_FROM = 1000


def _uri(url: Column) -> Column:
    """The URL with blanks and control characters percent-encoded, so that it cannot end a header line."""
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _headers() -> Column:
    """A record's WARC header and HTTP header, byte for byte; what follows in a response is the payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    content = F.char_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", _uri(F.col("url")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("response_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", content.cast("string")),
        F.lit(CRLF),
        http,
    )


def write_archive(pages: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) as tables in the shared folder.

    payloads: sha256, payload, response_id and pages (how many hold it), one row per distinct payload. Rows are grouped by digest and whole content, each task
    combining its copies before the shuffle; should two contents share a digest, the job fails. headers: page_id, sha256, header,
    one row per page. Of pages with one payload of at least `least` bytes the largest page_id is the response and the others
    revisit it; smaller payloads make responses only.

    A null html counts as empty, a null url leaves its header line out. A null page_id never is the response of others (if a
    group has no other, all its rows are responses); pages that repeat an id and a payload are records of their own. An empty
    table makes empty tables. A very long html is one row's payload. Only page_id, url and html are read, so other columns cannot clash.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    payloads = save(pages.groupBy("sha256", "payload").agg(F.max("page_id").alias("response_id"), F.count("*").alias("pages")), "warc-payloads", **{"parquet.block.size": str(32 << 20)})
    if payloads.groupBy("sha256").count().where("count > 1").limit(1).count():
        raise ValueError("two payloads share a SHA-256 digest")
    records = pages.select("page_id", "url", "sha256", base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))
    records = merged(records, payloads.select("sha256", "response_id"), "sha256")
    again = (F.col("bytes") >= least) & F.coalesce(F.col("page_id") != F.col("response_id"), F.col("response_id").isNotNull())
    headers = records.withColumn("record_type", F.when(again, "revisit").otherwise("response")).select("page_id", "sha256", _headers().cast("binary").alias("header"))
    return payloads, save(headers, "warc-headers")


def read_records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """page_id, header and payload of every record: headers find their payload by digest; for a revisit it is what it revisits.

    A payload is copied once for each SALT_FROM of its pages, which are dealt among the copies."""
    salts = F.ceil(F.col("pages") / SALT_FROM).cast("int")
    spread = payloads.select("sha256", "payload", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = merged(headers, payloads.select("sha256", "pages"), "sha256").withColumn("salt", F.pmod(F.xxhash64("header"), salts.cast("bigint")).cast("int"))
    return merged(dealt, spread, ["sha256", "salt"]).select("page_id", "sha256", "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id, the exact bytes of each WARC record, and for a revisit, whose record has no payload, the payload that it revisits."""
    revisit = F.contains(F.col("header"), F.lit(f"{CRLF}WARC-Refers-To: ").cast("binary"))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("page_id", "sha256", F.concat("header", body, F.lit(CRLF + CRLF).cast("binary")).alias("record"), F.when(revisit, F.col("payload")).alias("revisited"))


def parse_header(header: bytes) -> dict[str, str]:
    """The WARC header's fields, names in lower case."""
    lines = header.split(b"\r\n\r\n", 1)[0].decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC header's fields of one record and its payload, cut out by the length that the header gives."""
    fields, start = parse_header(record), record.index(b"\r\n\r\n") + 4
    end = start + int(fields["content-length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} does not end where its header says")
    return fields, record[record.index(b"\r\n\r\n", start) + 4 : end]


def _page_of(uri: str | None) -> int | None:
    name = uri[len("<urn:page:") : -1] if uri else "none"
    return None if name == "none" else int(name)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, record, revisited in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            fields, payload = parse_record(record)
            kind = fields["warc-type"]
            if kind == "revisit":
                if payload or revisited is None:
                    raise ValueError(f"record {fields['warc-record-id']} is no revisit")
                payload = revisited
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if hashlib.sha256(payload).digest() != key or fields["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError(f"record {fields['warc-record-id']} does not hold what its header says")
            rows.append((_page_of(fields["warc-record-id"]), len(payload), digest, kind, _page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def index_records(records: DataFrame) -> DataFrame:
    """What records, rebuilt byte for byte and parsed again, say of themselves; each payload is checked against its key, its header's digest and its length."""
    return record_bytes(records).select("page_id", "sha256", "record", "revisited").mapInArrow(_verify_batches, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages archived in the shared folder, read back and verified; what the query returns."""
    payloads, headers = write_archive(pages, least)
    out = save(index_records(read_records(payloads, headers)).drop("target_uri"), "warc-index")
    forget(payloads, headers)
    return out


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + ((('0x' || substr(hex || '00', 1 + 5 * (i // 4), 5))::bigint >> (5 * (3 - i % 4))) & 31)::int]), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM b
"""
