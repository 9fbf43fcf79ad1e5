"""WARC archives written and read as a table of payload chunks.

A payload is streamed as (record, chunk number) rows of at most `chunk_bytes`
bytes. Each row carries the SHA-1 of its own bytes, that of all bytes so far and
whether it is the last, so neither writer nor reader holds a second copy of a
payload: chunks are views of the batch that Spark hands over. A row becomes one WARC record: the first a `response`, later ones
`continuation` records of the same origin, as the format has it for segments.
Spark's text writer puts the records behind each other (the line end is the
format's own CR LF); the text reader cuts at the version line. A chunk ends
inside any version text that a payload contains, whatever follows it, so a
record's own line end never completes one and the cut is exact. In header values
control characters and version texts are %-coded; page ids are read back as they
were, urls keep the codes.

Of records with equal payloads of at least `revisit_bytes`, that of the smallest
page is a response and the others are `revisit` records without a payload.

Null html is an empty payload; a null url is left out. Rows that repeat the
smallest page are responses too; a row with a null page is a response. Very long
payloads are many chunks; a row of the input table itself is held as Spark
reads it. An empty table writes an empty archive. Columns other than the id, the
url and the html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.groups import attach
from plumbline.session import shared_dir

VERSION = "WARC/1.1"
MAGIC = VERSION + "\r\n"
_VERSION = re.compile(re.escape(VERSION).encode())
CHUNK_BYTES = 1 << 20
NO_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digits = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*part)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decisions(pages: DataFrame, id_column: str, html: str, revisit_bytes: int) -> DataFrame:
    """Pages with payload, digest, record type and the page a revisit refers to."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col(id_column).alias("page"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("bytes"),
        base32_sha1(payload).alias("digest"))
    keyed = keyed.withColumn("key", F.when(F.col("bytes") >= revisit_bytes, F.concat_ws(":", "digest", "bytes")))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = pages.count()
    known = attach(keyed, groups, "key", F.xxhash64("page", "digest"), total)
    again = F.coalesce(F.col("page") != F.col("first"), F.lit(False))
    return known.select("page", "url", "payload", "bytes", "digest", again.alias("revisit"),
                        F.when(again, F.col("first")).alias("refers_to"),
                        F.monotonically_increasing_id().alias("row"))


def pieces(payload: bytes | memoryview, chunk_bytes: int) -> Iterator[memoryview]:
    """Cut a payload at characters, and inside every version text in it; nothing for an empty one."""
    view, start = memoryview(payload), 0
    while start < len(view):
        stop = min(start + chunk_bytes, len(view))
        while stop < len(view) and stop > start + 1 and view[stop] & 0xC0 == 0x80:
            stop -= 1
        found = _VERSION.search(view, start, min(stop + len(VERSION), len(view)))
        if found:
            stop = min(stop, found.start() + 4)
        yield view[start:stop]
        start = stop


def chunk_rows(known: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (page, row, url, bytes, digest, revisit, refers_to, chunk, last, body, body_digest, so_far)."""
    kind = known.schema["page"].dataType.simpleString()
    schema = (f"page {kind}, row bigint, url string, bytes bigint, digest string, revisit boolean, refers_to {kind}, chunk int, "
              "last boolean, body string, body_digest string, so_far string")
    fixed = ["page", "row", "url", "bytes", "digest", "revisit", "refers_to"]
    flush = 4 * chunk_bytes

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, out, held = [], [], 0
            for k in range(batch.num_rows):
                held_here = not batch.column("revisit")[k].as_py()
                payload = memoryview(batch.column("payload")[k].as_buffer()) if held_here else memoryview(b"")
                whole, at = hashlib.sha1(), 0
                for number, piece in enumerate(pieces(payload, chunk_bytes) if len(payload) else [payload]):
                    whole.update(piece)
                    at += len(piece)
                    place.append(k)
                    out.append((number, at == len(payload), str(piece, "utf-8"),
                                _b32(hashlib.sha1(piece).digest()), _b32(whole.digest())))
                    held += len(piece)
                    if held >= flush:
                        yield _rows(batch, fixed, place, out)
                        place, out, held = [], [], 0
            if place:
                yield _rows(batch, fixed, place, out)

    return known.mapInArrow(chunked, schema)


def _rows(batch: pa.RecordBatch, fixed: list[str], place: list[int], out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    columns = [batch.column(c).take(pa.array(place, pa.int64())) for c in fixed]
    columns += [pa.array(v, t) for v, t in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[*fixed, "chunk", "last", "body", "body_digest", "so_far"])


#: Characters of header values that are written as %-codes; "%" itself only where a value is read back as it was.
_CODES = {"\r": "%0D", "\n": "%0A", VERSION: VERSION.replace(".", "%2E")}


def _line(name: str, value: Column) -> Column:
    """A header line, or null (left out) if the value is null."""
    safe = value.cast("string")
    for plain, code in _CODES.items():
        safe = F.replace(safe, F.lit(plain), F.lit(code))
    return F.concat(F.lit(f"{name}: "), safe)


def _kept(value: Column) -> Column:
    """A value whose codes `_plain` undoes."""
    return F.replace(value.cast("string"), F.lit("%"), F.lit("%25"))


def _plain(value: Column) -> Column:
    for plain, code in _CODES.items():
        value = F.replace(value, F.lit(code), F.lit(plain))
    return F.replace(value, F.lit("%25"), F.lit("%"))


def _record_id(page: Column, *more: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.concat_ws(":", F.coalesce(_kept(page), F.lit("null")), *more), F.lit(">"))


def write(chunks: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write chunk rows as WARC records with Spark's text writer."""
    first = F.col("chunk") == 0
    segmented = ~first | ~F.col("last")
    kind = F.when(F.col("revisit"), F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))
    header = F.concat_ws(
        "\r\n",
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("row"), F.col("chunk"))),
        F.lit(f"WARC-Date: {NO_DATE}"),
        _line("WARC-Target-URI", F.when(first, F.col("url"))),
        _line("WARC-Page", _kept(F.col("page"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("body_digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.when(F.col("revisit"), F.col("digest")).otherwise(F.col("so_far")))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("WARC-Segment-Number", F.when(segmented, F.col("chunk") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(~first, _record_id(F.col("page"), F.col("row"), F.lit(0)))),
        _line("WARC-Segment-Total-Length", F.when(segmented & F.col("last"), F.col("bytes"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("refers_to")))),
        F.lit("Content-Type: text/html"),
        _line("Content-Length", F.octet_length("body")),
    )
    value = F.concat(F.lit(MAGIC), header, F.lit("\r\n\r\n"), F.col("body"), F.lit("\r\n"))
    chunks.select(value.alias("value")).write.option("lineSep", "\r\n").option(
        "compression", compression).mode("overwrite").text(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Chunk rows of archives: page, url, type, refers_to, chunk, body and the digests of the headers."""
    lines = spark.read.option("lineSep", MAGIC).text(path).where("value <> ''")
    cut = F.instr("value", "\r\n\r\n")
    parts = lines.select(F.substring(F.col("value"), F.lit(1), cut - 1).alias("head"),
                         F.substring(F.col("value"), cut + 4, F.length("value")).alias("tail"))

    def field(name: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit("\n"), F.col("head")), rf"\n{name}: ([^\r]*)", 1)
        return F.when(found != "", found)

    page = _plain(F.regexp_extract(field("WARC-Refers-To"), "page:(.*)>", 1))
    return parts.select(
        _plain(field("WARC-Page")).cast(id_type).alias("page"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("type"), page.cast(id_type).alias("refers_to"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"),
        field("WARC-Segment-Number").isNotNull().alias("segmented"),
        field("WARC-Record-ID").alias("record"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("so_far"),
        F.substring(field("WARC-Block-Digest"), 6, 32).alias("body_digest"),
        field("WARC-Payload-Length").cast("bigint").alias("bytes"),
        # All but the two line ends behind a record.
        F.expr("substring(tail, 1, length(tail) - 4)").alias("body"),
        field("Content-Length").cast("bigint").alias("length"))


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, its length and digest counted anew from the bodies.

    A one-chunk record needs no exchange. Chunks of a longer one are sorted
    behind each other and go through one digest, so no payload is put together.
    A revisit has what its headers state. A payload that does not fit its
    headers stops the job.
    """
    body = F.col("body").cast("binary")
    again = F.col("type") == "revisit"
    length = F.when(again, F.col("bytes")).otherwise(F.octet_length(body)).cast("bigint")
    digest = F.when(again, F.col("so_far")).otherwise(base32_sha1(body))
    broken = F.raise_error(F.concat(F.lit("payload does not fit its headers: "), F.col("record")))
    fits = (F.col("payload_bytes") == F.col("bytes")) & (F.col("payload_digest") == F.col("so_far"))
    whole = chunks.where(~F.col("segmented")).select("*", length.alias("payload_bytes"), digest.alias("payload_digest")).select(
        "page", "url", "type", "refers_to", "payload_bytes",
        F.when(fits, F.col("payload_digest")).otherwise(broken.cast("string")).alias("payload_digest"))
    schema = whole.schema
    names = ["page", "url", "type", "refers_to", "record", "chunk", "body", "so_far", "bytes"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in names}
                if row["chunk"] == 0:
                    if now:
                        done.append(_closed(now))
                    now = {**row, "sha": hashlib.sha1(), "n": 0}
                text = row["body"].encode()
                now["sha"].update(text)
                now["n"] += len(text)
                if _b32(now["sha"].digest()) != row["so_far"]:
                    raise ValueError(f"payload does not fit its headers: {row['record']}")
            if done:
                yield _record_batch(done, kind)
        if now:
            yield _record_batch([_closed(now)], kind)

    kind = pa.int64() if chunks.schema["page"].dataType.simpleString() == "bigint" else pa.string()
    long = chunks.where("segmented").withColumn("__origin", F.regexp_extract("record", "(.*):[0-9]+>", 1))
    streamed = long.repartition("__origin").sortWithinPartitions("__origin", "chunk").select(*names)
    return whole.unionByName(streamed.mapInArrow(joined, schema))


def _closed(now: dict) -> dict:
    if now["n"] != now["bytes"]:
        raise ValueError(f"chunks are missing: {now['record']}")
    return {**now, "payload_digest": _b32(now["sha"].digest())}


def _record_batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    columns = {"page": kind, "url": pa.string(), "type": pa.string(), "refers_to": kind, "n": pa.int64(),
               "payload_digest": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], t) for c, t in columns.items()],
        names=["page", "url", "type", "refers_to", "payload_bytes", "payload_digest"])


def archive(pages: DataFrame, id_column: str = "page_id", html: str = "html", revisit_bytes: int = 0,
            chunk_bytes: int = CHUNK_BYTES) -> str:
    """Write the archive of a page table to the shared folder; returns its path."""
    path = shared_dir(pages.sparkSession)
    write(chunk_rows(decisions(pages, id_column, html, revisit_bytes), chunk_bytes), path)
    return path
