"""WARC archives: write a record for every page, read them back, reassemble segments.

Writing. A page's payload is its HTML in UTF-8, in an HTTP response with chunked
transfer framing. A block of more than ``segment_bytes`` becomes a first record
and continuation records (WARC/1.1, segmentation), each of which may lie in any archive.
Of pages with equal payloads the one of the largest id is the response, the
others are revisits of it. Archives are files of Spark's text sink: records are
valid UTF-8 (segments end between characters), so archives can be written to and read from any
store that Spark reaches; each file is compressed as a whole (gzip), and plain ones are read as well. A file holds at most ``FILE_RECORDS`` records, and so has a bounded size.

Reading. Records are parsed from whole archives. Continuation records are grouped by
the id of their origin record, put in the order of their segment numbers, and checked
against the total length; the chunked framing is decoded; the payload's digest is
compared with the header's. A record that fails a check is returned with the
reason in ``error``, never dropped: so are headers that aren't UTF-8 (their bytes escaped), a block that the archive cuts short, and a Content-Length that is
absent or doesn't lead to the record's end (reading goes on at the next record that begins after an empty line). Of a compressed
archive that is damaged all that comes out is read, and a row without a record id says so. Bytes between records that begin none are skipped.

A page of more than ``SEGMENT_BYTES`` (about one in eleven of the test pages, a third of their bytes) goes through segments.

Null HTML is an empty payload. A null URL is written as an empty one, control characters
and spaces in a URL are percent-encoded. Pages that repeat the id and the payload of
a response are responses too. Rows with a null id count as the smallest. A record's id is made of the page's id and
the payload's digest, so pages that share an id, or have none, stay apart. Other columns
are left out; an empty table makes empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored, work_path

SEGMENT_BYTES = 8_192
CHUNK_BYTES = 4_096
FILE_RECORDS = 500
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PAGE = r"^<urn:page:(-?\d+):[A-Z2-7]+>$"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = []
    for part in _cut(payload, CHUNK_BYTES):
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("a chunk of a negative size")
        at = end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + n])
        at += n + 2


def _cut(block: bytes, most: int) -> Iterator[bytes]:
    """Segments of at most so many bytes that end between characters."""
    at = 0
    while at < len(block):
        end = min(len(block), at + most)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        yield block[at:end]
        at = end


def _record(fields: list[tuple[str, str]], block: bytes) -> str:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{head}\r\n{block.decode()}\r\n\r"  # the sink ends each with the last line feed


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_id(page: object, said: str) -> str:
    """Made of the page's id and its payload's digest: null and reused ids give no two payloads one record id."""
    return f"<urn:page:{'' if page is None else page}:{said}>"


def records_of(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment_bytes: int) -> Iterator[str]:
    said = digest(payload)
    name = record_id(page, said)
    fields = [("WARC-Record-ID", name), ("WARC-Target-URI", _clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{said}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        yield _record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, said)), kind], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *fields, kind], block)
        return
    parts = list(_cut(block, segment_bytes))
    for i, part in enumerate(parts, 1):
        number = [("WARC-Segment-Number", str(i))]
        if i == 1:
            yield _record([("WARC-Type", "response"), *fields, *number, kind], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(parts))
            own = [("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Date", DATE)]
            yield _record([("WARC-Type", "continuation"), *own, ("WARC-Segment-Origin-ID", name), *number, *total], part)


def _written(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                columns = [batch.slice(at, 200).column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to", "revisit")]
                out = [r for page, url, html, to, revisit in zip(*columns, strict=True) for r in records_of(page, url, (html or "").encode(), to, revisit, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_string()).cast(pa.string())], names=["value"])

    return run


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages, in a folder."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    first = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("page_id").eqNullSafe(F.col("refers_to"))
    typed = rows.join(first, "sha", "left").withColumn("revisit", F.col("refers_to").isNotNull() & ~same & (F.col("bytes") >= min_revisit_bytes))
    typed.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(_written(segment_bytes), "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def inflated(raw: bytes) -> tuple[bytes, str | None]:
    """An archive's bytes (gzip, in any number of members, or plain), and what is wrong with its compression."""
    if raw[:2] != b"\x1f\x8b":
        return raw, None
    parts = []
    while raw:
        member = zlib.decompressobj(31)
        for at in range(0, len(raw), 1 << 16):
            part, before = raw[at : at + (1 << 16)], member.copy()
            try:
                parts.append(member.decompress(part))
            except zlib.error as e:
                # What comes before the damage comes out in small steps.
                with suppress(zlib.error):
                    for i in range(0, len(part), 64):
                        parts.append(before.decompress(part[i : i + 64]))
                return b"".join(parts), f"the archive's compression is damaged: {e}"
            if member.eof:
                break
        if not member.eof:
            return b"".join([*parts, member.flush()]), "the archive's compression ends early"
        raw = member.unused_data + raw[at + (1 << 16) :]
        if not raw.strip(b"\0"):
            break
    return b"".join(parts), None


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (lower-case names), block and error of each record; what isn't a record is skipped up to the next one."""

    def next_record(at: int) -> int:
        while (at := archive.find(b"WARC/1.", at)) > 0 and archive[at - 1] != 0x0A:
            at += 1
        return at

    at = 0
    while (at := next_record(at)) >= 0:
        end = archive.find(b"\r\n\r\n", at)
        fields, error = {}, None if end >= 0 else "the header has no end"
        head = archive[at : end if end >= 0 else len(archive)]
        try:
            head.decode()
        except UnicodeDecodeError:
            error = error or "the header isn't UTF-8"
        for line in head.decode(errors="backslashreplace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        begin = end + 4
        if end < 0:
            yield fields, b"", error
            return
        said = fields.get("content-length", "")
        stop = begin + int(said) if said.isascii() and said.isdigit() else -1
        if stop > len(archive) or stop >= 0 and archive[stop : stop + 4] not in (b"\r\n\r\n", b"\r\n\r", b"\r\n", b"\r", b""):
            error, stop = error or f"the block doesn't end after {said} bytes", -1
        elif stop < 0:
            error = error or "no Content-Length"
        if stop < 0:
            stop = archive.find(b"\r\n\r\nWARC/1.", end)
            stop = len(archive) if stop < 0 else stop
        yield fields, archive[begin:stop], error
        at = max(stop, begin)


def _decoded(kind: str, block: bytes, said: str, total: str | None) -> tuple[bytes, str | None, str | None]:
    """Payload of an HTTP block, its digest, and what is wrong with it. A revisit has no payload of its own."""
    if total is not None and str(len(block)) != total:
        return b"", None, f"the segments have {len(block)} of {total} bytes"
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        return b"", None, None
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return b"", None, f"chunked framing: {e}"
    found = digest(payload)
    return payload, found, None if not said or found == said.removeprefix("sha1:") else "the payload doesn't have the digest said"


_PARSED = "origin string, number int, total string, record_type string, uri string, said string, refers_to string, block binary, payload binary, payload_bytes bigint, digest string, error string, whole boolean"


def _parse(with_payload: bool):
    names = ("origin", "number", "total", "record_type", "uri", "said", "refers_to", "block", "payload", "payload_bytes", "digest", "error", "whole")
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                out, held = [], 0
                content, damage = inflated(archive.as_py())
                for f, block, error in parsed(content):
                    kind, number = f.get("warc-type", ""), f.get("warc-segment-number")
                    if number is not None and not (number.isascii() and number.isdigit() and len(number) < 10):
                        number, error = None, error or "the segment's number is no number"
                    said, payload, own = f.get("warc-payload-digest", ""), None, None
                    if error:
                        number, payload = None, b""
                    elif number is None:
                        payload, own, error = _decoded(kind, block, said, None)
                    size = None if payload is None else len(payload)
                    origin = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                    kept = payload if with_payload else None
                    out.append((origin, int(number or 1), f.get("warc-segment-total-length"), kind, f.get("warc-target-uri"), said, f.get("warc-refers-to"), block if number else None, kept, size, own, error, number is None))
                    held += len(block)
                    if held > 4 << 20:
                        yield packed(out)
                        out, held = [], 0
                if damage:
                    out.append((None, 1, None, "", None, None, None, None, b"" if with_payload else None, 0, None, damage, True))
                if out:
                    yield packed(out)

    return run


def _joined(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                blocks: dict[int, list[bytes]] = {}
                for p in parts:
                    blocks.setdefault(p["number"], []).append(p["block"])
                first, last = parts[0], parts[-1]
                # Pages that are there twice have every segment twice.
                copies = len(blocks[first["number"]])
                wrong = None
                if first["record_type"] == "continuation":
                    wrong = "the first segment is missing"
                elif list(blocks) != list(range(1, len(blocks) + 1)):
                    wrong = "a segment is missing"
                elif any(x != [x[0]] * copies for x in blocks.values()):
                    wrong = "segments of one number differ"
                elif last["total"] is None:
                    wrong = "the last segment is missing"
                payload, own, error = (b"", None, wrong) if wrong else _decoded(first["record_type"], b"".join(x[0] for x in blocks.values()), first["said"], last["total"])
                kind = "response" if first["record_type"] == "continuation" else first["record_type"]
                out += [(origin, kind, p["uri"], p["said"], p["refers_to"], payload if with_payload else None, len(payload), own, error) for p in parts[: 1 if wrong else copies]]
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["origin", "record_type", "uri", "said", "refers_to", "payload", "payload_bytes", "digest", "error"])

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(record_id, record_type, uri, payload_digest, refers_to, payload, payload_bytes, error) of every record or reassembled record.

    The digest is that of the payload read; where there is none (a revisit, a broken record), the header's.

    Without payload that column is null, and only segments are kept between the two steps; all else is checked just the same.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = stored(files.mapInArrow(_parse(with_payload), _PARSED), "records")
    names = ["origin", "record_type", "uri", "said", "refers_to", "payload", "payload_bytes", "digest", "error"]
    # A record's segments meet in one row: no more than that one page.
    parts = F.array_sort(F.collect_list(F.struct("number", "record_type", "uri", "said", "refers_to", "total", "block")))
    segments = records.where("not whole").groupBy("origin").agg(parts.alias("parts"))
    schema = "origin string, record_type string, uri string, said string, refers_to string, payload binary, payload_bytes bigint, digest string, error string"
    every = records.where("whole").select(*names).unionByName(segments.mapInArrow(_joined(with_payload), schema))
    return every.select(F.col("origin").alias("record_id"), "record_type", "uri", F.coalesce("digest", F.regexp_replace("said", "^sha1:", "")).alias("payload_digest"), "refers_to", "payload", "payload_bytes", "error")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of every page, from its archive."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes, segment_bytes)
    number = lambda c: F.when(F.regexp_extract(c, _PAGE, 1) != "", F.regexp_extract(c, _PAGE, 1)).cast("long")
    records = read_warc(spark, path, with_payload=False).select(
        number("record_id").alias("page_id"), F.col("payload_bytes").alias("own_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), "error"
    )
    records = stored(records, "pages")
    # A revisit has no payload of its own: its size is the response's.
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    return records.join(full, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "error"
    )
