import base64
import gzip
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import warc as W


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        revisit = len((html or "").encode()) >= least and i != max(same)
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", max(same) if revisit else None, None))
    return sorted(out)


ROWS = [(i, f"http://h/{i} a\n", h) for i, h in enumerate(["<p>ünï</p>" * 3, None, "", "x" * 90, "漢字" * 60, "x" * 90, "<p>ünï</p>" * 3, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "0\r\n\r\n", "x" * 90, "\r\n" * 40])]


def test_round_trip_in_small_segments(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    for least in (0, 20):
        got = W.round_trip(pages, least, segment_bytes=64).collect()
        assert sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")) for r in got) == brute(ROWS, least)


def test_repeated_rows_and_null_ids_and_nothing(spark):
    rows = [(1, "u", "y" * 300), (1, "u", "y" * 300), (0, None, "y" * 300), (None, "u", "z")]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=100).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to, r.error) for r in got) == [("0", 300, "revisit", 1, None), ("1", 300, "response", None, None), ("1", 300, "response", None, None), ("None", 1, "response", None, None)]
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_null_and_reused_ids_of_long_pages(spark, tmp_path):
    rows = [(None, "u0", "a" * 300), (None, "u1", "b" * 400), (7, "u2", "c" * 350), (7, "u3", "d" * 500), (7, "u4", "d" * 500), (3, "u5", "c" * 350), (-2, "u6", "d" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.round_trip(pages, segment_bytes=100).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    want = [(i, len(h), digest(h), "response", None, None) for i, _, h in rows[:5]] + [(i, len(h), digest(h), "revisit", 7, None) for i, _, h in rows[5:]]
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)
    W.write_warc(pages, str(tmp_path / "w"), segment_bytes=100)
    read = W.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.uri, bytes(r.payload).decode()) for r in read) == [(u, h if i in (None, 7) else "") for i, u, h in rows]


def test_damage_is_reported(spark, tmp_path):
    page = next(iter([list(W.records_of(5, "u", b"q" * 500, None, False, 100))]))
    for name, records, wrong in (
        ("lost", page[:2] + page[3:], "a segment is missing"), ("cut", page[:-1], "the last segment is missing"), ("headless", page[1:], "the first segment is missing"),
        ("changed", [p.replace("qqqq", "rqqq", 1) for p in page], "the payload doesn't have the digest said"), ("shuffled", page[::-1], None),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text("".join(r + "\n" for r in records), newline="")
        got = W.read_warc(spark, str(tmp_path / name)).collect()
        assert len(got) == 1 and got[0].error == wrong, name


def raw_record(name, block, length=None, extra=b""):
    length = b"Content-Length: %d\r\n" % len(block) if length is None else length
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\n" % name + extra + length + b"\r\n" + block + b"\r\n\r\n"


def read_back(spark, folder, raw):
    folder.mkdir()
    (folder / "a.warc").write_bytes(raw)
    return sorted(((r.record_id, bytes(r.payload).decode(), r.error) for r in W.read_warc(spark, f"file://{folder}").collect()), key=repr)


def test_broken_records_are_rows(spark, tmp_path):
    """Each among two sound records, which are read all the same."""
    http = lambda t: b"HTTP/1.1 200 OK\r\n\r\n" + t
    one, two = raw_record(b"1", http(b"one")), raw_record(b"2", http(b"two"))
    sound = [("<1>", "one", None), ("<2>", "two", None)]
    broken = {
        "bytes": (raw_record(b"b", http(b"x"), extra=b"X-Odd: \xff\xfe\r\n"), "the header isn't UTF-8"),
        "absent": (raw_record(b"b", http(b"x"), length=b""), "no Content-Length"),
        "words": (raw_record(b"b", http(b"x"), length=b"Content-Length: many\r\n"), "no Content-Length"),
        "large": (raw_record(b"b", http(b"x"), length=b"Content-Length: 60\r\n"), "the block doesn't end after 60 bytes"),
        "larger": (raw_record(b"b", http(b"x"), length=b"Content-Length: 99999\r\n"), "the block doesn't end after 99999 bytes"),
        "small": (raw_record(b"b", http(b"x" * 50), length=b"Content-Length: 30\r\n"), "the block doesn't end after 30 bytes"),
        "number": (raw_record(b"b", http(b"x"), extra=b"WARC-Segment-Number: two\r\n"), "the segment's number is no number"),
        "chunk": (raw_record(b"b", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n-5\r\nx"), "chunked framing: a chunk of a negative size"),
    }
    for name, (record, wrong) in broken.items():
        for place, raw in (("middle", one + record + two), ("last", one + two + record)):
            assert read_back(spark, tmp_path / f"{name}-{place}", raw) == sorted([*sound, ("<b>", "", wrong)], key=repr), (name, place)
    cut = (one + two + raw_record(b"b", http(b"x" * 90)))[:-60]
    assert read_back(spark, tmp_path / "cut", cut) == sorted([*sound, ("<b>", "", f"the block doesn't end after {len(http(b'x' * 90))} bytes")], key=repr)
    assert read_back(spark, tmp_path / "headless", one + two + b"WARC/1.1\r\nWARC-Record-ID: <b>") == sorted([*sound, ("<b>", "", "the header has no end")], key=repr)


def test_damaged_compression_is_a_row(spark, tmp_path):
    records = [raw_record(b"%d" % i, b"HTTP/1.1 200 OK\r\n\r\n" + hashlib.sha256(b"%d" % i).hexdigest().encode() * 40) for i in range(40)]
    whole, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    assert len(read_back(spark, tmp_path / "sound", members)) == 40 and all(r[2] is None for r in read_back(spark, tmp_path / "whole", whole))
    for name, raw in (("cut", whole[: len(whole) // 2]), ("member", members[:-30]), ("flipped", whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :])):
        got = read_back(spark, tmp_path / name, raw)
        assert sum(r[0] is None and "compression" in r[2] for r in got) == 1 and sum(r[2] is None for r in got) >= 10, name


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_framing(text):
    raw = text.encode()
    before, W.CHUNK_BYTES = W.CHUNK_BYTES, 7
    try:
        assert W.unchunked(W.chunked(raw)) == raw
    finally:
        W.CHUNK_BYTES = before
    assert b"".join(W._cut(raw, 5)) == raw
