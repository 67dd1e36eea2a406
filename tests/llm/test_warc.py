"""WARC archives: exact round trip, revisits by definition, faults found."""

from __future__ import annotations

import hashlib
import io

import pytest

from logfold.llm import warc
from logfold.llm.folders import shared_folder


def expected(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        low = first.get(data)
        again = low is not None and page != low
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, payload string, digest int")
    return warc.archive_pages(df.repartition(3) if rows else df, **options).collect()


BIG = "<p>é" + "x" * 300_000
ROWS = [(5, "http://a/%20\r\nX: y", "a" * 100), (3, None, "a" * 100), (4, "u", "a" * 99), (6, "u", "a" * 99), (7, "u", None), (8, "u", ""),
        (9, "u", BIG), (1, "u", BIG), (1, "u", BIG), (None, "u", BIG), (None, "v", "z" * 200), (None, "v", "z" * 200),
        (20, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n" * 9)]


def test_round_trip_and_revisits(spark, sf):
    rows = ROWS + [(100 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = run(spark, rows)
    assert all(r.error is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_payloads_small_archives_and_spark_reader(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} " + "text of a page " * (i % 40)) for i in range(600)],
                               "page_id long, url string, html string")
    folder = shared_folder(spark, "warc-test")
    manifest = warc.write_archives(warc.mark_revisits(df), folder, archive_bytes=4000)
    assert manifest.count() > 3
    want = {r.page_id: (r.url, r.html.encode()) for r in df.collect()}
    own = warc.read_archives(manifest).collect()
    assert {r.page_id: (r.url, bytes(r.payload)) for r in own if r.payload is not None} | {
        r.page_id: want[r.page_id] for r in own if r.payload is None} == want
    files = spark.read.format("binaryFile").load(folder)
    other = warc.read_binary(files).collect()
    assert sorted((r.page_id, r.payload_digest) for r in other) == sorted((r.page_id, r.payload_digest) for r in own)


def test_empty_table(spark):
    assert run(spark, []) == []


def archive(n=30):
    w = warc.ArchiveWriter()
    records = []
    for i in range(n):
        data = (f"<html><body>{i} " + "some words of the page " * 20).encode()
        records.append(warc.build_record(i, "http://x", data, hashlib.sha256(data).hexdigest(), None, False))
        w.add(records[-1])
    return w.finish(), records


def test_dictionary_is_the_leading_frame():
    data, records = archive()
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    assert list(warc.read_frames(io.BytesIO(data))) == records
    alone, _ = archive(1)
    assert int.from_bytes(alone[:4], "little") != warc.DICT_MAGIC and len(list(warc.read_records(io.BytesIO(alone)))) == 1


@pytest.mark.parametrize("cut", [3, 6, 5000, -1, -40])
def test_cut_off_archives_are_reported(cut):
    data, _ = archive()
    *_, last = warc.read_records(io.BytesIO(data[:cut]))
    assert last["error"]


@pytest.mark.parametrize(("old", "new"), [
    (b"WARC/1.1", b"WARC/9.1"), (b"WARC-Date:", b"WARC-Xate:"), (b"Content-Length: ", b"Content-Length: 1"), (b"some words", b"some wordz"),
    (b"WARC-Type: ", b"WARC-Type; "), (b"\r\n\r\n", b"\r\n")])
def test_faulty_records_are_named(old, new):
    data = b"<html>some words" + b"x" * 200
    record = warc.build_record(1, "http://x", data, hashlib.sha256(data).hexdigest(), None, False)
    assert warc.parse_record(record)["page_id"] == 1
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(old, new, 1))


def frame_starts(data):
    """Places of the record frames of ``archive()``."""
    import zstandard

    at = 8 + int.from_bytes(data[4:8], "little")
    made, out = zstandard.ZstdCompressionDict(data[8:at]), []
    while at < len(data):
        out.append(at)
        frame = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
        frame.decompress(data[at:])
        at = len(data) - len(frame.unused_data)
    return out


def damaged(data, *places):
    out = bytearray(data)
    for k in places:
        out[k] ^= 0x5A
    return bytes(out)


def pages_and_errors(data):
    rows = list(warc.read_records(io.BytesIO(data)))
    return [r["page_id"] for r in rows if r["error"] is None], sum(r["error"] is not None for r in rows)


@pytest.mark.parametrize("read", [7, 1 << 18])
def test_records_after_a_damaged_frame_are_read(spark, monkeypatch, read):
    monkeypatch.setattr(warc, "_READ", read)
    data, _ = archive()
    at = frame_starts(data)
    assert len(at) == 30 and pages_and_errors(data) == (list(range(30)), 0)
    rest = [k for k in range(30) if k != 12]
    for place in (at[13] - 1, at[12], at[12] + 3, at[12] + 4, *range(at[12] + 5, at[13], 11)):  # checksum, magic, header, blocks
        assert pages_and_errors(damaged(data, place)) == (rest, 1), place - at[12]
    assert pages_and_errors(data[:at[12] + 20] + data[at[13]:]) == (rest, 1)
    assert pages_and_errors(data[:at[13]] + b"junk" + data[at[13]:]) == (list(range(30)), 1)
    two = [k for k in range(30) if k not in (12, 13)]
    assert pages_and_errors(damaged(data, at[13] - 1, at[14] - 1)) == (two, 2)
    assert pages_and_errors(damaged(data, at[30 - 1] + 30)) == (list(range(29)), 1)
    # A wrong size of the leading frame spoils the dictionary, but each record still has its row.
    assert sum(pages_and_errors(damaged(data, 7))[1:]) >= 30
    rows = [("a", damaged(data, at[13] - 1)), ("b", data)]
    got = warc.read_binary(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [sum(r.path == p and r.error is None for r in got) for p in "ab"] == [29, 30]


def test_frames_inside_a_damaged_frame_are_no_records():
    import os

    import zstandard

    inner = zstandard.ZstdCompressor(write_checksum=True).compress(b"not a record")
    w = warc.ArchiveWriter()
    for i in range(3):
        data = os.urandom(3000) + inner + os.urandom(3000)
        w.add(warc.build_record(i, "http://x", data, hashlib.sha256(data).hexdigest(), None, False))
    data = w.finish()
    middle = data.index(b"\x28\xb5\x2f\xfd", data.index(inner) + len(inner))
    assert inner in data and pages_and_errors(data) == ([0, 1, 2], 0)
    assert pages_and_errors(damaged(data, middle)) == ([0, 2], 1)
    assert pages_and_errors(damaged(data, middle + 900)) == ([0, 2], 1)
