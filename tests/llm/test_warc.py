"""Archives: round trips and damaged files."""

import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from turnloom.llm import warc

PAGES = [(1, "http://a.example/é?x=1&y=\n", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://c.example/", "<p>one</p>"),
         (4, "u", None), (5, "u", ""), (None, "u", "<p>one</p>"), (6, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 2000), (7, "u", "<p>two</p>")]


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def _frame(spark, pages=PAGES):
    return spark.createDataFrame([(*p, "z") for p in pages], "page_id LONG, url STRING, html STRING, digest STRING")


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(_frame(spark).repartition(3), folder)
    rows = warc.read(spark, folder).collect()
    assert all(r.problem is None for r in rows)
    first = {}
    for i, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}
    want = set()
    for i, _, html in PAGES:
        is_first = first[html or ""] == i
        want.add((None if i is None else str(i), len((html or "").encode()), _digest(html),
                  "response" if is_first else "revisit", None if is_first else str(first[html or ""])))
    assert got == want and len(rows) == len(PAGES)
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(p[2] or "").encode() for p in PAGES}


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(_frame(spark), folder, min_bytes=1)
    assert {r.page_id: r.record_type for r in warc.read(spark, folder).collect()}["5"] == "response"


def test_repeated_rows_and_empty_table(spark, tmp_path):
    df = _frame(spark, [PAGES[0], PAGES[0], PAGES[2]])
    warc.write(df, str(tmp_path / "a"))
    kinds = sorted((r.page_id, r.record_type) for r in warc.read(spark, str(tmp_path / "a")).collect())
    assert kinds == [("1", "response"), ("1", "response"), ("3", "revisit")]
    warc.write(df.limit(0), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_archive_is_plain_zstandard_with_a_dictionary(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(_frame(spark).coalesce(1), folder)
    (path,) = [p for p in glob.glob(f"{folder}/part-*")]
    content = open(path, "rb").read()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size]))
    with unpack.stream_reader(content[8 + size:], read_across_frames=True) as reader:
        text = reader.read()
    assert text.count(b"WARC-Record-ID") == len(PAGES)


@pytest.mark.parametrize("change, problem", [
    (lambda c: b"x" + c, "no dictionary"), (lambda c: c[:-30], "cut off"), (lambda c: c + b"12", "after the last"),
    (lambda c: c + struct.pack("<I", 5) * 2, "not a Zstandard")])
def test_damaged_archives(change, problem):
    dictionary = b"<!DOCTYPE html>"
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    content = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    content += pack.compress(warc.record("1", "u", b"hello" * 50, None, False)) + warc.EMPTY_FRAME.encode()
    content += pack.compress(warc.record("2", "u", bytes(range(200)), None, False))
    rows = list(warc.records("a", change(content)))
    assert problem in rows[-1]["problem"]


@pytest.mark.parametrize("old, new, problem", [
    (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 5\r\n\r\nhellooo", "content-length"),
    (b"hello", b"jello", "digest"), (b"WARC/1.1", b"WORC/1.1", "no WARC"), (b"WARC-Type: response", b"WARC-Type response", "header line"),
    (b"WARC-Record-ID", b"WARC-Other-ID", "no warc-record-id")])
def test_damaged_records(old, new, problem):
    data = warc.record("1", "u", b"hello", None, False)
    assert warc.parse(data)["payload"] == b"hello"
    with pytest.raises(warc.Damaged, match=problem):
        warc.parse(data.replace(old, new))
