"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write`` makes a record of each page and writes one archive per partition through Spark's own writer, so
archives go wherever Spark can write and a lost task leaves nothing behind. Every row it writes is a frame,
and the separator it puts between rows is an empty skippable frame, which readers pass over. ``read`` takes a
folder of archives, loads each archive's dictionary, decodes one frame at a time and validates it.

Of pages with equal payloads of at least ``min_bytes``, the one with the smallest id becomes a response and
the others revisits of it. A null html is an empty payload; a null url becomes a URN of the page. Null ids are
larger than all others. Repeated rows with the smallest id are all responses. An empty table makes an empty
folder, which reads as an empty table. Other columns of the pages are not archived.

An archive is held whole in memory while it is read: write partitions of some 100 MB at most, as Spark's
usual partition sizes give. A file that is no archive, or a damaged record, gives a row with ``problem`` set;
reading goes on with the next frame while the frames can be told apart.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
WARC_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("archive STRING, offset BIGINT, page_id STRING, url STRING, record_type STRING, payload_bytes BIGINT, "
          "payload_digest STRING, refers_to STRING, payload BINARY, problem STRING")


def train_dictionary(pages: DataFrame, html: str = "html", sample: int = 1000, sample_chars: int = 16384,
                     size: int = 32768) -> bytes:
    """A dictionary from the beginnings of at most ``sample`` pages, chosen by a hash of their content."""
    n = pages.count()
    chosen = F.pmod(F.xxhash64(F.col(f"`{html}`")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 2 * sample / max(n, 1))))
    rows = pages.filter(chosen).select(F.left(F.col(f"`{html}`"), F.lit(sample_chars)).alias("h")).limit(sample).collect()
    samples = [r.h.encode("utf-8", "replace") for r in rows if r.h]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few pages to train on: their text itself serves
        return b"".join(samples)[:size] or b"<!DOCTYPE html>"


def record_uri(page_id: str | None) -> str:
    return f"<urn:x-page:{quote(page_id, safe='') if page_id is not None else ''}>"


def _page_of(uri: str | None) -> str | None:
    return unquote(uri[len("<urn:x-page:"):-1]) or None if uri else None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC 1.1 record."""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else record_uri(page_id)[1:-1]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", WARC_DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block)))]
    if revisit:
        fields += [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``_id, _digest, _refers``: the pages whose payload an earlier page has. No payload is shuffled."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    keyed = (pages.select(F.col(f"`{page_id}`").alias("_id"), F.sha1(payload.cast("binary")).alias("_digest"),
                          F.octet_length(payload).alias("_n")).filter(F.col("_n") >= min_bytes))
    first = (keyed.groupBy("_digest").agg(F.min("_id").alias("_refers"), F.count("*").alias("n"))
             .filter(F.col("n") > 1).select("_digest", "_refers"))
    return (keyed.join(first, "_digest").filter(~F.col("_id").eqNullSafe(F.col("_refers")))
            .groupBy("_id", "_digest").agg(F.min("_refers").alias("_refers")))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = 0, dictionary: bytes | None = None, level: int = 3) -> None:
    """Archive ``pages`` in ``folder``."""
    dictionary = train_dictionary(pages, html) if dictionary is None else dictionary
    found = revisits(pages, page_id, html, min_bytes)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.col(f"`{html}`").alias("html"))
    same = rows["page_id"].eqNullSafe(found["_id"]) & (F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == found["_digest"])
    rows = rows.join(found, same, "left").select(
        F.col("page_id").cast("string"), "url", "html", F.col("_digest").isNotNull().alias("revisit"),
        F.col("_refers").cast("string").alias("refers_to"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for batch in batches:
            out = [head] if head else []
            head = b""
            for page, address, text, again, refers in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (text or "").encode("utf-8", "replace")
                out.append(packer.compress(record(page, address, payload, refers, again)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    (rows.mapInArrow(frames, "frame BINARY").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder))


class Damaged(ValueError):
    """What is wrong with an archive or record."""


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame at ``start`` ends."""
    try:
        at = start + zstandard.frame_header_size(data[start:start + 18])
        checksum = zstandard.get_frame_parameters(data[start:start + 18]).has_checksum
    except zstandard.ZstdError as problem:
        raise Damaged(f"frame header: {problem}") from None
    last = False
    while not last:
        if at + 3 > len(data):
            raise Damaged("frame is cut off")
        block = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise Damaged("frame is cut off")
    return at


def frames(content: bytes) -> Iterator[tuple[int, memoryview]]:
    """Offset and bytes of each frame that is not skippable; the first pair is the dictionary's."""
    data, at, first = memoryview(content), 0, True
    while at < len(data):
        if at + 8 > len(data):
            raise Damaged("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if first:
            if magic != DICTIONARY_MAGIC:
                raise Damaged("no dictionary in a leading skippable frame")
            yield at, data[8:8 + size]
            first = False
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise Damaged("not a Zstandard frame")
        end = frame_end(data, at)
        yield at, data[at:end]
        at = end


def parse(data: bytes) -> dict:
    """The one record in ``data``, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise Damaged("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise Damaged(f"header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Damaged(f"no {name}")
    length = fields["content-length"]
    if not length.isdecimal() or int(length) + 4 != len(rest) or rest[int(length):] != b"\r\n\r\n":
        raise Damaged("content-length differs from the block")
    block = rest[:int(length)]
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise Damaged("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    size = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not found or not http.startswith(b"HTTP/") or not size.isdigit():
        raise Damaged("no HTTP header with a length")
    kind, named = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind == "response" and (int(size) != len(payload) or named != "sha1:" + digest(payload)):
        raise Damaged("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or not named.startswith("sha1:")):
        raise Damaged("revisit with a payload or without what it refers to")
    return {"page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": int(size), "payload_digest": named.removeprefix("sha1:"),
            "refers_to": _page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def records(archive: str, content: bytes) -> Iterator[dict]:
    """Rows of one archive."""
    unpacker, offset = None, 0
    try:
        for offset, frame in frames(content):
            if unpacker is None:
                if len(frame) >= 4 and struct.unpack_from("<I", frame)[0] == FRAME_MAGIC:
                    frame = zstandard.ZstdDecompressor().decompress(frame)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
                continue
            row = {"archive": archive, "offset": offset}
            try:
                yield row | parse(unpacker.decompress(frame))
            except (Damaged, zstandard.ZstdError) as problem:
                yield row | {"problem": str(problem)}
    except (Damaged, zstandard.ZstdError) as problem:
        yield {"archive": archive, "offset": offset, "problem": str(problem)}


def read(spark: SparkSession, folder: str, payload: bool = True, batch_bytes: int = 1 << 24) -> DataFrame:
    """A row per record: ``archive, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to``,
    the ``payload`` (null for revisits, left out on request) and ``problem`` (null if valid). Ids are strings.
    """
    names = [c.split(" ")[0] for c in RECORD.split(", ") if payload or not c.startswith("payload BINARY")]
    schema = ", ".join(c for c in RECORD.split(", ") if c.split(" ")[0] in names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("offset", "payload_bytes") else pa.string())
                           for n in names])
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in records(archive.as_py(), content.as_py()):
                    held.append({n: row.get(n) for n in names})
                    size += 200 + (len(row.get("payload") or b"") if payload else 0)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(rows, schema)
