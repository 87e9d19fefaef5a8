"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are rows (path, content), the columns of Spark's binaryFile source, so that archives read with
spark.read.format("binaryFile") and archives written here are read alike; Spark's committer makes lost
executors and repeated tasks harmless. Each archive holds at most ARCHIVE_BYTES of payloads (one larger record is
an archive of its own).

Records with equal payloads are one group: the row of the largest page_id is the response, the others are revisits
that refer to it and carry no payload. Rows that repeat the largest page_id are all responses. Null html is an
empty payload; null page_id makes a record without a page (a response only if no row of the group has an id);
null url is the empty target. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import lookup, map_rows, materialize, read

ARCHIVE_BYTES = 8 << 20
DICT_BYTES, DICT_SAMPLES, SAMPLE_BYTES = 16_384, 200, 8_192
LEAST_PIECE = 1024
#: Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit whose HTTP head keeps the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, if the records are enough to make one, and a frame for each record."""
    dictionary, out = None, []
    if len(records) >= 16:
        step = max(1, len(records) // DICT_SAMPLES)
        try:
            dictionary = zstandard.train_dictionary(DICT_BYTES, [r[:SAMPLE_BYTES] for r in records[::step]])
        except zstandard.ZstdError:  # too little to learn from
            dictionary = None
    if dictionary:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    pack = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join(out + [pack.compress(r) for r in records])


def frames(content: bytes) -> Iterator[bytes]:
    """Decodes one frame after the other with the dictionary of the leading skippable frame."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) < size:
            raise BadRecord("the dictionary's frame is cut off")
        if raw[:4] == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpack, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(content)
    while at < len(content):
        kind = struct.unpack_from("<I", content, at)[0] if at + 8 <= len(content) else None
        if kind is not None and 0x184D2A50 <= kind <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        if content[at : at + 4] != FRAME:
            raise BadRecord(f"no frame at {at}")
        # fed by pieces of doubling size, so that what is read past a frame's end is no longer than the frame
        one, out, piece = unpack.decompressobj(), [], LEAST_PIECE
        while not one.eof:
            if at >= len(content):
                raise BadRecord("the last frame is cut off")
            try:
                out.append(one.decompress(view[at : at + piece]))
            except zstandard.ZstdError as e:
                raise BadRecord(str(e)) from e
            at, piece = min(at + piece, len(content)), 2 * piece
        at -= len(one.unused_data)
        data = b"".join(out)
        yield data


def parse(data: bytes) -> dict:
    """A record's headers and payload; raises BadRecord unless headers, lengths and digest are right."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    pairs = [line.partition(":") for line in lines[1:]]
    if any(not p[1] or not p[0] for p in pairs):
        raise BadRecord("a header line without a name")
    h = {name.lower(): value.strip(" ") for name, _, value in pairs}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise BadRecord(f"no {name}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("Content-Length does not fit the record")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    size = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(size) != 1 or not size[0].isdigit():
        raise BadRecord("the HTTP head lacks a length")
    kind, said = h["warc-type"], h.get("warc-payload-digest", "")
    if kind == "response" and (len(payload) != int(size[0]) or said != "sha1:" + digest(payload)):
        raise BadRecord("the payload does not fit its length and digest")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise BadRecord("neither a response nor a right revisit")
    return {"headers": h, "payload": payload, "payload_bytes": int(size[0]), "payload_digest": said.removeprefix("sha1:"), "record_type": kind}


def page_of(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses). Payloads smaller than min_bytes are all responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("fp", F.concat(F.sha1(F.col("html").cast("binary")), F.lit(":"), F.octet_length("html")))
    groups = p.filter(F.octet_length("html") >= min_bytes).groupBy("fp").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
    out = lookup(p, groups, "fp", "n", F.struct("page_id", "url"))
    return out.select("page_id", "url", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """(path, content) of archives for (page_id, url, html, refers_to)."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        held, size = [], 0
        for r in rows:
            held.append(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["refers_to"]))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield make(held)
                held, size = [], 0
        if held:
            yield make(held)

    def make(held: list[bytes]) -> dict:
        content = archive(held)
        return {"path": f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst", "content": content}

    return map_rows(pages, run, "path string, content binary", 1)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of (path, content) archives, checked: headers, lengths, digests. With the payload's text."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            for data in frames(r["content"]):
                p = parse(data)
                h = p["headers"]
                text = p["payload"].decode("utf-8", "surrogatepass") if p["record_type"] == "response" else None
                yield {"page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": p["payload_bytes"], "payload_digest": p["payload_digest"], "record_type": p["record_type"], "refers_to": page_of(h.get("warc-refers-to")), "payload": text}

    return map_rows(archives.select("path", "content"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string", 256)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(with_references(read(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
