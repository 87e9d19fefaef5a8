import base64
import hashlib
import struct

import pytest
import zstandard

from tesserae.llm import warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = last.get(h or "")
        out.append((i, len(b), sha(b), "response" if ref in (None, i) else "revisit", None if ref == i else ref))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, f"http://a/{i}", f"<html>é page {i % 40}\r\n\r\nWARC/1.1 body {'x' * (i % 7)}</html>") for i in range(300)]
    rows += [(900, None, None), (901, "u\r\nv", ""), (902, "u", "big " * 30_000), (None, "u", "only"), (None, "u", "<html>"), (77, "again", "<html>"), (77, "again", "<html>"), (-5, "u", "\x00")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(warc.with_references(df))
    got = warc.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    texts = {h or "" for _, _, h in rows}
    assert {r.payload for r in got if r.record_type == "response"} == texts


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, fp int")
    assert warc.read_archives(warc.write_archives(warc.with_references(df))).collect() == []


def test_dictionary_frame_and_damage():
    records = [warc.record(i, "http://x/", f"<p>some shared text {i} {'lorem ipsum ' * 30}</p>".encode(), None) for i in range(100)]
    data = warc.archive(records)
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    assert list(warc.frames(data)) == records
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.compress(data[8 : 8 + size])
    assert list(warc.frames(struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size :])) == records
    for bad in (data[:-3], data[: size // 2], data + b"junkjunk"):
        with pytest.raises(warc.BadRecord):
            list(warc.frames(bad))
    one = warc.record(1, "u", b"abc", None)
    for bad in (one.replace(b"abc", b"abd"), one[:-1], one.replace(b"WARC/1.1", b"WARX/1.1"), one.replace(b"WARC-Date", b"X-Date"), one.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)


def test_reading_is_linear_in_the_records():
    """Bytes handed to the decompressor stay below three times the archive's size plus a piece a record."""
    records = [warc.record(i, "http://x/", b"p%d" % i * (1 + i % 50), None) for i in range(3000)] + [warc.record(-1, "u", bytes(range(256)) * 40_000, None)]
    data = warc.archive(records)
    fed = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def decompressobj(self):
            one = self.real.decompressobj()

            class Fed:
                eof = property(lambda s: one.eof)
                unused_data = property(lambda s: one.unused_data)

                def decompress(self, piece):
                    fed.append(len(piece))
                    return one.decompress(piece)

            return Fed()

    real = zstandard.ZstdDecompressor
    zstandard.ZstdDecompressor = lambda *a, **k: Counting(real(*a, **k))
    try:
        assert list(warc.frames(data)) == records
    finally:
        zstandard.ZstdDecompressor = real
    assert sum(fed) <= 3 * len(data) + warc.LEAST_PIECE * len(records)
