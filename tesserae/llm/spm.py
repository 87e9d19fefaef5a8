"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read here: pieces with scores and types, the normaliser, the trainer's kind. From it a
tokenizers.Tokenizer is rebuilt: normaliser, metaspace marker, BPE merges or unigram scores, byte fallback. No piece
joins a character to a marker after it or holds a newline (checked for the model read), so a text's ids are those of its
segments, word by word; distinct segments are encoded in multithreaded batches and kept in a bounded cache. Every
segment that enters it is compared with the sentencepiece library's ids; `parity` is false for documents with one that
differs. Decoding joins the pieces of the ids.

Null text: null ids, 0 tokens. Empty text: no ids. Whole texts are encoded; special strings in a text are ordinary
text. Rows that repeat an id are encoded each; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import read, trim

#: Fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
CACHE, BATCH_CHARS, LEARN = 400_000, 2_000_000, 20_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = 1, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for n, v in fields(data):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                t = dict(fields(v))
                self.kind, self.byte_fallback = t.get(3, 1), bool(t.get(35, 0))
            elif n == 3:
                t = dict(fields(v))
                self.charsmap, self.dummy_prefix, self.squeeze, self.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
        if self.kind not in (1, 2):
            raise NotImplementedError("only unigram and BPE models")
        if any(t == USER_DEFINED for _, _, t in self.pieces):
            raise NotImplementedError("user-defined pieces")
        if self.kind == 1 and not self.escape:
            raise NotImplementedError("unigram models without the marker for spaces")
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        usable = [p for p, _, t in self.pieces if t == NORMAL]
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        self.by_line = not any("\n" in p for p in usable)

    def tokenizer(self):
        """The tokenizers.Tokenizer for text in which markers stand for spaces already."""
        from tokenizers import Tokenizer, models

        if self.kind == 1:
            # only ordinary pieces are words: the others stand under names with a space, which no marked text holds,
            # and with a score that leaves the lowest one as it is; bytes of unknown characters are put in by Codec
            least = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
            vocab = [(p, s) if t == NORMAL else (f" {i}", least) for i, (p, s, t) in enumerate(self.pieces)]
            return Tokenizer(models.Unigram(vocab, unk_id=self.unk, byte_fallback=False))
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        plain = {p for p, _, t in self.pieces if t == NORMAL}
        merges = []
        for p, s, t in self.pieces:
            if t == NORMAL:
                merges += [(-s, ids[p], ids[p[:i]], (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in plain and p[i:] in plain]
        merges.sort(key=lambda m: m[:3])
        return Tokenizer(models.BPE(ids, [m[3] for m in merges], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0))

    def normalizer(self):
        """The normaliser without the marker; None if it changes nothing."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        return normalizers.Sequence(steps) if steps else None


class Codec:
    """Encodes and decodes texts; made once a task."""

    def __init__(self, data: bytes, check: bool = True) -> None:
        self.model = Model(data)
        self.tok, self.norm = self.model.tokenizer(), self.model.normalizer()
        self.cache: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]
        by_value = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE}
        self.byte_ids = by_value if self.model.kind == 1 and self.model.byte_fallback and len(by_value) == 256 else {}
        parts = ("\n|" if self.model.by_line else "") + f"{MARK}*[^{MARK}" + ("\n" if self.model.by_line else "") + f"]+|{MARK}+"
        self.split = re.compile(parts).findall if self.model.by_word else lambda s: [s]
        self.sp = None
        if check:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            # ids of a segment stand behind those of a newline, which no piece crosses
            self.lead = "\n" if self.model.by_line and self.model.by_word and self.model.byte_fallback and not self.norm else None
            self.skip = len(self.sp.encode(self.lead)) if self.lead else 0

    def segments(self, text: str) -> list[str]:
        if self.norm:
            text = self.norm.normalize_str(text)
        if not text:
            return []
        if self.model.dummy_prefix:
            text = " " + text
        return self.split(text.replace(" ", MARK) if self.model.escape else text)

    def learn(self, new: list[str]) -> None:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        collects = gc.isenabled()
        gc.disable()  # short lists by the million, no cycles
        for lo in range(0, len(new), LEARN):
            part = new[lo : lo + LEARN]
            ids = [e.ids for e in encode(part, add_special_tokens=False)]
            if self.byte_ids:
                odd = [k for k, i in enumerate(ids) if self.model.unk in i]
                for k, e in zip(odd, self.tok.encode_batch([part[k] for k in odd], add_special_tokens=False), strict=True):
                    ids[k] = self.with_bytes(part[k], e)
            if self.sp and self.lead:
                said = self.sp.encode([self.lead + s.replace(MARK, " ") for s in part], num_threads=2)
                self.differ.update(s for s, a, b in zip(part, ids, said, strict=True) if a != b[self.skip :])
            self.cache.update(zip(part, (array("i", i).tobytes() for i in ids), strict=True))
        if collects:
            gc.enable()

    def with_bytes(self, segment: str, e) -> list[int]:
        """Ids of an encoding with the bytes of the characters that are no piece."""
        out: list[int] = []
        for i, (start, end) in zip(e.ids, e.offsets, strict=True):
            out += [self.byte_ids[b] for b in segment[start:end].encode("utf-8", "surrogatepass")] if i == self.model.unk else [i]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool] | None]:
        """Ids, and whether the reference library agrees, for each text."""
        cut = [None if t is None else self.segments(t) for t in texts]
        need = {s for c in cut if c for s in c}
        new = [s for s in need if s not in self.cache]
        if new:
            if len(self.cache) + len(new) > CACHE:  # what this batch needs stays
                self.cache = {s: self.cache[s] for s in need if s in self.cache}
                self.differ &= need
            self.learn(new)
        out: list[tuple[np.ndarray, bool] | None] = []
        for t, c in zip(texts, cut, strict=True):
            if c is None:
                out.append(None)
                continue
            ids = np.frombuffer(b"".join(map(self.cache.__getitem__, c)), np.int32)
            if not self.model.byte_fallback and len(ids):  # unknown characters in a row are one, across segments too
                unk = ids == self.model.unk
                ids = ids[~np.append(False, unk[1:] & unk[:-1])]
            same = self.differ.isdisjoint(c) if self.differ else True
            if self.sp and not self.lead:
                same = ids.tolist() == self.sp.encode(t)
            out.append((ids, same))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding gives the text again), parity."""
    with open(model_path or default_model(), "rb") as f:  # on the driver; executors get the bytes
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()), ("parity", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, check)

        def out(ids: list, texts: list) -> pa.RecordBatch:
            got = codec.encode(texts)
            sizes = np.concatenate([[0], np.cumsum([0 if g is None else len(g[0]) for g in got])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *[g[0] for g in got if g]])
            null = pa.array([g is None for g in got])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
            lists = pa.compute.if_else(null, pa.scalar(None, lists.type), lists)
            same = [None if g is None else codec.norm is not None and codec.decode(g[0]) == codec.norm.normalize_str(t) or codec.decode(g[0]) == t for g, t in zip(got, texts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(sizes).astype(np.int64)), lists, pa.array(same, pa.bool_()), pa.array([None if g is None else g[1] for g in got], pa.bool_())], schema=schema)

        import pyarrow.compute  # noqa: F401

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= BATCH_CHARS:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)
        trim()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    with open(model_path or default_model(), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, False)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [None if i.as_py() is None else codec.decode(i.values.to_numpy()) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
