import random
import struct

import pytest
import sentencepiece

from tesserae.llm import spm

TEXTS = ["", " ", "  ", "a", "Hello world", "  two  spaces ", "tab\tand\nnew\n\nlines \n x", "<s> </s> <0x0A> <unk>", "é ñ ß 𝒳 漢字 ▁ mark▁ed", "\x00\x01", "a" * 500, "näive", "trailing ", "1234.5678 %%% ***"]


def texts():
    r = random.Random(1)
    return TEXTS + ["".join(r.choice("ab cdé\n .,THe  1ß漢▁") for _ in range(r.randint(1, 200))) for _ in range(300)]


def test_same_ids_as_the_reference_library():
    data = open(spm.default_model(), "rb").read()
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Codec(data)
    for t, got in zip(texts(), codec.encode(texts()), strict=True):
        assert (got[0].tolist() == sp.encode(t)) or not got[1], repr(t)
        assert codec.decode(got[0]) == t.replace("▁", " "), repr(t)
    assert len(codec.differ) == 0


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(spm, "CACHE", 50)
    monkeypatch.setattr(spm, "BATCH_CHARS", 300)
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(99, None, 0), (None, "x", 0), (3, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    enc = spm.encode_documents(df)
    out = enc.collect()
    assert len(out) == len(rows) and all(x.parity and (x.round_trip or x.doc_id == 8) for x in out if x.ids is not None)
    null = [x for x in out if x.doc_id == 99][0]
    assert null.ids is None and null.n_tokens == 0 and all(x.n_tokens == len(x.ids) for x in out if x.ids is not None)
    dec = sorted(map(tuple, spm.decode_documents(enc).collect()), key=str)
    assert dec == sorted(((i, None if t is None else t.replace("▁", " ")) for i, t, _ in rows), key=str)
    assert spm.encode_documents(df.limit(0)).collect() == []


def varint(x):
    out = []
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return out + [x]


def msg(n, b):
    return bytes([n << 3 | 2, *varint(len(b))]) + b


def by_hand(words, kind=1, fallback=True, special=()):
    """A model made by hand in the file format: pieces with scores, no training."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] * fallback + [(p, 0.0, t) for p, t in special]
    pieces += [(w, s, 1) for w, s in words]
    body = b"".join(msg(1, msg(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    return body + msg(2, bytes([3 << 3, kind]) + bytes([*varint(35 << 3), int(fallback)])) + msg(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


SPECIAL = ["ab<s>cd", "</s>", "<0x41>", "<unk>", "<s>", "a<0x0A>b", "▁<unk>▁", "<0x4", "é<s>é漢", " 7", " 1 2"]


def test_special_strings_are_ordinary_text():
    """With both kinds of models, with and without byte fallback, with the characters known and unknown."""
    r = random.Random(3)
    for alphabet in ("abcd", "abcdsunk<>/0x41"):
        letters = [(c, -2.0 - r.random()) for c in ["▁", *sorted(set(alphabet))]]
        words = letters + [(w, -3.0 - r.random()) for w in ("ab", "bc", "▁a", "cd", "▁ab")]
        bpe = letters + [(w, -float(i)) for i, w in enumerate(("ab", "▁a", "cd", "▁ab"))]
        for kind, some in ((1, words), (2, bpe)):
            for fallback in (True, False):
                data = by_hand(some, kind, fallback)
                sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Codec(data)
                for t in SPECIAL + ["".join(r.choice("abcd  <s>é漢\n0x41unk/") for _ in range(r.randint(0, 40))) for _ in range(100)]:
                    got = codec.encode([t])[0]
                    assert got[0].tolist() == sp.encode(t) and got[1], (kind, fallback, alphabet, t)


def test_refused_models():
    for data in (by_hand([("a", -1.0)], special=[("[x]", spm.USER_DEFINED)]), by_hand([("a", -1.0)], kind=3)):
        with pytest.raises(NotImplementedError):
            spm.Codec(data)


def test_very_long_texts():
    data = open(spm.default_model(), "rb").read()
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Codec(data)
    for t in ("word and line\n" * 60_000, "x" * 20_000, " " * 5_000 + "é" * 5_000):
        got = codec.encode([t])[0]
        assert got[0].tolist() == sp.encode(t) and codec.decode(got[0]) == t


def test_unigram_scores_are_rebuilt():
    """A unigram model made by hand in the file format: pieces with scores, no training."""
    r = random.Random(2)
    words = ["▁"] + list("abcd") + ["ab", "bc", "▁a", "▁ab", "cd", "abc", "▁bcd", "dd"]
    data = by_hand([(w, -1.0 - r.random() * 8) for w in words])
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Codec(data)
    for _ in range(200):
        t = "".join(r.choice("abcd  é\n") for _ in range(r.randint(0, 30)))
        got = codec.encode([t])[0]
        assert got[0].tolist() == sp.encode(t) and got[1], repr(t)
