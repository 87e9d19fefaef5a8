import collections
import math
import random
import re

import numpy as np

from tesserae.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    cov = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(cov)}


def test_counts():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab #é\x0b\n\x1c*𝒳 ") for _ in range(r.randint(0, 120)))
        assert quality.counts(t) == brute(t), repr(t)
    assert quality.counts("a a a a")["n_repeat_words"] == 4


def brute_log_ppl(texts, order=quality.ORDER):
    """Log perplexities a word by an interpolated modified Kneser-Ney model of its own, in dictionaries."""
    pad = "\0" * (order - 1)
    cut = lambda t: [(pad + t)[i : i + order] for i in range(len(t))]
    levels = {order: collections.Counter(g for t in texts for g in cut(t))}
    for m in range(order - 1, 0, -1):
        levels[m] = collections.Counter(g[1:] for g in levels[m + 1])

    def discount(m, c):
        n = collections.Counter(levels[m].values())
        k = min(c, 3)
        if not all(n[i] for i in (1, 2, 3, 4)):
            return (0.5, 0.75, 0.9)[k - 1]
        y = n[1] / (n[1] + 2 * n[2])
        return min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), (0.95, 1.9, 2.9)[k - 1])

    cuts = {(m, c): discount(m, c) for m in levels for c in set(levels[m].values())}
    total, spare = collections.Counter(), collections.Counter()
    for m in levels:
        for g, c in levels[m].items():
            total[m, g[:-1]] += c
            spare[m, g[:-1]] += cuts[m, c]

    def p(g):
        m = len(g)
        below = p(g[1:]) if m > 1 else 1 / (len(levels[1]) + 1)
        c = levels[m][g]
        return (c - cuts[m, c] + spare[m, g[:-1]] * below) / total[m, g[:-1]]

    def without_one(g):
        m, c = len(g), levels[len(g)][g]
        below = 1 / (len(levels[1]) + 1) if m == 1 else without_one(g[1:]) if c == 1 else p(g[1:])
        if total[m, g[:-1]] == 1:
            return below
        less = cuts[m, c - 1] if (m, c - 1) in cuts else discount(m, c - 1) if c > 1 else 0
        return (c - 1 - less + (spare[m, g[:-1]] - cuts[m, c] + less) * below) / (total[m, g[:-1]] - 1)

    known = {g: math.log(max(without_one(g), quality.FLOOR)) for g in levels[order]}
    return [-sum(known[g] for g in cut(t)) / len(WORD.findall(t)) if WORD.search(t) else None for t in texts]


def test_hashes_are_found_and_pieces_make_no_difference(monkeypatch):
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    t = quality.Table(h[::2], np.arange(len(h[::2]), dtype=np.float32) + 1)
    assert (t.of(h[::2]) == np.arange(len(h[::2])) + 1).all() and not t.of(h[1::2]).any()
    text = "".join(chr(c) for c in r.integers(32, 9000, 3000)) + "𝒳𝒴"  # more characters than a packed gram holds
    want = collections.Counter(("\0" * 4 + text)[i : i + 5] for i in range(len(text)))
    for piece in (7, 1 << 20):
        monkeypatch.setattr(quality, "PIECE", piece)
        for some in (text, text[:50]):
            g, hashes, n = quality.distinct_grams(list(quality.parts(some)))
            assert dict(zip(g, n.tolist())) == (want if some is text else collections.Counter(("\0" * 4 + some)[i : i + 5] for i in range(50)))
            known = quality.Table(hashes, np.ones(len(g), np.float32))
            assert quality.log_sums([some, "", some], ["en"] * 3, {"en": known}).tolist() == [len(some), 0, len(some)]


def test_rejects_other_text_and_keeps_prose(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["ba", "ne", "ti", "sor", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(60, 300))), "en") for i in range(120)]
    docs += [(500, " ".join("".join(r.choice("xqzjk#%7") for _ in range(5)) for _ in range(100)), "en"), (501, None, "en"), (502, "", None), (503, "too short", "en"), (504, "a b c " * 100, "en"), (505, " ".join(words[:60]), None), (0, "bad", "en")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, kept int").repartition(3)
    out = {(x.doc_id, x.n_words): x for x in quality.scored(df).collect()}
    assert len(out) == len(docs)
    for i, t, _ in docs:
        x = out[i, len(WORD.findall(t or ""))]
        assert all(x[k] == v for k, v in brute(t or "").items())
    assert {x.doc_id for x in out.values() if not x.kept} == {500, 501, 502, 503, 504, 0}
    kept = quality.keep_good(df).collect()
    assert {x.doc_id for x in kept} == set(range(120)) | {505} and len(kept) == 121 and kept[0].kept == 1


def test_bands_reject_ordinary_words_with_symbols_between(spark):
    r = random.Random(6)
    words = ["".join(r.choice(["ba", "ne", "ti", "sor", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n, gap="": " ".join(r.choice(words) + gap * (k % 6 == 0) for k in range(n))
    docs = [(i, text(r.randint(60, 600)), "en") for i in range(200)] + [(1000 + i, text(r.randint(200, 300), gap), "en") for i, gap in enumerate([" |", "###"] * 3)]
    kept = {x.doc_id for x in quality.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert max(kept) < 1000 and len(kept) >= 196


def test_a_rare_language_has_a_band(spark):
    r = random.Random(8)
    words = ["".join(r.choice(["ba", "ne", "ti", "sor", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    junk = " ".join("".join(r.choice("xqzjk#%7") for _ in range(5)) for _ in range(100))
    docs = [(i, text(200), "en") for i in range(60)] + [(100 + i, text(200), "rare") for i in range(10)] + [(200, junk, "rare"), (300, text(60), "lone")]
    kept = {x.doc_id for x in quality.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert 200 not in kept and 300 in kept and kept >= set(range(100, 110))


def test_every_gram_counts_however_small_the_shards(spark, monkeypatch):
    r = random.Random(7)
    docs = [(i // 2, "".join(r.choice("abcdefgh 漢字é𝒳") for _ in range(r.randint(1, 400))), r.choice(["en", "zh", None])) for i in range(60)] + [(None, "a text", "en")] * 2 + [(99, "", "en")]
    monkeypatch.setattr(quality, "SHARD", 700)
    want = []
    for lang in ("en", "zh", None):
        mine = [(i, t) for i, t, x in docs if x == lang and t]
        want += [(i or -1, p) for (i, _), p in zip(mine, brute_log_ppl([t for _, t in mine])) if p is not None]
    got = [(x.doc_id or -1, x.log_ppl) for x in quality.scored(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect() if x.log_ppl is not None]
    assert [x[0] for x in sorted(got)] == [x[0] for x in sorted(want)]
    assert np.allclose([x[1] for x in sorted(got)], [x[1] for x in sorted(want)], atol=1e-5)


def test_empty(spark):
    assert quality.scored(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
