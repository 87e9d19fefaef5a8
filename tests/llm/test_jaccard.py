import random
import re

from tesserae.llm import jaccard
from tesserae.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k, num, den):
    def sh(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, sh(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(40)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.5:
            w = (r.choice(docs)[1] or "").split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 20, 60, 200]))]
            if r.random() < 0.4:
                w = w + passage
        docs.append((i, r.choice([" ", "  ", "\n"]).join(w).upper() if r.random() < 0.1 else " ".join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a b c\x1cd É é"), (n + 4, "A B c\x1cd É É")]
    return docs


def run(spark, docs, k, num, den):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {tuple(r) for r in jaccard.jaccard_components(df, k, num, den).collect()}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    for seed, k, num, den in ((1, 3, 90, 100), (2, 5, 80, 100)):
        docs = corpus(seed)
        assert run(spark, docs, k, num, den) == brute(docs, k, num, den)


def test_thresholds_and_split_tokens(spark, monkeypatch):
    """Low thresholds, where one shared token can do; and tokens so common that their queries are dealt over tasks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "QUERIES", 3)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "SPLIT", 4)
    monkeypatch.setattr(jaccard, "NARROW", 30)
    tiny = [(200, "a"), (201, "a b"), (202, "b c d"), (203, "zz"), (204, "zz yy"), (205, "zz yy xx ww")]
    for seed, k, num in ((3, 1, 50), (4, 2, 30), (5, 1, 70)):
        docs = corpus(seed, 60) + tiny
        assert run(spark, docs, k, num, 100) == brute(docs, k, num, 100), (k, num)
    for num in (0, 101):
        try:
            run(spark, [], 3, num, 100)
        except ValueError:
            continue
        raise AssertionError(num)


def test_narrow_unions_bound_the_overlap(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "NARROW", 40)
    g = np.random.default_rng(1)
    for _ in range(200):
        sets = [np.unique(g.integers(0, 1 << 63, g.integers(1, 80), dtype=np.uint64)) for _ in range(g.integers(1, 5))]
        q = np.unique(np.concatenate([g.choice(sets[0], len(sets[0]) // 2 + 1), g.integers(0, 1 << 63, g.integers(1, 60), dtype=np.uint64)]))
        union, wide = jaccard.union_of([jaccard.narrow(s) for s in sets], [len(s) for s in sets])
        assert jaccard.met_in(union, wide, jaccard.narrow(q), len(q)) >= max(len(np.intersect1d(q, s)) for s in sets)


def test_repeated_ids_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, long), (2, long + " end"), (3, "a b c d e f"), (3, "p q r s t u"), (4, "p q r s t u"), (5, "a b c d e f"), (6, "n o m l k j"), (7, long[: len(long) // 2])]
    got = run(spark, docs, 3, 90, 100)
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7)}


def test_empty_null_ids_and_extra_columns(spark):
    assert run(spark, [], 3, 90, 100) == set()
    df = spark.createDataFrame([(None, "a b c d", 1), (1, "a b c d", 2), (2, "a b c d", 3)], "doc_id long, text string, n int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(None, 2, None), (1, 2, 1), (2, 2, 1)}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
