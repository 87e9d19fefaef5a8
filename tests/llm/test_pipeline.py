import random

import sentencepiece

import corpus_pipeline
import test_jaccard
import test_lines
from tesserae.llm import lines, mixing, quality, spm


def corpus():
    r = random.Random(11)
    words = ["".join(r.choice(["ba", "ne", "ti", "sor", "lu", "am"]) for _ in range(r.randint(1, 4))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    boiler = line(12)
    docs = []
    for i in range(70):
        docs.append((i, "\n".join(line(r.randint(20, 40)) for _ in range(r.randint(3, 6))) + ("\n" + boiler if i % 2 else ""), "en", r.choice(["a", "b", "c"])))
    for i in range(70, 80):
        w = docs[i - 70][1].split(" ")
        for _ in range(8):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w), "en", "a"))
    docs += [(80, docs[3][1], "en", "b"), (81, "too short", "en", "b"), (82, None, "en", None), (83, "x y " * 100, "en", "c")]
    return [(i, t, s, lang, len(t or "")) for i, t, lang, s in docs]


def test_stages_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    steps = [df]
    for _, f in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(f(spark, steps[-1], ""), "test"))
    rows = [[tuple(x) for x in s.collect()] for s in steps]
    assert all(s.columns == df.columns for s in steps[1:-1])
    bad = {i for i, t, *_ in docs if (c := quality.counts(t or ""))["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]}
    assert bad == {81, 82, 83} and sorted(rows[1]) == sorted(d for d in docs if d[0] not in bad)
    gone = {i: g for i, _, _, _, g in test_lines.brute([r[:2] for r in rows[1]], lines.TAU, lines.MIN_CHARS)}
    left = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), s, lang) for i, t, s, lang, _ in rows[1]]
    assert sorted(rows[2]) == sorted((*x, len(x[1])) for x in left if x[1].strip()) and 80 not in {x[0] for x in rows[2]}
    keep = {i for i, _, c in test_jaccard.brute([r[:2] for r in rows[2]], 5, 80, 100) if i == c}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] in keep)
    size = {}
    for r in rows[3]:
        size[r[2]] = size.get(r[2], 0) + len(r[1].split())
    order = sorted(size)
    targets = mixing.water_fill([size[s] for s in order], [3, 1, 2][: len(order)], 1.5 * sum(size.values()), 2)
    for s, t in zip(order, targets, strict=True):
        assert abs(sum(len(r[1].split()) for r in rows[4] if r[2] == s) - t) <= 250
    assert set(rows[4]) <= set(rows[3])
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    assert sorted((r[0], tuple(r[2])) for r in rows[5]) == sorted((r[0], tuple(sp.encode(r[1]))) for r in rows[4])


def run_stages(spark, df):
    for name, f in corpus_pipeline.STAGES:
        before, df = df.columns, corpus_pipeline.materialize(f(spark, df, ""), "test")
        assert name == "SentencePiece" or df.columns == before
    return df


def test_empty_table(spark):
    assert run_stages(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []


def test_nulls_repeats_clashing_names_and_long_texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice(["ba", "ne", "ti", "sor", "lu", "am"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randint(80, 200)), "en", r.choice(["a", "b"])) for i in range(60)]
    docs += [(None, text(150), "en", "a"), (None, text(150), None, None), (70, None, None, None), (71, "", "en", "b"), (5, text(120), "en", "a"), docs[7], docs[7], (80, "\n".join(text(30) for _ in range(3_000)), "en", "b"), (81, text(60_000), "en", "a")]
    names = "doc_id long, text string, lang string, source string, _id string, _n int, _same string, _gone int, _dropped int, copies int, _row string, _d int, log_ppl int, n int, fp string"
    df = spark.createDataFrame([(*d, "x", 1, "y", 2, 3, 4, "z", 5, 6, 7, "w") for d in docs], names).repartition(3)
    out = run_stages(spark, df).collect()
    ids = {x.doc_id for x in out}
    assert ids <= {d[0] for d in docs} and not ids & {70, 71} and {None, 80, 81} <= ids
    size = {}
    for d in docs:
        if d[1]:
            size[d[3]] = size.get(d[3], 0) + len(d[1].split())
    assert all(x.n_tokens == len(x.ids) > 50 for x in out)
