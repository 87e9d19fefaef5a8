import random

from tesserae.llm import toxicity


def make(n, seed):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 300))]
        bad = r.random() < 0.2
        for _ in range(r.randint(2, 12) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["Scum", "vile,", "pathetic."])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_order(spark):
    docs, labels = make(900, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = toxicity.fit(df, spark.createDataFrame(labels[:600] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int"))
    out = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    truth = dict(labels)
    assert sum(out[i].toxic == bool(truth[i]) for i in range(600, 900)) >= 297
    assert model.thresholds[0] < model.thresholds[1] and {x.grade for x in out.values()} == {0, 1, 2}
    assert all(0 <= x.severity <= 2 for x in out.values())
    toxic = sorted((x for x in out.values() if x.toxic), key=lambda x: x.severity)
    assert [x.grade for x in toxic] == sorted(x.grade for x in toxic)
    again = toxicity.fit(df.repartition(5), spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    assert abs(again.thresholds - model.thresholds).max() < 1e-9


def test_nulls_empty_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "x " * 50_000, 0), (2, "x", 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(df, model).collect()
    assert len(out) == 4 and all(not x.toxic and x.severity < 0.01 for x in out)
    assert toxicity.score(df.limit(0), model).collect() == []


def test_scores_against_plain_arithmetic(spark):
    """Severity of every document from the model's words, weights and thresholds, one word at a time."""
    import math

    import xxhash

    docs, labels = make(300, 2)
    df = spark.createDataFrame([*docs, (900, "Vile! (VILE) scum", ), (901, None), (902, "§ ... ,")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    at = {int(w): i for i, w in enumerate(model.words)}
    assert at
    for x in toxicity.score(df, model).collect():
        words = [w.strip(toxicity.EDGES).lower() for w in ({**dict(docs), 900: "Vile! (VILE) scum", 902: "§ ... ,"}.get(x.doc_id) or "").split()]
        words = [w for w in words if w]
        s = 0.0
        for w in set(words):
            i = at.get(xxhash.xxh3_64_intdigest(w.encode()))
            if i is not None:
                s += model.weights[i] + model.weights[len(at) + i] * math.log1p(1000 * words.count(w) / len(words)) / 3
        p = [1 / (1 + math.exp(max(-40, min(40, t - s)))) for t in model.thresholds]
        assert abs(x.severity - sum(p)) < 1e-9 and x.toxic == (p[0] >= 0.5) and x.grade == sum(q >= 0.5 for q in p)


def test_severity_follows_planted_degrees(spark):
    r = random.Random(4)
    vocab, bad = [f"word{i}" for i in range(400)], ["scum", "vile", "pathetic", "filth", "vermin"]
    docs, labels, degree = [], [], {}
    for i in range(800):
        degree[i] = r.choice([0, 0, 0, 1, 2])
        w = [r.choice(vocab) for _ in range(120)]
        for _ in range((0, 3, 30)[degree[i]]):
            w[r.randrange(len(w))] = r.choice(bad)
        docs.append((i, " ".join(w), "x", 1.0))
        labels.append((i, int(degree[i] > 0), 0))
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, toxic string, severity double")
    model = toxicity.fit(df, spark.createDataFrame(labels[:600], "doc_id long, toxic int, text int"))
    out = {}
    for x in toxicity.score(df, model).collect():
        if x.doc_id >= 600:
            out.setdefault(degree[x.doc_id], []).append(x.severity)
    mean = {k: sum(v) / len(v) for k, v in out.items()}
    assert mean[0] < 0.1 < mean[1] < mean[2] and sum(s > max(out[0]) for s in out[2]) >= 0.95 * len(out[2])
