import math
import random

from tesserae.llm import metric_join


def brute(rows, c):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))

    n = len(rows)
    link = [[j for j in range(n) if j != i and ok(rows[i][1]) and ok(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= c] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(n)]
    return sorted((r[0], len(link[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows))


def small_blocks(monkeypatch):
    monkeypatch.setattr(metric_join, "CHUNK_FLOATS", 1)
    monkeypatch.setattr(metric_join, "LEAST_CHUNK", 16)
    monkeypatch.setattr(metric_join, "PLACE_COST", 1)


def test_matches_brute_force(spark, monkeypatch):
    small_blocks(monkeypatch)
    r = random.Random(3)
    rows = []
    for i in range(200):
        if rows and r.random() < 0.6:
            v = list(r.choice(rows)[1])
            if r.random() < 0.7:
                v = [x + r.gauss(0, 0.1) for x in v]
        else:
            v = [r.gauss(0, 1) for _ in range(r.choice([8, 8, 8, 3]))]
        rows.append((i, v))
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, []), (206, [-x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, metric_join.near_vectors(df).collect())) == brute(rows, 0.95)


def test_empty_and_null_ids(spark):
    assert metric_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0], "x"), (7, [1.0, 0.0], "y"), (3, [1.0, 0.01], "z"), (None, [0.0, 1.0], "w")], "vec_id long, embedding array<float>, v string")
    got = sorted(map(tuple, metric_join.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, None, False), (7, 2, 3, False), (3, 2, 3, True), (None, 0, None, False)], key=str)


def test_dense_group_and_clustered_vectors(spark, monkeypatch):
    """Half of the rows are one ball; the others lie on few dimensions, where plain pivots part them."""
    small_blocks(monkeypatch)
    r = random.Random(5)
    base = [r.gauss(0, 1) for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.12) for x in base]) for i in range(150)]
    rows += [(150 + i, [r.gauss(0, 1) * (k < 3) for k in range(6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute([(i, v) for i, v in df.collect()], 0.95)
    assert sorted(map(tuple, metric_join.near_vectors(df).collect())) == want
    assert max(w[1] for w in want) > 50


def test_plain_pivots_part_clustered_vectors():
    import numpy as np

    g = np.random.default_rng(1)
    centres = g.normal(size=(16, 32))
    x = np.repeat(centres, 200, axis=0) + 0.6 * g.normal(size=(3200, 32))
    g.shuffle(x)
    cells = metric_join.Cells(x, 1_000_000, 0.316)
    own, _, copy = cells.place(metric_join.unit(x))
    assert len(cells.pivots) - cells.balls > 1 and copy.sum() < 3200 * 4 and len(np.unique(own)) > 4


def test_components_of_any_size(spark):
    big = [1e200, 0.0, 1e200], [1e200, 1e190, 1e200], [1e-200, 0.0, 1.1e-200], [0.0, 1e300, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, metric_join.near_vectors(df).collect())) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]
