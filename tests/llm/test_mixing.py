import random

from tesserae.llm import mixing


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2], 300, 2) == [150, 50, 100]
    got = mixing.water_fill([10, 100, 100], [3, 1, 2], 315, 2)
    assert got[0] == 20 and abs(got[1] - 295 / 3) < 1e-9 and abs(sum(got) - 315) < 1e-9
    assert mixing.water_fill([0, 0], [3, 1], 0, 2) == [0, 0] and mixing.water_fill([], [], 0, 2) == []


def test_targets_are_met(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["a", "b", "b", "b", "é", "z", None]), " ".join("w" for _ in range(r.choice([1, 5, 40, 200])))) for i in range(400)]
    docs += [(400, "a", None), (401, None, ""), (402, "void", " \n"), (3, "a", "one two"), (3, "a", "one two")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    out = mixing.mixed(df).collect()
    assert len(out) == len(docs) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixed(df.repartition(3)).collect()), key=str)
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    for s, t in zip(order, targets, strict=True):
        mine = [x for x in out if x.source == s]
        assert {x.source_size for x in mine} == {sizes[s]} and all(abs(x.target - t) < 1e-6 for x in mine)
        assert abs(sum(x.size * x.copies for x in mine) - t) <= 101 and all(0 <= x.copies <= 2 for x in mine)


def test_empty(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, source string, text string, size int")).collect() == []


def test_targets_of_many_sources_match_water_fill(spark):
    r = random.Random(9)
    for sizes in ([r.randint(0, 50) for _ in range(60)], [0, 0, 7], [5]):
        names = sorted([f"s{i:02d}é" if i % 7 == 0 else f"s{i:02d}" for i in range(len(sizes) - 1)]) + [None]
        df = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes)], "source string, s long, documents long")
        want = mixing.water_fill([float(s) for s in sizes], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2.0)
        got = {x.source: x.target for x in mixing.with_targets(df, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_EPOCHS).collect()}
        assert all(abs(got[n] - t) < 1e-6 for n, t in zip(names, want, strict=True)), (sizes, got, want)


def test_equal_rows_at_the_edge(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    ten = "w " * 10
    for n in (2, 3, 8):
        df = spark.createDataFrame([(7, "a", ten, i, "r") for i in range(n)], "doc_id long, source string, text string, _id int, _row string").repartition(3)
        out = mixing.mixed(df).collect()
        assert len(out) == n and abs(sum(x.copies for x in out) * 10 - 15 * n) <= 5 and all(0 <= x.copies <= 2 for x in out)
        rows = mixing.mix(df)
        assert rows.columns == df.columns
        got = [x._id for x in rows.collect()]
        assert abs(len(got) * 10 - 15 * n) <= 5 and set(got) == set(range(n)) and max(map(got.count, got)) <= 2


def test_mix_takes_rows_as_planned(spark):
    r = random.Random(12)
    docs = [(r.choice([None, 1, 2, i]), r.choice(["a", "b", None]), r.choice([None, "", "x y", "w " * r.randint(1, 30)])) for i in range(300)]
    docs.append((900, "a", "long " * 300_000))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    plan = {}
    for x in mixing.mixed(df).collect():
        plan[x.doc_id, x.source, x.size] = plan.get((x.doc_id, x.source, x.size), 0) + x.copies
    got = {}
    for x in mixing.mix(df).collect():
        k = (x.doc_id, x.source, len((x.text or "").split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}
