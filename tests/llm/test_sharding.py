import itertools
import random
import zlib

from tesserae.llm import sharding


def test_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2)):
        cells = sorted(itertools.product(range(1 << bits), repeat=n), key=lambda c: sharding.hilbert(c, bits))
        assert [sharding.hilbert(c, bits) for c in cells] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in itertools.pairwise(cells))


def test_shards(spark):
    r = random.Random(2)
    texts = [r.choice("abcé") * r.randint(0, 400) + str(r.randrange(150)) for _ in range(700)] + ["hot " * 30] * 400 + [None, ""]
    docs = [(i, t, r.choice(["en", "de", None]), f"src{r.randrange(5)}", 1) for i, t in enumerate(texts)] + [(5, "again", "en", "src0", 1)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, copies int").repartition(3)
    out = sharding.shard_documents(df).collect()
    sizes = sorted((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted((x.doc_id, x.size, x.text_crc32) for x in out) == sizes
    total = sum(s for _, s, _ in sizes)
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x)
    assert set(by) == set(range(16)) and {x.law for x in out} == {"bytes"} and {x.grown_shard for x in out} == {None}
    for rows in by.values():
        assert sorted(x.slot for x in rows) == list(range(len(rows)))
        assert abs(sum(x.size for x in rows) - total / 16) <= total / 16 / 50 + 900
    order = [x.curve for x in sorted(out, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, sharding.shard_documents(df.repartition(2)).collect()), key=str)


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_values_of_a_common_start_are_told_apart(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", f"https://site/{i % 20:02d}") for i in range(400)] + [(400, "none", None, None)], "doc_id long, text string, lang string, source string")
    got = {x.source: x.level for x in sharding.levels(df.select("source"), "source", 16).collect()}
    assert got == {f"https://site/{i:02d}": i * 16 // 20 for i in range(20)}
    out = {x.doc_id: x for x in sharding.shard_documents(df).collect()}
    by_curve = {}
    for i, x in out.items():
        by_curve.setdefault(x.curve, set()).add(i % 20)
    assert len(out) == 401 and len(by_curve) > 16 and max(map(len, by_curve.values())) <= 3


def test_very_long_texts(spark):
    docs = [(i, "x" * 10, "en", "a") for i in range(50)] + [(50, "long " * 500_000, "en", "b"), (51, "long " * 500_000, "de", "b")]
    out = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((x.doc_id, x.size) for x in out) == [(i, 11) for i in range(50)] + [(50, 2_500_001), (51, 2_500_001)]
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_brute_force(spark):
    """Every shard, slot and place of the query against one process: groups in the order of the curve, cut by running size."""
    r = random.Random(4)
    docs = [(i, "w" * r.randint(0, 90) + str(r.randrange(60)), r.choice(["en", "de", "fr", None]), f"s{r.randrange(9)}") for i in range(500)]
    out = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    total, at = sum(x.size for x in out), 0
    tolerance = total // 16 // sharding.TOLERANCE
    text = {d[0]: d[1] for d in docs}
    place = {}
    groups = {}
    for x in out:
        groups.setdefault(text[x.doc_id], []).append(x)
    for x in sorted(out, key=lambda x: (x.shard, x.slot)):
        g = groups[text[x.doc_id]]
        whole = sum(y.size for y in g) <= tolerance
        start = place.setdefault(text[x.doc_id], at) if whole else at
        assert x.shard == min(15, start * 16 // total)
        at += x.size
    assert all(len({x.curve for x in g}) == 1 for g in groups.values())
