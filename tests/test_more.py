"""Operators against brute force and by their rules."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae import model
from tesserae.model import FOREVER, TimeSlice
from tesserae.operators import access, algorithms, contests, embed, hybrid, ingest, judge, pattern, scan, temporal, text, traverse, vector, write
from tesserae.sources import snapshots
from tesserae.streaming import feed

NODE, EDGE = model.NODE_SCHEMA, model.EDGE_SCHEMA


def node(id, type="thing", data="{}", vf=0, vt=FOREVER, rf=0, rt=FOREVER, ver=None, body=None, uri=None, hash=None):
    return (ver, id, type, body, uri, hash, None, data, vf, vt, rf, rt)


def edge(id, src, dst, rel="link", weight=1.0, data="{}", vf=0, vt=FOREVER, rf=0, rt=FOREVER, ver=None, source=None):
    return (ver, id, src, dst, rel, weight, data, source, vf, vt, rf, rt)


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# limits, pages, metrics


def test_limits_are_checked():
    for bad in ({"max_rows": 0}, {"max_rows": 1.5}, {"max_fanout": True}, {"timeout_ms": 0}, {"timeout_ms": float("nan")}):
        with pytest.raises(ValueError):
            scan.Limits(**bad)
    assert scan.Limits(timeout_ms=float("inf")).timeout_ms == float("inf")


def test_row_values_page_like_tuples(spark):
    r = random.Random(1)
    pairs = [(r.choice("abc"), r.choice("xyz")) for _ in range(40)]
    df = spark.createDataFrame(pairs, "k string, v string").distinct()
    got, cursor = [], None
    while True:
        page = scan.page(df, ["k", "v"], 2, cursor).collect()
        got += [tuple(x) for x in page]
        cursor = scan.next_cursor(page, ["k", "v"], 2)
        if cursor is None:
            break
    assert got == sorted(set(pairs))


def test_a_query_is_cancelled_at_its_limit(spark):
    slow = spark.range(0, 20_000_000_000, 1, 8).select(F.sum(F.sin("id") * F.cos("id")))
    with pytest.raises(scan.QueryTimeout):
        scan.with_timeout(spark, scan.Limits(timeout_ms=1500), slow.collect)
    assert scan.with_timeout(spark, scan.Limits(timeout_ms=60_000), spark.range(3).count) == 3


def test_queries_are_measured(spark):
    told = []
    assert len(scan.measured(spark.range(5), "five", lambda *x: told.append(x), scan.Limits(timeout_ms=0.5 * 3_600_000))) == 5
    assert {t[:2] for t in told} == {("histogram", "five.ms"), ("gauge", "five.rows"), ("counter", "five.calls")} and ("gauge", "five.rows", 5) in told


def test_labels_and_images(spark):
    data = ['{"name":7,"title":" T "}', '{"name":"","slug":"s"}', '{"label":{"a":1}}', "no json", None, '{"heading":"' + "x" * 100 + '"}', '{"image":"ftp://x","icon":"HTTPS://y"}', '{"photo":"http://' + "x" * 600 + '"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data string")
    got = [tuple(x)[1:] for x in df.select("i", scan.label(F.col("data")), scan.image(F.col("data"))).orderBy("i").collect()]
    assert [g[0] for g in got] == ["T", "s", None, None, None, "x" * 80, None, None] and [g[1] for g in got] == [None] * 6 + ["HTTPS://y", None]


def test_live_views(spark):
    n, e = graph(spark, [node("a"), node("b", vt=5), node("c", rt=9)], [edge("e", "a", "b"), edge("f", "a", "b", vt=1)])
    model.register_views(n, e)
    assert [r.id for r in spark.sql("SELECT id FROM nodes").collect()] == ["a"] and spark.sql("SELECT * FROM edges").count() == 1


# patterns and traversals


def test_specs_are_checked(spark):
    n, e = graph(spark, [node("a"), node("b", data='{"x.y":"1","q\\"r":true}')], [edge("e", "a", "b")])
    good = {"steps": [{"node": "x"}, {"rel": "link"}, {"node": "y"}], "where": [{"alias": "y", "key": "x.y", "value": 1}]}
    assert rows(pattern.match_from_spec(n, e, good), "x", "y") == [("a", "b")]
    for bad in ({}, {"steps": [{"node": "x"}, {"rel": "link"}]}, {"steps": [{"node": "x"}, {"hop": 1}, {"node": "y"}]}, {**good, "where": [{"alias": "z", "key": "k", "value": 1}]}, {**good, "more": 1}, {"steps": [{"node": "x"}, {"rel": "r", "direction": "up"}, {"node": "y"}]}, {**good, "asOf": 1.5}):
        with pytest.raises(pattern.BadSpec):
            pattern.match_from_spec(n, e, bad).collect()


def test_rows_hold_the_nodes_of_the_slice(spark):
    n, e = graph(spark, [node("a", data='{"v":1}', vt=10), node("a", data='{"v":2}', vf=10), node("b")], [edge("e", "a", "b")])
    got = pattern.Pattern(n, e, TimeSlice(5)).node("x").out("link").node("y").rows().collect()
    assert [(r.x.id, r.x.data, r.y.id) for r in got] == [("a", '{"v":1}', "b")]
    got = pattern.Pattern(n, e).node("x").out("link").node("y").rows().collect()
    assert [(r.x.data, r.y.id) for r in got] == [('{"v":2}', "b")]


def test_supernodes_are_reached_but_not_passed(spark):
    adj = spark.createDataFrame([("s", "h"), *[("h", f"x{i}") for i in range(5)], ("s", "y"), ("y", "z")], "a string, b string")
    seeds = spark.createDataFrame([("s",)], "id string")
    assert rows(traverse.walk(seeds, adj, 3, 4), "id", "depth") == [("h", 1), ("s", 0), ("y", 1), ("z", 2)]
    e = spark.createDataFrame([("s", "h", 0, FOREVER), *[("h", f"x{i}", 0, FOREVER) for i in range(3)], ("s", "k", 0, FOREVER), *[("k", f"w{i}", 0, 100) for i in range(3)]], "src string, dst string, valid_from long, valid_to long")
    got = dict(rows(traverse.journey("s", 5, e, 3, max_fanout=2), "id", "arrival"))
    assert set(got) == {"h", "k", "w0", "w1", "w2"}  # edges that have ended do not make a supernode


def test_order_by_the_seed_that_reached(spark):
    found = spark.createDataFrame([("a", 0, "a"), ("b", 0, "b"), ("x", 1, "a"), ("c", 1, "b")], "id string, depth int, seed string")
    seeds = spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int")
    assert [r.id for r in traverse.by_rank(found, seeds).collect()] == ["b", "a", "c", "x"]


# algorithms


def test_scope(spark):
    n, e = graph(spark, [node("a", "t"), node("b", "t"), node("c", "u"), node("d", "t", vt=9)], [edge("1", "a", "b"), edge("2", "a", "c"), edge("3", "a", "d"), edge("4", "b", "a", "other"), edge("5", "b", "a", vt=3)])
    ids, es = algorithms.scoped(n, e, ("link",), ("t",))
    assert rows(ids, "id") == [("a",), ("b",)] and rows(es, "src", "dst") == [("a", "b")]
    assert rows(algorithms.scoped(n, e, types=("t",), when=TimeSlice(1))[1], "src", "dst") == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "a")]


def test_betweenness_by_joins_and_by_sources(spark):
    r = random.Random(2)
    for n in (1, 2, 9):
        names = [f"v{i}" for i in range(n)]
        es = [(r.choice(names), r.choice(names), 1.0) for _ in range(3 * n)]
        ids = spark.createDataFrame([(x,) for x in names], "id string")
        e = spark.createDataFrame(es, "src string, dst string, weight double").filter("src <> dst")
        a = {x.id: x.score for x in algorithms.betweenness(ids, e).collect()}
        b = {x.id: x.score for x in algorithms.betweenness_hops(ids, e).collect()}
        assert set(a) == set(b) == set(names) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    some = algorithms.betweenness(ids, e, samples=4, seed=3)
    by_hand = algorithms.betweenness_hops(ids, e, spark.createDataFrame([(names[i],) for i in algorithms.sampled_sources(9, 4, 3)], "id string"))
    assert all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(rows(some, "id", "score"), rows(by_hand, "id", "score"), strict=True))


def test_seeded_sources():
    assert algorithms.sampled_sources(5, None) == [0, 1, 2, 3, 4] == algorithms.sampled_sources(5, 9)
    a = algorithms.sampled_sources(1000, 50, 7)
    assert a == algorithms.sampled_sources(1000, 50, 7) != algorithms.sampled_sources(1000, 50, 8) and len(set(a)) == 50
    stream = algorithms.random_stream(1)
    assert [round(next(stream), 10) for _ in range(3)] == [0.6270739406, 0.0027357212, 0.52744704]  # as published for this generator and seed


def test_scores_are_kept_and_ranked(spark, tmp_path):
    s = algorithms.Scores(spark, str(tmp_path))
    n, _ = graph(spark, [node("a", "t"), node("b", "t"), node("c", "u"), node("d", "t", vt=4)], [edge("e", "a", "b")])
    values = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0), ("d", 99.0)], "id string, v double")
    assert s.keep("score:x.y:z-1", values) and not s.keep("score:x.y:z-1", values, TimeSlice(3))
    assert [tuple(r) for r in s.top("score:x.y:z-1", n, 5, "t").collect()] == [("b", "t", 3.0), ("a", "t", 1.0)]
    s.keep("score:x.y:z-1", values.filter("id = 'a'"))
    assert s.get("score:x.y:z-1").count() == 1
    for bad in ("constructor", "score:", "score:a b", "score:" + "x" * 65, "__proto__"):
        with pytest.raises(ValueError):
            s.keep(bad, values)


def test_contests(spark):
    ch = spark.createDataFrame([("belt", "a", 1), ("belt", None, 5), ("cup", "b", 2), ("belt", "c", 8)], "title string, holder string, t long")
    assert rows(contests.holders(ch, 6), "title", "holder", "since") == [("belt", None, 5), ("cup", "b", 2)]
    assert rows(contests.reigns(ch), "title", "holder", "since", "until") == [("belt", "a", 1, 5), ("belt", "c", 8, None), ("belt", None, 5, 8), ("cup", "b", 2, None)]
    with pytest.raises(ValueError):
        contests.leaderboard(spark.createDataFrame([], NODE), "age", ("wins",))


def test_cheapest_routes_against_value_iteration(spark):
    r = random.Random(6)
    for by in ("cost", "steps"):
        ids = [f"m{i}" for i in range(12)]
        price = {x: float(r.randint(1, 20)) for x in ids[:4]}
        rx = {f"r{i}": (r.choice([0.5, 0.8, 1.0]), {x: float(r.randint(1, 3)) for x in r.sample(ids, r.randint(1, 3))}, r.sample(ids, r.randint(1, 2))) for i in range(25)}
        value = {x: (c, 0) for x, c in price.items()}
        key = (lambda v: (round(v[0], 6), v[1])) if by == "cost" else (lambda v: (v[1], round(v[0], 6)))
        changed = True
        while changed:
            changed = False
            for y, ins, outs in rx.values():
                if all(x in value for x in ins):
                    new = (sum(k * value[x][0] for x, k in ins.items()) / y, 1 + max(value[x][1] for x in ins))
                    for o in outs:
                        if o not in value or key(new) < key(value[o]):
                            value[o], changed = new, True
        got = contests.cheapest_routes(
            spark.createDataFrame(list(price.items()) + [("m9", None)], "id string, price double"),
            spark.createDataFrame([(k, v[0]) for k, v in rx.items()], "reaction string, yield double"),
            spark.createDataFrame([(k, x, s) for k, v in rx.items() for x, s in v[1].items()], "reaction string, id string, stoich double"),
            spark.createDataFrame([(k, o) for k, v in rx.items() for o in v[2]], "reaction string, id string"), by)
        got = {x.id: (x.cost, x.steps) for x in got.collect()}
        assert set(got) == set(value) and all(abs(got[k][0] - value[k][0]) < 1e-5 and got[k][1] == value[k][1] for k in value), by


# retrieval


def test_index_is_rebuilt_when_versions_change(spark):
    v = spark.createDataFrame([node("a", ver=1, body="red fox"), node("b", ver=2, body="blue fox fox")], NODE)
    ix = text.TextIndex()
    first = ix.fresh(v)
    assert ix.fresh(v) is first and rows(ix.search(v, "fox +AND red"), "ver") == rows(text.bm25(v, "fox AND red"), "ver")
    a, b = (dict(rows(x, "ver", "score")) for x in (ix.search(v, "fox fox red"), text.bm25(v, "fox fox red")))
    assert all(abs(a[k] - b[k]) < 1e-12 for k in b)
    more = v.unionByName(spark.createDataFrame([node("c", ver=3, body="fox")], NODE))
    assert ix.fresh(more) is not first and ix.search(more, "fox").count() == 3
    assert ix.search(v, " ?! ").count() == 0 == text.bm25(v, "").count()


def corpus(spark):
    n, e = graph(spark, [node(x, ver=i, body=f"word{i} common") for i, x in enumerate("abcdef")] + [node("f", ver=9, vf=0, vt=50, rt=60, body="old")], [edge("1", "a", "b"), edge("2", "c", "d"), edge("3", "d", "e")])
    v = spark.createDataFrame([(x, 0, f"text of {x}", [1.0, i / 10]) for i, x in enumerate("abcdef")], "id string, chunk int, text string, emb array<double>")
    return hybrid.Corpus(n, e, v, "m")


def test_retrieval(spark):
    c = corpus(spark)
    with pytest.raises(hybrid.WrongModel):
        hybrid.retrieve(c, [1.0, 0.0], embedder="other")
    with pytest.raises(hybrid.WrongModel):
        hybrid.retrieve(hybrid.Corpus(c.nodes, c.edges, c.vectors), [1.0, 0.0])
    got = [tuple(r) for r in hybrid.retrieve(c, [1.0, 0.0], 2, 1).select("id", "depth", "seed").collect()]
    assert got == [("a", 0, "a"), ("b", 0, "b")]
    near = vector.vector_seeds(c.vectors, [1.0, 0.0], 2).collect()
    assert [r.snippet for r in near] == ["text of a", "text of b"] and abs(near[0].score - 1) < 1e-12
    near, words = hybrid.seed_lists(c, "word3", [1.0, 0.0], 1)
    fused = {r.id: r for r in hybrid.fuse(near, words, 6).collect()}
    assert fused["d"].via == ["vector", "fts"] and fused["a"].via == ["vector"] and fused["a"].snippet == "text of a"
    rerank = lambda q, found: found.filter("id <> 'a'").select("id", F.ascii("id").cast("double").alias("score"))
    got = [r.id for r in hybrid.hybrid_retrieve(c, "word3", [1.0, 0.0], 3, rerank=rerank).orderBy("place").collect()]
    assert got == sorted(got, reverse=True) and "a" not in got
    chosen = [r.id for r in hybrid.hybrid_retrieve(c, "word3", [1.0, 0.0], 3, mmr_k=2, lam=0.1).orderBy("place").collect()]
    assert len(chosen) == 2 and chosen[0] == "a"


# writes

SCHEMA = write.Schema({"t": ("name",), "u": ()}, {"link": write.Rel(), "one": write.Rel(("t",), ("u",), single=True)}, unique=(("t", "name"),))


def test_refusals(spark):
    n, e = graph(spark, [node("a", "t", '{"name":"x"}'), node("b", "u")], [edge("e", "a", "b", "one", rf=5)])
    new = lambda *r: spark.createDataFrame(r, "id string, type string, data string, valid_from long")
    for bad in (("c", "v", "{}", None), ("c", "t", "{}", None), ("a", "u", "{}", None), ("c", "u", "{}", 200), ("c", "t", '{"name":"x"}', None)):
        with pytest.raises(write.Refused):
            write.add_nodes(n, new(bad), SCHEMA, 100)
    with pytest.raises(write.Refused):
        write.add_nodes(n, new(("c", "u", "{}", 1), ("c", "u", "{}", 2)), SCHEMA, 100)
    out, events = write.add_nodes(n, new(("c", "t", '{"name":"y"}', 7)), SCHEMA, 100)
    assert rows(out.filter("id = 'c'"), "valid_from", "valid_to", "recorded_from") == [(7, FOREVER, 100)] and rows(events, "op", "shape", "ts") == [("node.create", "insert", 7)]
    es = lambda *r: spark.createDataFrame(r, "id string, src string, dst string, rel string")
    for bad in (("f", "b", "a", "one"), ("f", "a", "zz", "one"), ("f", "a", "b", "none")):
        with pytest.raises(write.Refused):
            write.add_edges(e, n, es(bad), SCHEMA, 100)
    with pytest.raises(write.Refused):
        write.bulk_edges(e, es(("f", "a", "b", "one")), SCHEMA, 100)
    with pytest.raises(write.Refused):
        SCHEMA.check_live(n, e.unionByName(e))
    assert write.bulk_edges(e, es(("f", "a", "b", "link")), SCHEMA, 100, n).count() == 2


def test_single_valued_edge_with_a_given_start(spark):
    n, e = graph(spark, [node("a", "t", '{"name":"x"}'), node("b", "u")], [edge("e", "a", "b", "one", vf=10, rf=5)])
    out, events = write.add_edges(e, n, spark.createDataFrame([("f", "a", "b", "one", 50)], "id string, src string, dst string, rel string, valid_from long"), SCHEMA, 100)
    assert rows(out, "id", "valid_from", "valid_to", "recorded_from", "recorded_to") == sorted([("e", 10, FOREVER, 5, 100), ("e", 10, 50, 100, FOREVER), ("f", 50, FOREVER, 100, FOREVER)], key=str)
    assert rows(events, "op", "id", "ts") == [("edge.create", "f", 50), ("edge.supersede", "e", 50)]


def test_updates_and_corrections(spark):
    n, _ = graph(spark, [node("a", "t", '{"name":"x","k":[1,{"z":2}]}', vf=10, rf=10, body="B", uri="u")], [edge("e", "a", "a")])
    new = write.update_nodes(n, spark.createDataFrame([("a", '{"name":null,"more":1.5}')], "id string, data string"), 50)
    got = {tuple(r) for r in new.select("data", "body", "uri", "valid_from", "valid_to", "recorded_from", "recorded_to").collect()}
    old = '{"name":"x","k":[1,{"z":2}]}'
    assert got == {(old, "B", "u", 10, FOREVER, 10, 50), (old, "B", "u", 10, 50, 50, FOREVER), ('{"k":[1,{"z":2}],"name":null,"more":1.5}', "B", "u", 50, FOREVER, 50, FOREVER)}
    with pytest.raises(write.Refused):
        write.update_nodes(n, spark.createDataFrame([("b", "{}")], "id string, data string"), 50)
    # what holds at the start of the interval is corrected, not what holds now
    two = spark.createDataFrame([node("a", data='{"v":1}', vf=0, vt=10), node("a", data='{"v":2}', vf=10)], NODE)
    patch = lambda f, t: spark.createDataFrame([("a", f, t, '{"c":1}')], "id string, `from` long, `to` long, data string")
    fixed = write.correct(two, patch(5, 20), 100).filter(F.col("recorded_to") == FOREVER)
    assert rows(fixed, "data", "valid_from", "valid_to") == sorted([('{"v":1}', 0, 5), ('{"v":1,"c":1}', 5, 20), ('{"v":2}', 20, FOREVER)], key=str)
    with pytest.raises(write.Refused):
        write.correct(two.filter("valid_from = 0"), patch(50, 60), 100)


def test_bulk_load_against_instants(spark):
    r = random.Random(9)
    for _ in range(4):
        stored, load = [], []
        for i in "ab":
            cuts = sorted(r.sample(range(1, 40), 4))
            stored += [node(i, data=f'"s{k}"', vf=a, vt=b, ver=len(stored) + 1 + k * 100) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cuts = sorted(r.sample(range(1, 40), 4))
            load += [(i, "t", f'"l{k}"', a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
        v = spark.createDataFrame(stored, NODE)
        new = spark.createDataFrame(load, "id string, type string, data string, valid_from long, valid_to long")
        out = write.bulk_load(v, new, 100, "correct").filter(F.col("recorded_to") == FOREVER).collect()
        for i in "ab":
            for t in range(0, 42):
                want = next((x[2] for x in load if x[0] == i and x[3] <= t < x[4]), None) or next((s[7] for s in stored if s[1] == i and s[8] <= t < s[9]), None)
                assert [x.data for x in out if x.id == i and x.valid_from <= t < x.valid_to] == ([want] if want else [])
    with pytest.raises(write.Refused):
        write.bulk_load(v, spark.createDataFrame([("z", "t", "{}", 1, 5), ("z", "t", "{}", 4, 9)], new.schema), 100)
    with pytest.raises(write.Refused):
        write.bulk_load(v, v.filter("id = 'a'").select("id", "type", "data", "valid_from", "valid_to"), 100)
    with pytest.raises(ValueError):
        write.bulk_load(v, new, 100, "force")


def test_new_rows_are_numbered_and_ids_purged(spark):
    v = spark.createDataFrame([node("a", ver=7), node("c"), node("b")], NODE)
    assert rows(write.numbered(v), "id", "ver") == [("a", 7), ("b", 8), ("c", 9)]
    n, e = graph(spark, [node("a"), node("b")], [edge("1", "a", "b"), edge("2", "b", "b"), edge("3", "b", "a")])
    left = write.purge({"nodes": n, "edges": e}, spark.createDataFrame([("a",)], "id string"))
    assert rows(left["nodes"], "id") == [("b",)] and rows(left["edges"], "id") == [("2",)]


def test_snapshots_part_retry_and_bury(spark, tmp_path):
    root = str(tmp_path)
    n, _ = graph(spark, [node("a"), node("b", vt=5), node("c")], [edge("1", "a", "b")])
    snapshots.commit(spark, root, {"nodes": n}, 0)
    assert rows(snapshots.read(spark, root, "nodes", part="live"), "id") == [("a",), ("c",)] and snapshots.read(spark, root, "nodes").count() == 3
    tries = []

    def change(base):
        tries.append(base)
        if len(tries) == 1:  # another writer comes in between
            snapshots.commit(spark, root, {"other": spark.range(1)}, base)
        return {"more": spark.range(base)}

    assert snapshots.retried(spark, root, change) == 3 and tries == [1, 2]
    snapshots.commit(spark, root, {}, 3, {"nodes": spark.createDataFrame([("a",)], "id string")})
    assert rows(snapshots.read(spark, root, "nodes"), "id") == [("b",), ("c",)] and snapshots.read(spark, root, "nodes", 3).count() == 3
    wide = n.withColumn("extra", F.lit(1))
    snapshots.commit(spark, root, {"nodes": wide}, 4)
    assert "extra" in snapshots.read(spark, root, "nodes").columns and snapshots.read(spark, root, "nodes").count() == 3
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.commit(spark, root, {}, 2)


# feeds


def test_triggers_deliver_and_bury(spark, tmp_path):
    def flaky(event):
        if event["seq"] % 3 == 0:
            raise RuntimeError(f"no {event['seq']}")

    out = [(i, "node.create", "node", f"n{i}", "t", None, None, "insert", 10 * i, "trigger" if i == 6 else None) for i in range(1, 10)]
    spark.createDataFrame(out, feed.OUTBOX).write.parquet(str(tmp_path / "outbox"))
    stream = spark.readStream.schema(feed.OUTBOX).parquet(str(tmp_path / "outbox"))
    for _ in range(2):  # the second run finds nothing new
        feed.run_triggers(stream, flaky, str(tmp_path / "cursor"), str(tmp_path / "dead"), "sub", attempts=2, now=lambda: 77)
    dead = spark.read.schema(feed.DEAD).parquet(str(tmp_path / "dead"))
    got = feed.dead_letters(dead, "sub").collect()
    assert sorted(r.seq for r in got) == [3, 9] and got[0].attempts == 2 and "no " in got[0].error and json.loads(got[0].event)["op"] == "node.create"
    assert feed.dead_letters(dead.unionByName(dead), since=77).count() == 2 and feed.prune_dead_letters(dead, 78).count() == 0
    with pytest.raises(ValueError):
        feed.prune_dead_letters(dead, 1.5)


def test_webhooks_are_signed():
    sent = []
    act = feed.webhook_action(lambda body, headers: sent.append((body, headers)) or 200, "key")
    act({"seq": 4, "op": "node.create"})
    body, headers = sent[0]
    assert headers["x-signature"] == "sha256=" + hmac.new(b"key", body, hashlib.sha256).hexdigest() and headers["x-seq"] == "4" and json.loads(body)["seq"] == 4
    assert feed.webhook_request({}, "k", {"x-signature": "forged"})[1]["x-signature"] != "forged"
    with pytest.raises(RuntimeError):
        feed.webhook_action(lambda body, headers: 500)({})


def test_feed_pages_bus_and_states(spark):
    n, e = graph(spark, [node(f"n{i}", ver=i) for i in range(1, 4)], [edge("e", "a", "b", ver=9)])
    a, b, cursors = feed.feed_page(n, e, (0, 0), 2)
    assert [r.ver for r in a] == [1, 2] and [r.ver for r in b] == [9] and cursors == (2, None)
    assert [r.ver for r in feed.feed_page(n, e, cursors, 2)[0]] == [3]
    bus, heard = feed.Bus(), []
    stop = bus.subscribe(heard.append, lambda x: x["op"] == "a")
    bus.with_source("s", lambda: bus.publish({"op": "a"}))
    bus.publish({"op": "b"})
    stop()
    bus.publish({"op": "a"})
    assert heard == [{"op": "a", "source": "s"}]
    v = spark.createDataFrame([node("x", data="1", vf=0, vt=10), node("x", data="2", vf=10)], NODE)
    ev = spark.createDataFrame([(1, "x", "close", 10), (2, "x", "insert", 10), (3, "y", "insert", 1)], "seq long, id string, shape string, ts long")
    assert rows(feed.state_at_event(ev, v), "seq", "state") == [(1, "1"), (2, "2"), (3, None)]
    inputs = spark.createDataFrame([("x", "text"), ("z", "other")], "id string, text string")
    inserts = spark.createDataFrame([(1, "node.create", "node", "x", "t", None, None, "insert", 1, None), (2, "node.create", "node", "z", "t", None, None, "insert", 1, "trigger")], feed.OUTBOX)
    assert rows(feed.to_embed(inserts, inputs), "id") == [("x",)]


def test_watching_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello")
    (tmp_path / "in" / "b.txt").write_text("no")
    seen = []
    q = feed.watch(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.raw for r in seen] == ["hello"]


# access


def test_expand_and_checks(spark):
    m = {"member": access.Relation(), "parent": access.Relation(), "owner": access.Relation(), "banned": access.Relation(), "viewer": access.Relation(any=("owner",), minus=("banned",), via=(("parent", "viewer"),)), "loop": access.Relation(any=("loop",))}
    t = spark.createDataFrame([("doc", "owner", "ann", None), ("doc", "viewer", "team", "member"), ("doc", "parent", "dir", None), ("dir", "owner", "bob", None), ("doc", "banned", "eve", None), ("team", "member", "eve", None), ("team", "member", "ian", None)], "object string, relation string, subject string, subject_relation string")
    tree = access.expand(t, m, "doc", "viewer")
    assert tree["type"] == "exclusion" and tree["subtract"]["subjects"] == ["eve"]
    leaves = tree["base"]["children"]
    assert leaves[0] == {"type": "leaf", "subjects": [], "usersets": ["team#member"]} and leaves[1]["subjects"] == ["ann"]
    assert leaves[2]["children"][0]["base"]["children"][1]["subjects"] == ["bob"]
    assert access.expand(t, m, "doc", "loop")["children"][1] == {"type": "leaf", "subjects": [], "usersets": []}
    held = access.granted(t, {k: v for k, v in m.items() if k != "loop"})
    asks = spark.createDataFrame([("doc", "viewer", x) for x in ("ann", "bob", "eve", "ian", "zoe")], "object string, relation string, subject string")
    assert {r.subject for r in access.check(held, asks).collect() if r.allowed} == {"ann", "bob", "ian"}


def test_granted_sets_against_single_checks(spark):
    """Exclusions and intersections within what others follow from, parents and usersets, on random tuples."""
    m = {"member": access.Relation(), "parent": access.Relation(), "banned": access.Relation(), "editor": access.Relation(minus=("banned",)), "viewer": access.Relation(any=("editor",), via=(("parent", "viewer"),)), "auditor": access.Relation(both=("viewer",)), "reader": access.Relation(any=("viewer", "auditor"), minus=("banned",), via=(("parent", "reader"),))}
    assert access.strata(m)[0] == ["member", "parent", "banned"] and "reader" in access.strata(m)[-1]
    r = random.Random(12)
    for _ in range(3):
        rows_ = set()
        for _ in range(60):
            o, rel = f"o{r.randrange(6)}", r.choice(list(m))
            rows_.add((o, rel, f"o{r.randrange(6)}", None) if rel == "parent" else (o, rel, f"o{r.randrange(6)}", "member") if r.random() < 0.3 else (o, rel, f"u{r.randrange(6)}", None))

        def check(o, rel, who, above=()):
            if (o, rel) in above:
                return False
            here = (*above, (o, rel))
            own = any(t[0] == o and t[1] == rel and ((t[2] == who and t[3] is None) or (t[3] is not None and check(t[2], t[3], who, here))) for t in rows_)
            d = m[rel]
            own = own or any(check(o, x, who, here) for x in d.any)
            own = own or any(check(t[2], x, who, here) for s_, x in d.via for t in rows_ if t[0] == o and t[1] == s_)
            return own and all(check(o, x, who, here) for x in d.both) and not any(check(o, x, who, here) for x in d.minus)

        people = [f"u{i}" for i in range(6)]
        want = {(f"o{i}", rel, who) for i in range(6) for rel in m if rel != "parent" for who in people if check(f"o{i}", rel, who)}
        t = spark.createDataFrame(list(rows_), "object string, relation string, subject string, subject_relation string")
        got = {tuple(x) for x in access.granted(t, m).filter("relation <> 'parent' and subject like 'u%'").collect()}
        assert got == want
    with pytest.raises(ValueError):
        access.strata({"a": access.Relation(minus=("b",)), "b": access.Relation(any=("a",))})
    with pytest.raises(ValueError):
        access.strata({"a": access.Relation(minus=("b",)), "b": access.Relation()}, [("b", "a")])


def test_tuples_are_written_once_and_revoked(spark):
    e = spark.createDataFrame([], EDGE)
    t = spark.createDataFrame([("1", "doc", "viewer", "ann", None), ("2", "doc", "viewer", "ann", None), ("3", "doc", "viewer", "ann", "member")], "id string, object string, relation string, subject string, subject_relation string")
    once = model.persisted(access.write_tuples(e, t, 10))
    assert once.count() == 2 and access.write_tuples(once, t, 20).count() == 2
    gone = access.revoke_tuples(once, t.filter("subject_relation is not null"), 30)
    assert [r.subject_relation for r in access.as_tuples(gone).collect()] == [None] and access.as_tuples(gone, 15).count() == 2


# notes


BODY = "see [up:: [[A#x|y]]] and [rel:: [t](b%20c.md#Top)], [[B]] ![[pic.png]] [z](../q/d.md) [w](https://x) [h](#here) ![i](img.png) #Tag #tag #12 `#no` a#b [[E#No]]\n## H"


def test_links_tags_and_embeds(spark):
    n = spark.createDataFrame([("f/a.md", BODY)], "path string, body string")
    got = [tuple(r)[2:] for r in ingest.extract_links(n).orderBy("place").collect()]
    assert got == [("wiki", "A", "up", "x"), ("path", "b c.md", "rel", "Top"), ("wiki", "B", None, None), ("path", "../q/d.md", None, None), ("wiki", "E", None, "No")]
    assert rows(ingest.extract_embeds(n), "kind", "target") == [("path", "img.png"), ("wiki", "pic.png")] and rows(ingest.note_tags(n), "tag") == [("Tag",)]


def test_links_resolve_in_order(spark):
    files = spark.createDataFrame([("a/x.md", ["Nick"]), ("b/x.md", ["other"]), ("b/gamma.md", []), ("c/y.md", ["gamma", "Nick"]), ("q/d.md", None)], "path string, aliases array<string>")
    links = spark.createDataFrame([("a/n.md", "X", "wiki"), ("c/n.md", "x", "wiki"), ("c/n.md", "gamma", "wiki"), ("c/n.md", "Other", "wiki"), ("z/n.md", "nick", "wiki"), ("a/n.md", "b/gamma", "wiki"), ("b/n.md", "../q/d", "wiki"), ("b/n.md", "../q/d.md", "path"), ("b/n.md", "q/d.md", "path"), ("a/n.md", "none", "wiki"), ("a/n.md", "x.md", "wiki")], "path string, target string, kind string")
    got = {(r.path, r.target, r.kind): (r.to, r.state) for r in ingest.resolve_links(links, files).collect()}
    assert got == {("a/n.md", "X", "wiki"): ("a/x.md", "found"), ("c/n.md", "x", "wiki"): (None, "ambiguous"), ("c/n.md", "gamma", "wiki"): ("b/gamma.md", "found"), ("c/n.md", "Other", "wiki"): ("b/x.md", "found"), ("z/n.md", "nick", "wiki"): (None, "ambiguous"), ("a/n.md", "b/gamma", "wiki"): ("b/gamma.md", "found"), ("b/n.md", "../q/d", "wiki"): ("q/d.md", "found"), ("b/n.md", "../q/d.md", "path"): ("q/d.md", "found"), ("b/n.md", "q/d.md", "path"): (None, "missing"), ("a/n.md", "none", "wiki"): (None, "missing"), ("a/n.md", "x.md", "wiki"): ("a/x.md", "found")}


def test_a_vault_is_ingested(spark, tmp_path):
    for name, raw in {"a.md": "---\nid: one\ntype: note\naliases: [Al, 'B b']\n---\nto [[b]] and [[Lost]]", "d/b.md": "---\ntype: note\n---\nback [[Al]]", "c.yaml": "type: note\nname: \"Y\"", "dup.md": "---\nid: one\ntype: note\n---\n", "odd.md": "no type", ".trash/x.md": "---\ntype: note\n---\n", "skip.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(raw)
    files = ingest.discover(spark, str(tmp_path), (".md", ".yaml"))
    assert rows(files, "key") == [("a.md",), ("c.yaml",), ("d/b.md",), ("dup.md",), ("odd.md",)]
    p = {r.key: r for r in ingest.parse(files).collect()}
    assert p["a.md"].front == {"id": "one", "type": "note", "aliases": "Al\nB b"} and p["a.md"].body == "to [[b]] and [[Lost]]" and p["c.yaml"].front["name"] == "Y" and p["c.yaml"].body == ""
    assert p["a.md"].hash == hashlib.sha256(p["a.md"].raw.encode()).hexdigest()
    live = spark.createDataFrame([node("file:v/d/b.md", "note", hash=p["d/b.md"].hash, uri="ingest:v:d/b.md"), node("file:v/gone.md", "note", uri="ingest:v:gone.md")], NODE)
    out = ingest.ingest_notes(files, live, "v", F.try_element_at("front", F.lit("type")), ("note",), 5)
    assert dict(rows(out["nodes"], "key", "action")) == {"a.md": "add", "c.yaml": "add", "d/b.md": "unchanged"}
    assert rows(out["edges"], "src", "dst") == [("file:v/d/b.md", "id:one"), ("id:one", "file:v/d/b.md")]
    assert rows(out["skipped"], "key", "stage", "code") == [("a.md", "link", "missing"), ("dup.md", "node", "duplicate-id"), ("odd.md", "type", "unknown-type")]
    assert rows(ingest.vanished(live, "v", files), "key") == [("gone.md",)]
    lost = spark.createDataFrame([("Lost",), ("lost",)], "target string")
    assert ingest.stub_nodes(lost, live, "v", "stub", 5).filter("type = 'stub'").count() == 1


def test_equal_data_do_not_drift(spark):
    side = lambda data: spark.createDataFrame([("a", "r", "b", data)], "src string, rel string, dst string, data string")
    assert rows(ingest.reconcile(side('{"x":1,"y":{"b":1,"a":2}}'), side('{"y":{"a":2,"b":1}, "x":1}')), "action") == [("keep",)]
    assert rows(ingest.reconcile(side('{"x":1}'), side('{"x":2}')), "action") == [("drift",)]


def test_timetables(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence,departure_time\nt1,a,1,08:00:05\nt1,b,3,24:10:00\nt1,c,9,\nt2,a,1,7:00:00\n")
    t = ingest.stop_times(spark, str(tmp_path))
    assert rows(t, "trip", "stop", "departs") == [("t1", "a", 28805), ("t1", "b", 87000), ("t1", "c", None), ("t2", "a", 25200)]
    assert rows(ingest.connections(t), "src", "dst", "arrives") == [("a", "b", 87000), ("b", "c", None)]


# judgments and embedders


def test_judges_are_checked_and_retried():
    calls = []

    def once_down(question, texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("down")
        return [{"yes": 0.5}] * len(texts)

    assert len(judge.asked(once_down, judge.Question("?"), ["a"] * 5, batch=2)) == 5 and calls == [2, 2, 2, 1]
    for bad in ([{"yes": 2.0}], [{"no": 0.1}], []):
        with pytest.raises(ValueError):
            judge.asked(lambda q, t, bad=bad: bad, judge.Question("?"), ["a"])


def test_types_fields_and_edges(spark):
    def fixed(question, texts):
        return [{o: (1.0 if o in t else 0.0) for o in (question.options or question.level or ("yes",))} for t in texts]

    texts = spark.createDataFrame([(1, "book red yes"), (2, "film none"), (3, "film blue")], "id int, text string")
    got = rows(judge.infer_types(texts, fixed, ("book", "film"), {"colour": ("red", "blue"), "long": ()}, "text"), "id", "type", "data")
    assert got == [(1, "book", '{"colour":"red","long":"true"}'), (2, "film", '{"long":"false"}'), (3, "film", '{"colour":"blue","long":"false"}')]
    with pytest.raises(ValueError):
        judge.infer_types(texts, fixed, ("book",), {}, "text")
    c = spark.createDataFrame([("1", "a", "b", ["cites"], "cites"), ("2", "a", "c", ["cites"], "blocks"), ("3", "a", "d", ["cites"], "none")], "id string, src string, dst string, rels array<string>, text string")
    got = {r.id: (r.rel, r.verdict) for r in judge.type_edges(c, fixed, "which?", "text", ("cites", "blocks")).collect()}
    assert got["1"] == ("cites", "typed") and got["3"] == (None, "none") and got["2"][0] is None


def test_taxonomy_against_a_search_by_hand(spark):
    tree = {"root": ["a", "b"], "a": ["a1", "a2"], "b": ["b1"], "a1": ["x"]}
    children = spark.createDataFrame([(k, v) for k, vs in tree.items() for v in vs], "src string, dst string")

    def go(text, here, kids):
        weight = [1 + (len(text) * 7 + len(here) + 3 * i) % 5 for i in range(len(kids))]
        return {k: w / (sum(weight) + 1) for k, w in zip(kids, weight)} | {judge.STOP: 1 / (sum(weight) + 1)}

    def by_hand(text, beam, depth):
        front, done = [(["root"], 1.0)], []
        for _ in range(depth):
            nxt = []
            for path, p in front:
                kids = tree.get(path[-1], [])
                if not kids:
                    done.append((path, p))
                    continue
                pr = go(text, path[-1], kids)
                done.append((path, p * pr[judge.STOP]))
                nxt += [([*path, k], p * pr[k]) for k in kids]
            front = sorted(nxt, key=lambda x: (-x[1], x[0]))[:beam]
        return sorted(done + front, key=lambda x: (-x[1], x[0]))[:beam]

    items = spark.createDataFrame([(i, "t" * i) for i in range(6)], "id int, text string")
    for beam, depth in ((3, 6), (2, 2)):
        got = judge.taxonomy(items, children, "root", go, beam, depth).collect()
        for i in range(6):
            mine = sorted(((r.path, r.p) for r in got if r.id == i), key=lambda x: (-x[1], x[0]))
            want = by_hand("t" * i, beam, depth)
            assert [m[0] for m in mine] == [w[0] for w in want] and all(abs(m[1] - w[1]) < 1e-12 for m, w in zip(mine, want))
    with pytest.raises(ValueError):
        judge.taxonomy(items, children, "root", go, most=1)


def test_questions_are_planned(spark):
    n, _ = graph(spark, [node("a", "t"), node("b", "u")], [edge("e", "a", "b")])
    decide = lambda q: json.loads(q)
    plan = judge.plan_question('{"kind":"list","type":"t"}', decide, ("t",), ("pagerank",))
    assert rows(judge.run_plan(plan, n, None, None), "id") == [("a",)]
    plan = judge.plan_question('{"kind":"search","query":"x"}', decide, ("t",), ())
    assert judge.run_plan(plan, n, None, lambda q, k: (q, k)) == ("x", 10)
    for bad in ('{"kind":"drop"}', '{"kind":"list","type":"zz"}', '{"kind":"top","by":"zz"}'):
        with pytest.raises(ValueError):
            judge.plan_question(bad, decide, ("t",), ("pagerank",))


def test_pairs_of_large_blocks(spark):
    items = spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, block int")
    done = spark.createDataFrame([(2, 0)], "src int, dst int")
    got = judge.candidate_pairs(items, done, block_rows=3)
    assert rows(got, "a", "b") == sorted([(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2 and (a, b) != (0, 2)], key=str)


def test_embedders(spark, tmp_path):
    e = embed.Embedder("m", 2, lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2, max_chars=3)
    assert e(["a", "bcdef", "gh"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
    for call in (lambda t: [[1.0]] * len(t), lambda t: [[float("nan"), 1.0]] * len(t), lambda t: []):
        with pytest.raises(ValueError):
            embed.Embedder("m", 2, call)(["a"])
    path = str(tmp_path / "said.json")
    rec = embed.Recorded(path, "m", 2, e)
    assert rec(["a", "a", "b"]) == embed.Recorded(path, "m", 2)(["a", "a", "b"])
    with pytest.raises(KeyError):
        embed.Recorded(path, "m", 2)(["new"])
    n, _ = graph(spark, [node("a", "t", '{"name":"N"}', body="B"), node("b", "u", body="  "), node("c", "u", body="C"), node("d", "u", body="D", vt=3)], [edge("e", "a", "b")])
    got = embed.input_texts(n, {"t": lambda: F.concat_ws(": ", F.get_json_object("data", "$.name"), "body")})
    assert rows(got, "id", "text") == [("a", "N: B"), ("b", None), ("c", "C")]


def test_content_and_listing_of_versions(spark):
    n, _ = graph(spark, [node("a", "t", ver=1, body="red", uri="u", vt=9), node("a", "t", ver=2, body="blue", vf=9), node("b", "t", ver=3, body="red sky")], [edge("e", "a", "b")])
    assert rows(temporal.node_content(n, "a", as_of=5), "body", "uri") == [("red", "u")]
    assert rows(scan.list_node_versions(n, text="red"), "id", "revision") == [("b", "3")]
    assert scan.list_nodes(n, text="").count() == 0 and scan.list_nodes(n).columns == ["id", "type", "data"]


def test_release_deletes_what_was_written(spark):
    kept = model.persisted(spark.range(3))
    assert kept.count() == 3
    model.release(spark)
    with pytest.raises(Exception):
        kept.count()


def test_chunks_are_windows_that_end_at_gaps():
    assert vector.chunk_text("one two three four", 9) == ["one two", "three", "four"]
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice("ab  \n") for _ in range(r.randint(0, 120)))
        size = r.randint(1, 30)
        pieces = vector.chunk_text(t, size, r.randint(0, size - 1))
        assert all(0 < len(p) <= size and p == p.strip() and p in t for p in pieces)
        assert set("".join(pieces)) - {" ", "\n"} == set(t) - {" ", "\n"}
        plain = vector.chunk_text(t, size)
        assert "".join("".join(plain).split()) == "".join(t.split())  # nothing is lost, nothing is said twice
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            vector.chunk_text("x", *bad)
