import collections
import datetime
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.operators import algorithms, compact, pattern
from tesserae.queries import QUERIES

T0 = 1704067200000


@pytest.fixture(scope="module")
def month(tmp_path_factory):
    """Events over 30 days and the links between them; all but a few begin after the first six hours."""
    r, d = random.Random(5), tmp_path_factory.mktemp("month")
    ts = sorted(r.sample(range(30 * 86400), 60))
    rows = [(i, t * 1000, r.randrange(9), r.choice(("view", "click"))) for i, t in enumerate(ts)]
    start = datetime.datetime(2024, 1, 1)
    pq.write_table(pa.table({"event_id": [x[0] for x in rows], "ts": pa.array([start + datetime.timedelta(milliseconds=x[1]) for x in rows], pa.timestamp("us")), "user_id": [x[2] for x in rows], "event_type": [x[3] for x in rows], "value": [0.0] * 60, "props": ["{}"] * 60}), d / "events.parquet")
    links = []
    for kind in ("view", "click"):
        for a, b in itertools.pairwise(x for x in rows if x[3] == kind):
            if a[2] != b[2]:
                links.append((f"u:{a[2]}", f"u:{b[2]}", 1.0 + a[0] % 9, T0 + a[1], T0 + a[1] + 172800000))
    assert sum(x[3] < T0 + 21_600_000 for x in links) < len(links) / 10
    return str(d), links


def test_paths_and_costs_over_all_links(spark, month):
    d, links = month
    got = lambda q: QUERIES[q](spark, d).collect()
    paths, level = collections.Counter(), [(x,) for x in {y for link in links for y in link[:2]}]
    for depth in (1, 2, 3):
        level = [(*p, x[1]) for p in level for x in links if x[0] == p[-1] and x[1] not in p]
        paths.update((p[0], p[-1], depth) for p in level)
    assert {(x.a, x.b, x.depth): x.n for x in got("match_var_1_3_all")} == paths
    cost, hops, arrive = {"u:3": 0.0}, {"u:3": 0.0}, {}
    walks, seen = [("u:3", 0.0, T0, True)], {"u:3"}
    for depth in range(1, 10):
        walks = list({(x[1], c + x[2], max(t, x[3]), on and x[4] > t) for at, c, t, on in walks for x in links if x[0] == at}) if depth < 6 else [(x[1], 0.0, 0, False) for at in seen for x in links if x[0] == at]
        for at, c, t, on in walks:
            hops.setdefault(at, float(depth))
            if depth < 6:
                cost[at] = min(c, cost.get(at, c))
            if depth < 5 and on and at != "u:3":
                old = arrive.get(at, (t, depth))
                arrive[at] = (min(t, old[0]), old[1])
        seen |= {w[0] for w in walks}
    assert {x.id: x.cost for x in got("shortest_bounded_all")} == cost
    assert {x.id: x.cost for x in got("shortest_hops_all")} == hops
    assert {x.id: (x.arrival, x.hops) for x in got("journey_users_all")} == arrive


def test_algorithms_over_all_links(spark, month):
    d, links = month
    ids = sorted({y for link in links for y in link[:2]})
    far, ways = {}, collections.Counter()
    for s in ids:
        far[s, s], ways[s, s], front = 0, 1, [s]
        while front:
            new = []
            for u in front:
                for link in links:
                    if link[0] == u:
                        v = link[1]
                        if (s, v) not in far:
                            far[s, v] = far[s, u] + 1
                            new.append(v)
                        if far[s, v] == far[s, u] + 1:
                            ways[s, v] += ways[s, u]
            front = new
    score = {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s in ids for t in ids if s != t and v not in (s, t) and (s, t) in far and (s, v) in far and (v, t) in far and far[s, v] + far[v, t] == far[s, t]) for v in ids}
    got = {x.id: x.score for x in QUERIES["betweenness_users"](spark, d).collect()}
    assert got == pytest.approx({v: x / (len(ids) - 1) / (len(ids) - 2) for v, x in score.items()})
    mark = {v: v for v in ids}
    for _ in range(20):
        before = dict(mark)
        for v in ids:
            votes = collections.Counter(mark[b if a == v else a] for a, b, *_ in links if v in (a, b))
            mark[v] = min(votes, key=lambda m: (-votes[m], m))
        if mark == before:
            break
    found = collections.defaultdict(set)
    for x in QUERIES["community_users"](spark, d).collect():
        found[x.community].add(x.id)
    want = collections.defaultdict(set)
    for v, m in mark.items():
        want[m].add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_path_counts_do_not_walk_paths(spark):
    # 200 nodes with an edge from each to each: 7.8 million paths of three edges, 39,800 pairs of ends
    edges = spark.range(40_000).selectExpr("concat('u:', id div 200) src", "concat('u:', id % 200) dst")
    found = pattern.path_counts(edges, 1, 3).persist()
    assert {(r.depth, r.n, r["count"]) for r in found.groupBy("depth", "n").count().collect()} == {(1, 1, 39_800), (2, 198, 39_800), (3, 198 * 197, 39_800)}
    assert not any("array_contains" in line for line in found._jdf.queryExecution().toString().splitlines())


def test_path_counts_by_joins_agree(spark, monkeypatch):
    r = random.Random(3)
    edges = spark.createDataFrame([(f"u:{r.randrange(12)}", f"u:{r.randrange(12)}") for _ in range(90)], "src string, dst string")
    rows = lambda: {tuple(x) for x in pattern.path_counts(edges, 1, 3).collect()}
    arrays = rows()
    monkeypatch.setattr(compact, "MAX_PAIRS", 5)
    assert rows() == arrays and len(arrays) > 100


def test_path_counts_never_go_by_the_driver(spark, monkeypatch):
    def broadcasts(plan):
        own = [plan.toString()] if plan.nodeName() == "BroadcastExchange" else []
        return own + [x for i in range(plan.children().size()) for x in broadcasts(plan.children().apply(i))]

    edges = spark.range(400).selectExpr("concat('u:', id div 20) src", "concat('u:', id % 20) dst")
    for names in (20, 19):  # more names than are broadcast go by shuffles
        monkeypatch.setattr(pattern, "MAX_NAMES", names, raising=False)
        found = pattern.path_counts(edges, 1, 3)
        sent = broadcasts(found._jdf.queryExecution().executedPlan().initialPlan())
        assert bool(sent) == (names == 20) and not any("MapInArrow" in x for x in sent)
        assert {(r.depth, r.n, r["count"]) for r in found.groupBy("depth", "n").count().collect()} == {(1, 1, 380), (2, 18, 380), (3, 18 * 17, 380)}


def test_betweenness_counts_parallel_edges_once_and_has_no_bound(spark, monkeypatch):
    # more links than were brought to a task, between few pairs; then more pairs than are: both give the same
    r = random.Random(8)
    pairs = [(f"u:{r.randrange(14)}", f"u:{r.randrange(14)}") for _ in range(40)]
    edges = spark.createDataFrame([p for p in pairs for _ in range(3)], "src string, dst string").withColumn("weight", F.lit(1.0))
    nodes = spark.createDataFrame([(f"u:{i}",) for i in range(16)], "id string")
    score = lambda: {x.id: x.score for x in algorithms.betweenness(nodes, edges).collect()}
    want = {x.id: x.score for x in algorithms.betweenness(nodes, edges, weighted=True).collect()}
    monkeypatch.setattr(algorithms, "MAX_EDGES", 50)
    assert score() == pytest.approx(want) and max(want.values()) > 0
    monkeypatch.setattr(compact, "MAX_PAIRS", 5)
    assert score() == pytest.approx(want)


def test_betweenness_of_long_chains_of_parallel_edges():
    # 300 steps of 60 parallel edges: 60 ** 299 paths are more than a double holds
    g = compact.Arrays(np.minimum(np.arange(302), 300), np.arange(1, 301, dtype=np.int32), np.full(300, 60, np.int32))
    total = np.zeros(301)
    algorithms._add_dependencies(g, 0, total)
    assert total.tolist() == pytest.approx([0] + [299 - i for i in range(299)] + [0])


def test_betweenness_looks_at_few_edges_and_at_several_sources_at_once(spark, monkeypatch):
    # most nodes are two edges away, and their 60 edges each lead back to what has been seen; some pairs have two or three edges
    size, r = 1_500, np.random.default_rng(4)
    pairs = np.unique(r.integers(0, size, (size * 60, 2)), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    start, dst = np.searchsorted(pairs[:, 0], np.arange(size + 1)), pairs[:, 1].astype(np.int32)
    looked, out = [], compact.Arrays.out
    monkeypatch.setattr(compact.Arrays, "out", lambda g, nodes: (looked.append(int((g.start[nodes + 1] - g.start[nodes]).sum())), out(g, nodes))[1])
    for most in (1, 3, 50):
        g = compact.Arrays(start, dst, r.integers(1, most + 1, len(dst)).astype(np.int32))
        looked.clear()
        one = np.zeros(size)
        for s in range(5):
            algorithms._add_dependencies(g, s, one)
        assert sum(looked) < 5 * len(dst) / 2
        dist, ways, want = np.full((5, size), -1), np.zeros((5, size)), np.zeros(size)
        a = np.zeros((size, size))
        a[pairs[:, 0], pairs[:, 1]] = g.many
        for s in range(5):
            level, part = np.eye(size)[s], np.zeros(size)
            for d in range(size):
                level = np.where(dist[s] < 0, level, 0.0)
                if not level.any():
                    break
                dist[s][level > 0], ways[s] = d, ways[s] + level
                level = level @ a
            for d in range(dist[s].max() - 1, 0, -1):
                below = np.where(dist[s] == d + 1, (1 + part) / np.maximum(ways[s], 1), 0.0)
                part = np.where(dist[s] == d, ways[s] * (a @ below), part)
            want += part
        assert one.tolist() == pytest.approx(want.tolist())
        several = np.zeros(size)
        algorithms._add_dependencies(g.spread, np.arange(5), several)
        assert several.tolist() == pytest.approx(want.tolist())


def test_betweenness_of_several_sources_scales_each_by_itself():
    # 300 steps of 60 parallel edges beside a long single chain, both followed at once
    start = np.concatenate([np.arange(301), [300], np.arange(301, 601), [600]])
    dst = np.concatenate([np.arange(1, 301), np.arange(302, 602)]).astype(np.int32)
    g = compact.Arrays(start, dst, np.concatenate([np.full(300, 60), np.ones(300)]).astype(np.int32))
    total = np.zeros(602)
    algorithms._add_dependencies(g, np.array([0, 301]), total)
    assert total.tolist() == pytest.approx(2 * ([0] + [299 - i for i in range(299)] + [0]))
