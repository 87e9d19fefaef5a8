import pytest

from tesserae.model import FOREVER, TimeSlice
from tesserae.operators import access, algorithms, embed, hybrid, ingest, pattern, scan, temporal, text, traverse, upcast, vector, write
from tesserae.sources import snapshots

V = "ver long, id string, data string, valid_from long, valid_to long, recorded_from long, recorded_to long"
MINI = [(1, "p", '{"y":90}', 100, FOREVER, 100, 300), (2, "p", '{"y":88}', 100, FOREVER, 300, FOREVER), (3, "q", '{"y":1}', 100, FOREVER, 100, 200), (4, "q", '{"y":1}', 100, 200, 200, FOREVER), (5, "q", '{"y":2}', 200, FOREVER, 200, FOREVER)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w), 0, FOREVER) for a, b, w in rows], "src string, dst string, weight double, valid_from long, valid_to long")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_bitemporal_slices(spark):
    v = spark.createDataFrame(MINI, V)
    at = lambda i, *w: [r.data for r in temporal.at(v.filter(f"id = '{i}'"), *w).collect()]
    assert at("q", 150) == ['{"y":1}'] and at("q") == ['{"y":2}'] and at("p", 150) == ['{"y":88}']
    assert at("p", 150, 250) == ['{"y":90}'] and at("q", None, 150) == ['{"y":1}']
    with pytest.raises(ValueError):
        TimeSlice(1.5)


def test_corrections_follow_an_instant_by_instant_model(spark):
    """Writes one after the other against a model of what holds at each instant."""
    x, seed, model = spark.createDataFrame([(1, "a", "v0", 0, FOREVER, 0, FOREVER)], V), 42, {t: "v0" for t in range(41)}
    for n in range(6):
        seed = (seed * 1103515245 + 12345) % 2**31
        lo, hi, gone = seed % 35, seed % 35 + 1 + seed // 64 % 5, n % 3 == 2
        w = spark.createDataFrame([("a", lo, hi, gone, f"v{n + 1}")], "id string, from long, to long, retract boolean, data string")
        write.check_write_time(w, 1000)
        x = spark.createDataFrame(write.supersede(x, w, 100 + n).collect(), V)
        model |= {t: None if gone else f"v{n + 1}" for t in range(lo, hi)}
        rows = x.filter(f"recorded_to = {FOREVER}").collect()
        for t, want in model.items():
            held = [r.data for r in rows if r.valid_from <= t < r.valid_to]
            assert held == ([want] if want else [])
    with pytest.raises(ValueError):
        write.check_write_time(w, 0)


def test_cursor_and_pages(spark):
    df = ids(spark, *"abcdefg")
    got, cursor = [], None
    while rows := [r.id for r in scan.page(df, ["id"], 3, cursor).collect()]:
        got, cursor = got + rows, scan.encode_cursor([rows[-1]])
    assert got == list("abcdefg")
    with pytest.raises(ValueError, match="invalid cursor"):
        scan.decode_cursor("???")


def test_patterns_are_checked(spark):
    n, e = ids(spark, "a"), edges(spark, [("a", "b", 1)])
    with pytest.raises(ValueError):
        pattern.Pattern(n, e).node("a").node("b").to_dataframe()
    with pytest.raises(ValueError):
        pattern.Pattern(n, e).node("a").hops("r", 1, 2).node("b").out("r").node("c").to_dataframe()


def test_shortest_paths_on_a_small_graph(spark):
    e = edges(spark, [("0", "1", 4), ("0", "2", 1), ("2", "1", 1), ("1", "3", 1), ("2", "3", 5), ("3", "4", 3), ("4", "5", 2), ("2", "5", 12), ("5", "6", 1), ("3", "6", 10)])
    cost = {r.id: r.cost for r in traverse.shortest_costs("0", pattern.adjacency(e)).collect()}
    assert cost == {"0": 0, "1": 2, "2": 1, "3": 3, "4": 6, "5": 8, "6": 9}


def test_journey_waits_for_edges(spark):
    e = spark.createDataFrame([("A", "B", 100, FOREVER), ("B", "C", 200, FOREVER), ("C", "D", 0, 150)], "src string, dst string, valid_from long, valid_to long")
    assert {r.id: (r.arrival, r.hops) for r in traverse.journey("A", 0, e).collect()} == {"B": (100, 1), "C": (200, 2)}


def test_betweenness_and_communities(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "e")]
    e = edges(spark, [(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in pairs])
    score = {r.id: r.score for r in algorithms.betweenness(ids(spark, *"abcde"), e).collect()}
    assert abs(score.pop("c") - 8 / 12) < 1e-9 and set(score.values()) == {0.0}
    two = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1)])
    mark = {r.id: r.community for r in algorithms.community(ids(spark, *"abcxyz"), two).collect()}
    assert mark == dict(zip("abcxyz", [0, 0, 0, 1, 1, 1], strict=True))
    assert abs(sum(r["rank"] for r in algorithms.pagerank(ids(spark, *"abcxyz"), two).collect()) - 1) < 1e-9


def test_text_vectors_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Ein Haus, ein Baum"), (2, "haus"), (3, "---")], "ver long, body string")
    once, twice = ({r.ver: r.score for r in text.bm25(docs, q).collect()} for q in ("haus", "haus haus"))
    assert set(once) == {1, 2} and once[2] > once[1] and abs(twice[2] - 2 * once[2]) < 1e-12
    assert text.fts_filter(docs, "!!").collect() == []
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0, 1.0])], "id string, chunk int, emb array<float>")
    assert [(r.id, r.chunk) for r in vector.vector_seeds(v, [1.0, 0.0], 2).collect()] == [("a", 0), ("b", 0)]
    with pytest.raises(ValueError):
        vector.vector_seeds(v, [float("nan"), 0.0])
    assert hybrid.mmr([("a", 1.0, [1, 0]), ("b", 0.9, [1, 0]), ("c", 0.8, [0, 1])], 2) == ["a", "c"]
    assert vector.chunk_text("one two three four", 9) == ["one two", "three", "four"] or all(len(c) <= 9 for c in vector.chunk_text("one two three four", 9))


def test_exclusion_must_not_depend_on_itself(spark):
    with pytest.raises(ValueError):
        access.check_model({"a": access.Relation(minus=("b",)), "b": access.Relation(minus=("a",))})


def test_links_tags_and_resolution(spark):
    body = "see [[Note B|b]] and [x](dir/c.md#top) `[[code]]` ![[embed]] [w](https://w.org) #Tag #tag #12\n```\n[[no]]\n```"
    notes = spark.createDataFrame([("a.md", body)], "path string, body string")
    assert {(r.target, r.kind) for r in ingest.note_links(notes).collect()} == {("Note B", "wiki"), ("dir/c.md", "markdown")}
    assert [r.tag for r in ingest.note_tags(notes).collect()] == ["Tag"]
    files = spark.createDataFrame([("x/Note B.md",), ("dir/c.md",), ("y/d.md",), ("z/d.md",)], "path string")
    links = spark.createDataFrame([("a.md", "Note B"), ("a.md", "dir/c.md"), ("a.md", "d"), ("y/n.md", "d"), ("a.md", "none")], "path string, target string")
    got = {(r.path, r.target): (r.to, r.state) for r in ingest.resolve_links(links, files).collect()}
    assert got == {("a.md", "Note B"): ("x/Note B.md", "found"), ("a.md", "dir/c.md"): ("dir/c.md", "found"), ("a.md", "d"): (None, "ambiguous"), ("y/n.md", "d"): ("y/d.md", "found"), ("a.md", "none"): (None, "missing")}


def test_snapshots_conflict(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert snapshots.commit(spark, root, {"t": ids(spark, "a")}, 0) == 1
    assert snapshots.commit(spark, root, {"t": ids(spark, "b")}, 1) == 2
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.commit(spark, root, {"t": ids(spark, "c")}, 1)
    assert [r.id for r in snapshots.read(spark, root, "t").collect()] == ["b"] and [r.id for r in snapshots.read(spark, root, "t", 1).collect()] == ["a"]


def test_shortest_path_nodes(spark):
    e = edges(spark, [("0", "1", 4), ("0", "2", 1), ("2", "1", 1), ("1", "3", 1), ("2", "3", 5), ("3", "4", 3), ("4", "5", 2), ("2", "5", 12), ("5", "6", 1), ("3", "6", 10), ("8", "9", 0), ("9", "8", 0)])
    adj = e.selectExpr("src a", "dst b", "weight")
    assert traverse.shortest_path("0", "6", adj) == (["0", "2", "1", "3", "4", "5", "6"], 9.0)
    assert traverse.shortest_path("0", "6", adj, weighted=False) == (["0", "1", "3", "6"], 3.0)
    assert traverse.shortest_path("8", "8", adj) == (["8"], 0.0) and traverse.shortest_path("8", "9", adj) == (["8", "9"], 0.0)
    assert traverse.shortest_path("6", "0", adj) is None and traverse.shortest_path("none", "0", adj) is None


def test_upcasting(spark):
    from pyspark.sql import functions as F

    named = lambda s: F.struct(s["first"].alias("name"), F.lit(0).alias("age"))
    older = lambda s: F.struct(s["name"].alias("name"), (s["age"] + 1).alias("age"), F.lit("x").alias("tag"))
    chains = {"p": upcast.Chain(("first string", "name string, age int", "name string, age int, tag string"), (named, older))}
    rows = [("a", "p", '{"first":"A"}'), ("b", "p", '{"name":"B","age":4,"_v":2}'), ("c", "p", '{"name":"C","age":5,"tag":"t","_v":3}'), ("d", "q", '{"z":1}'), ("e", "p", None), ("f", "p", '{"first":"F","_v":"2"}')]
    v = spark.createDataFrame([(n, i, t, d, 10, FOREVER, 10, FOREVER) for n, (i, t, d) in enumerate(rows)], "ver long, id string, type string, data string, valid_from long, valid_to long, recorded_from long, recorded_to long")
    read = {r.id: r.data for r in upcast.upcast(v, chains).collect()}
    assert read == {"a": '{"name":"A","age":1,"tag":"x"}', "b": '{"name":"B","age":5,"tag":"x"}', "c": '{"name":"C","age":5,"tag":"t"}', "d": '{"z":1}', "e": None, "f": '{"name":"F","age":1,"tag":"x"}'}
    assert [(r.type, r.current, r.live, r.behind) for r in upcast.upcast_report(v, chains).collect()] == [("p", 3, 5, 4)]
    held = v.filter("data is not null")
    after = write.supersede(held, upcast.upcast_writes(held, chains), 1000)
    live = {r.id: (r.data, r.valid_from) for r in temporal.at(after).collect()}
    assert live["a"] == ('{"name":"A","age":1,"tag":"x","_v":3}', 10) and live["d"][0] == '{"z":1}' and upcast.upcast_writes(after, chains).isEmpty()
    assert {r.data for r in temporal.at(after, None, 500).filter("id = 'a'").collect()} == {'{"first":"A"}'}
    with pytest.raises(Exception, match="newer than 3"):
        upcast.upcast(spark.createDataFrame([("p", '{"_v":4}')], "type string, data string"), chains).collect()
    with pytest.raises(ValueError):
        upcast.Chain(("a int", "b int"))


def test_embedding_report_and_reembedding(spark):
    def width(texts):
        return [[float(len(t)), 1.0] for t in texts]

    nodes = spark.createDataFrame([("a", "one two three four"), ("b", "same"), ("c", " "), ("d", None)], "id string, text string")
    none = spark.createDataFrame([], embed.VECTORS)
    report = lambda v, m: tuple(embed.embedding_report(nodes, v, m).first())
    assert report(none, "m") == (4, 0, 2, 0, 0)
    first = embed.reembed(nodes, none, "m", width, 2, size=9)
    got = sorted((r.id, r.chunk, r.text, r.emb[0]) for r in first.collect())
    assert [g[:2] for g in got if g[0] == "b"] == [("b", 0)] and all(len(t) == n for _, _, t, n in got) and {g[0] for g in got} == {"a", "b"}
    held = spark.createDataFrame(first.collect(), embed.VECTORS)
    assert report(held, "m") == (4, 2, 0, 0, len(got)) and report(held, "other") == (4, 2, 0, 2, len(got))
    nodes = spark.createDataFrame([("a", "new"), ("b", "same")], "id string, text string")
    gone = held.unionByName(spark.createDataFrame([("z", 0, "old", [1.0, 1.0], "h")], embed.VECTORS))
    again = embed.reembed(nodes, gone, "m", lambda texts: [[0.0, 0.0] for _ in texts], 2)
    assert sorted((r.id, r.text, r.emb) for r in again.collect()) == [("a", "new", [0.0, 0.0]), ("b", "same", [4.0, 1.0])]
    with pytest.raises(Exception, match="width 3"):
        embed.reembed(nodes, none, "m", width, 3).collect()
