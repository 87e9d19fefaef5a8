"""The named driver queries of the graph engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import FOREVER, LIVE, TimeSlice
from tesserae.operators import access, algorithms, hybrid, ingest, judge, pattern, scan, temporal, text, traverse, vector, write
from tesserae.plans.projection import oracle, project
from tesserae.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T1, T2, R1, R2, O1 = 1705000000000, 1705600000000, 1705300000000, 1706660000000, 900000000000
LIVE_SQL = f"valid_to = {FOREVER} AND recorded_to = {FOREVER}"
WORDS = "the and thinking of"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def at_sql(t: int | None, axis: str) -> str:
    return f"{axis}_to = {FOREVER}" if t is None else f"{axis}_from <= {t} AND {axis}_to > {t}"


def nodes_of(spark: SparkSession, d: str, *types: str) -> DataFrame:
    n = project(spark, d, "nodes")
    return n.filter(F.col("type").isin(*types)) if types else n


def edges_of(spark: SparkSession, d: str, *rels: str) -> DataFrame:
    e = project(spark, d, "edges")
    return e.filter(F.col("rel").isin(*rels)) if rels else e


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_of(c: str = "data"):
    return F.get_json_object(c, "$.event").alias("event")


# time slices and temporal reads


@query(f"SELECT json_extract_string(data, '$.event') AS event, count(*) AS n FROM versions WHERE {at_sql(T1, 'valid')} AND {at_sql(None, 'recorded')} GROUP BY 1")
def asof_users_by_event(spark, d):
    return temporal.at(project(spark, d, "versions"), T1).groupBy(event_of()).agg(F.count("*").alias("n"))


@query(f"SELECT id, ver FROM versions WHERE {at_sql(None, 'valid')} AND {at_sql(R2, 'recorded')}")
def recorded_asof_users(spark, d):
    return temporal.at(project(spark, d, "versions"), None, R2).select("id", "ver")


@query(f"SELECT id, ver, data FROM versions WHERE {at_sql(T1, 'valid')} AND {at_sql(R1, 'recorded')}")
def bitemporal_slice(spark, d):
    return temporal.at(project(spark, d, "versions"), T1, R1).select("id", "ver", "data")


@query(f"SELECT id, ver, CAST(ver AS VARCHAR) AS revision, data FROM versions WHERE id = 'u:3' AND {at_sql(T1, 'valid')} AND {at_sql(None, 'recorded')}")
def node_asof(spark, d):
    return temporal.node_version(project(spark, d, "versions"), "u:3", as_of=T1).select("id", "ver", "revision", "data")


@query(f"SELECT ver, valid_from, recorded_from, recorded_to = {FOREVER} AS current FROM versions WHERE id = 'u:3'")
def node_history(spark, d):
    return temporal.history(project(spark, d, "versions"), "u:3").select("ver", "valid_from", "recorded_from", "current")


@query(f"SELECT ver, id FROM versions WHERE recorded_to = {FOREVER} AND ((valid_from > {T1} AND valid_from <= {T2}) OR (valid_to > {T1} AND valid_to <= {T2}))")
def diff_valid(spark, d):
    return temporal.diff(project(spark, d, "versions"), T1, T2).select("ver", "id")


@query(f"SELECT ver, id FROM versions WHERE (recorded_from > {T1} AND recorded_from <= {T2}) OR (recorded_to > {T1} AND recorded_to <= {T2})")
def diff_recorded(spark, d):
    return temporal.diff(project(spark, d, "versions"), T1, T2, "recorded").select("ver", "id")


POINTS = f"pts AS (SELECT valid_from AS t FROM versions UNION ALL SELECT valid_to FROM versions WHERE valid_to < {FOREVER} UNION ALL SELECT valid_from FROM links UNION ALL SELECT valid_to FROM links WHERE valid_to < {FOREVER})"


def points(spark, d):
    return temporal.change_points(project(spark, d, "versions"), project(spark, d, "links"))


@query(f"WITH {POINTS} SELECT min(t) AS first, max(t) AS last, count(*) AS n FROM pts")
def timeline_extent(spark, d):
    return temporal.timeline_extent(points(spark, d))


@query(f"WITH {POINTS}, h AS (SELECT least(59, greatest(0, (t - {T1}) * 60 // {T2 - T1})) AS b, count(*) AS n FROM pts WHERE t >= {T1} AND t <= {T2} GROUP BY 1) SELECT r.b::BIGINT AS bucket, coalesce(n, 0) AS n FROM range(60) r(b) LEFT JOIN h ON h.b = r.b")
def timeline_buckets(spark, d):
    return temporal.timeline_buckets(points(spark, d), T1, T2, 60)


@query(f"WITH {POINTS}, r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM pts)) SELECT t FROM r WHERE rn % CAST(ceil((n - 1) / 99.0) AS BIGINT) = 0 OR rn = n - 1")
def timeline_ticks_sampled(spark, d):
    return temporal.timeline_ticks(points(spark, d), 100)


@query(f"SELECT greatest(max(valid_from), max(valid_to) FILTER (WHERE valid_to < {FOREVER}), max(recorded_from)) AS t FROM versions")
def latest_instant(spark, d):
    return temporal.latest_instant(project(spark, d, "versions"))


def overlapping(spark, d):
    v = project(spark, d, "versions")
    return v.withColumn("valid_to", F.when(F.col("ver") % 11 == 0, F.lit(FOREVER).cast("long")).otherwise(F.col("valid_to")))


OVER = f"o AS (SELECT * REPLACE (CASE WHEN ver % 11 = 0 THEN {FOREVER} ELSE valid_to END AS valid_to) FROM versions)"


@query(f"WITH {OVER} SELECT id, count(*) AS n FROM o WHERE {LIVE_SQL} GROUP BY id HAVING count(*) > 1")
def overlap_detect(spark, d):
    return temporal.overlaps(overlapping(spark, d))


@query(f"WITH {OVER} SELECT ver, CASE WHEN {LIVE_SQL} AND ver < max(CASE WHEN {LIVE_SQL} THEN ver END) OVER (PARTITION BY id) THEN {T2} ELSE recorded_to END AS recorded_to FROM o")
def overlap_repair(spark, d):
    return temporal.repair_overlaps(overlapping(spark, d), T2).select("ver", "recorded_to")


# listings


@query(f"SELECT id, type, data FROM nodes WHERE type = 'customer' AND {LIVE_SQL} AND id > 'c:1' ORDER BY id LIMIT 50")
def list_nodes_page(spark, d):
    return scan.list_nodes(nodes_of(spark, d), "customer", limit=50, cursor=scan.encode_cursor(["c:1"])).select("id", "type", "data")


@query(f"SELECT id, src, dst, weight FROM edges WHERE rel = 'placed' AND {at_sql(O1, 'valid')} AND {at_sql(None, 'recorded')} ORDER BY id LIMIT 200")
def list_edges_filtered(spark, d):
    return scan.list_edges(edges_of(spark, d), "placed", when=TimeSlice(O1), limit=200).select("id", "src", "dst", "weight")


@query(f"WITH s AS (SELECT id FROM nodes WHERE {LIVE_SQL} ORDER BY id LIMIT 3000) SELECT e.id, e.src, e.dst FROM edges e WHERE {LIVE_SQL} AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")
def graph_slice_links(spark, d):
    return scan.graph_slice(nodes_of(spark, d), edges_of(spark, d), 3000)[1].select("id", "src", "dst")


@query("SELECT id, coalesce(nullif(substring(trim(json_extract_string(data, '$.name')), 1, 80), ''), nullif(trim(json_extract_string(data, '$.title')), '')) AS label FROM nodes")
def graph_slice_labels(spark, d):
    return nodes_of(spark, d).select("id", scan.label(F.col("data")).alias("label"))


@query(f"SELECT type, count(*) AS n FROM nodes WHERE {LIVE_SQL} GROUP BY type")
def type_counts(spark, d):
    return scan.type_counts(nodes_of(spark, d))


# neighbours and patterns


@query(f"SELECT n.id FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'o:7' AND e.{LIVE_SQL.replace('AND ', 'AND e.')} AND n.{LIVE_SQL.replace('AND ', 'AND n.')}")
def neighbors_forward(spark, d):
    return pattern.neighbors(nodes_of(spark, d), edges_of(spark, d), "o:7").select("id")


@query(f"WITH l AS (SELECT * FROM edges WHERE {LIVE_SQL}) SELECT id, type FROM nodes WHERE {LIVE_SQL} AND id IN (SELECT dst FROM l WHERE src = 'n:3' UNION SELECT src FROM l WHERE dst = 'n:3')")
def neighbors_both(spark, d):
    return pattern.neighbors(nodes_of(spark, d), edges_of(spark, d), "n:3", "both").select("id", "type")


@query(f"WITH l AS (SELECT * FROM edges WHERE {LIVE_SQL}) SELECT DISTINCT src AS id FROM l WHERE dst = 'n:3' AND src > 'c:2' ORDER BY id LIMIT 20")
def neighbors_page(spark, d):
    n = pattern.neighbors(nodes_of(spark, d), edges_of(spark, d), "n:3", "in").select("id").distinct()
    return scan.page(n, ["id"], 20, scan.encode_cursor(["c:2"]))


ENDS = f"k AS MATERIALIZED (SELECT id, type FROM nodes WHERE {at_sql(O1, 'valid')} AND {at_sql(None, 'recorded')})"


@query(f"WITH l AS MATERIALIZED (SELECT src, dst, rel FROM edges WHERE rel IN ('placed', 'contains') AND {at_sql(O1, 'valid')} AND {at_sql(None, 'recorded')}), {ENDS} SELECT a.src AS c, a.dst AS o, b.dst AS p FROM l a JOIN k c ON c.id = a.src AND c.type = 'customer' JOIN k o ON o.id = a.dst AND o.type = 'order' JOIN l b ON b.src = a.dst AND b.rel = 'contains' JOIN k p ON p.id = b.dst AND p.type = 'part' WHERE a.rel = 'placed'")
def match_customer_order_part(spark, d):
    return pattern.Pattern(nodes_of(spark, d), edges_of(spark, d), TimeSlice(O1)).node("c", "customer").out("placed").node("o", "order").out("contains").node("p", "part").to_dataframe()


@query("SELECT e.src AS c, e.dst AS n FROM edges e JOIN nodes a ON a.id = e.src WHERE e.rel = 'in_nation' AND a.type = 'customer' AND json_extract_string(a.data, '$.segment') = 'BUILDING'")
def match_where(spark, d):
    return pattern.Pattern(nodes_of(spark, d), edges_of(spark, d)).node("c", "customer").out("in_nation").node("n").where("c", "segment", "BUILDING").to_dataframe()


@query("SELECT n.id AS n, CASE WHEN e.src = n.id THEN e.dst ELSE e.src END AS m FROM nodes n JOIN edges e ON (e.src = n.id OR e.dst = n.id) WHERE n.type = 'nation' AND e.rel = 'in_region'")
def match_both(spark, d):
    return pattern.Pattern(nodes_of(spark, d), edges_of(spark, d)).node("n", "nation").both("in_region").node("m").to_dataframe()


@query("SELECT DISTINCT a.src AS p, c.dst AS n FROM edges a JOIN edges c ON a.dst = c.src WHERE a.rel = 'supplied_by' AND c.rel = 'in_nation' ORDER BY p, n LIMIT 100")
def match_page_distinct(spark, d):
    m = pattern.Pattern(nodes_of(spark, d), edges_of(spark, d)).node("p").out("supplied_by").node("s").out("in_nation").node("n").to_dataframe()
    return scan.page(m.select("p", "n").distinct(), ["p", "n"], 100)


def users(spark, d):
    return project(spark, d, "versions").filter(LIVE.predicate())


def morning(spark, d):
    """A small temporal graph for queries whose SQL goes by paths: links of the first six hours. Their *_all read every link."""
    return all_links(spark, d).filter(F.col("valid_from") < 1704067200000 + 21_600_000)


def all_links(spark, d):
    return project(spark, d, "links").withColumn("rel", F.lit("next"))


DAY = "l AS (SELECT * FROM links WHERE valid_from < 1704088800000)"


@query(f"WITH {DAY}, p AS (SELECT DISTINCT src AS u FROM l), r AS (SELECT u AS s, u AS x, [u] AS path, 0 AS depth FROM p UNION ALL SELECT s, dst, list_append(path, dst), depth + 1 FROM r JOIN l ON l.src = r.x WHERE depth < 3 AND NOT list_contains(path, dst)) SELECT s AS a, x AS b, depth FROM r WHERE depth >= 1")
def match_var_1_3(spark, d):
    return paths_1_3(morning(spark, d))


HOP = "hop AS MATERIALIZED (SELECT src, dst, count(*) AS m FROM links GROUP BY src, dst)"


@query(f"WITH {HOP} SELECT src AS a, dst AS b, 1 AS depth, m AS n FROM hop UNION ALL SELECT x.src, y.dst, 2, sum(x.m * y.m)::BIGINT FROM hop x JOIN hop y ON y.src = x.dst WHERE y.dst <> x.src GROUP BY x.src, y.dst UNION ALL SELECT x.src, z.dst, 3, sum(x.m * y.m * z.m)::BIGINT FROM hop x JOIN hop y ON y.src = x.dst JOIN hop z ON z.src = y.dst WHERE y.dst <> x.src AND z.dst <> x.src AND z.dst <> y.src GROUP BY x.src, z.dst")
def match_var_1_3_all(spark, d):
    """Paths of one to three links over the whole table, counted by their ends and length (there are hundreds of millions)."""
    return pattern.path_counts(all_links(spark, d), 1, 3)


def paths_1_3(links):
    links = links.withColumn("valid_to", F.lit(FOREVER).cast("long"))
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    people = ids.select("id", F.lit("user").alias("type"), F.lit("{}").alias("data"), *[F.lit(x).cast("long").alias(c) for c, x in (("valid_from", 0), ("valid_to", FOREVER), ("recorded_from", 0), ("recorded_to", FOREVER))])
    return pattern.Pattern(people, links).node("a").hops("next", 1, 3).node("b").to_dataframe()


# traversals


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


ADJ = f"adj AS (SELECT src AS a, dst AS b FROM edges WHERE {LIVE_SQL} AND rel IN ('in_nation', 'in_region') UNION ALL SELECT dst, src FROM edges WHERE {LIVE_SQL} AND rel IN ('in_nation', 'in_region'))"


def places(spark, d):
    return pattern.adjacency(edges_of(spark, d, "in_nation", "in_region").filter(LIVE.predicate()), "both")


@query(f"WITH {ADJ}, w(id, depth, seed) AS (SELECT * FROM (VALUES ('s:1', 0, 's:1'), ('n:4', 0, 'n:4')) UNION SELECT b, depth + 1, seed FROM w JOIN adj ON a = id WHERE depth < 3) SELECT id, min(depth)::INTEGER AS depth, min(seed) FILTER (WHERE depth = m) AS seed FROM (SELECT *, min(depth) OVER (PARTITION BY id) AS m FROM w) GROUP BY id")
def walk_depth3(spark, d):
    return traverse.walk(seeds(spark, "s:1", "n:4"), places(spark, d), 3, 10**9)


@query(f"WITH {ADJ}, ok AS (SELECT adj.* FROM adj JOIN (SELECT a FROM adj GROUP BY a HAVING count(*) <= 60) USING (a)), w(id, depth) AS (SELECT 's:1', 0 UNION SELECT b, depth + 1 FROM w JOIN ok ON a = id WHERE depth < 4) SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY id")
def walk_fanout_guard(spark, d):
    return traverse.walk(seeds(spark, "s:1"), places(spark, d), 4, 60).select("id", "depth")


@query(f"WITH {DAY}, j(id, t, hops) AS (SELECT 'u:3', CAST(1704067200000 AS BIGINT), 0 UNION SELECT dst, greatest(t, valid_from), hops + 1 FROM j JOIN l ON src = id WHERE valid_to > t AND hops < 4) SELECT id, min(t) AS arrival, min(hops)::BIGINT AS hops FROM j WHERE id <> 'u:3' GROUP BY id")
def journey_users(spark, d):
    return traverse.journey("u:3", 1704067200000, morning(spark, d), 4)


ALL_J = ["j0 AS (SELECT 'u:3' AS id, CAST(1704067200000 AS BIGINT) AS t)"] + [f"j{k} AS (SELECT dst AS id, min(greatest(t, valid_from)) AS t FROM j{k - 1} JOIN links ON src = id WHERE valid_to > t AND dst <> 'u:3' GROUP BY dst)" for k in range(1, 5)]


@query(f"WITH {', '.join(ALL_J)} SELECT id, min(t) AS arrival, min(k)::BIGINT AS hops FROM ({' UNION ALL '.join(f'SELECT id, t, {k} AS k FROM j{k}' for k in range(1, 5))}) GROUP BY id")
def journey_users_all(spark, d):
    return traverse.journey("u:3", 1704067200000, all_links(spark, d), 4)


@query(f"WITH {DAY}, j(id, cost, hops) AS (SELECT 'u:3', CAST(0 AS DOUBLE), 0 UNION SELECT dst, cost + weight, hops + 1 FROM j JOIN l ON src = id WHERE hops < 5 AND cost < 60) SELECT id, min(cost) AS cost FROM j GROUP BY id")
def shortest_bounded(spark, d):
    return traverse.shortest_costs("u:3", pattern.adjacency(morning(spark, d)), True, 5)


ALL_W = "w AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM links GROUP BY src, dst)"
ALL_B = ["b0 AS (SELECT 'u:3' AS id, CAST(0 AS DOUBLE) AS cost)"] + [f"b{k} AS (SELECT id, min(cost) AS cost FROM (SELECT * FROM b{k - 1} UNION ALL SELECT dst, cost + weight FROM b{k - 1} JOIN w ON src = id) GROUP BY id)" for k in range(1, 6)]


@query(f"WITH {ALL_W}, {', '.join(ALL_B)} SELECT id, cost FROM b5")
def shortest_bounded_all(spark, d):
    return traverse.shortest_costs("u:3", pattern.adjacency(all_links(spark, d)), True, 5)


@query(f"WITH {DAY}, j(id, hops) AS (SELECT 'u:3', 0 UNION SELECT dst, hops + 1 FROM j JOIN l ON src = id WHERE hops < 150) SELECT id, min(hops)::DOUBLE AS cost FROM j GROUP BY id")
def shortest_hops(spark, d):
    return traverse.shortest_costs("u:3", pattern.adjacency(morning(spark, d)), False)


@query(f"WITH {ALL_W}, j(id, hops) AS (SELECT 'u:3', 0 UNION SELECT dst, hops + 1 FROM j JOIN w ON src = id WHERE hops < 40) SELECT id, min(hops)::DOUBLE AS cost FROM j GROUP BY id")
def shortest_hops_all(spark, d):
    return traverse.shortest_costs("u:3", pattern.adjacency(all_links(spark, d)), False)


@query("WITH r(id) AS (SELECT 'p:1' UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id WHERE e.rel IN ('supplied_by', 'in_nation', 'in_region')) SELECT id FROM r")
def reachable_closure(spark, d):
    return traverse.reachable(seeds(spark, "p:1"), pattern.adjacency(edges_of(spark, d, "supplied_by", "in_nation", "in_region")))


# algorithms

PR = ["r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS rank FROM u)"]
for _i in range(5):
    PR.append(f"r{_i + 1} AS (SELECT u.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f.s, 0) + dang / n) AS rank FROM u CROSS JOIN (SELECT count(*) AS n FROM u) CROSS JOIN (SELECT coalesce(sum(rank), 0) AS dang FROM r{_i} WHERE id NOT IN (SELECT src FROM g)) LEFT JOIN (SELECT dst, sum(rank / o) AS s FROM g JOIN od USING (src) JOIN r{_i} ON r{_i}.id = g.src GROUP BY dst) f ON f.dst = u.id)")
GRAPH = "g AS (SELECT src, dst FROM links), u AS (SELECT src AS id FROM links UNION SELECT dst FROM links), od AS (SELECT src, count(*) AS o FROM g GROUP BY src)"


def people(spark, d):
    links = project(spark, d, "links")
    return links.select(F.col("src").alias("id")).union(links.select("dst")).distinct(), links


@query(f"WITH {GRAPH}, {', '.join(PR)} SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_k5(spark, d):
    n, e = people(spark, d)
    return algorithms.pagerank(n, e, tol=0, max_iter=5).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH {GRAPH}, {', '.join(PR)} SELECT id, round(rank, 9) AS rank FROM r5 ORDER BY round(rank, 9) DESC, id LIMIT 10")
def top_pagerank(spark, d):
    return algorithms.top_nodes(pagerank_k5(spark, d), "rank", 10)


@query('SELECT n.id, coalesce(o.n, 0) AS "out", coalesce(i.n, 0) AS "in", coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM nodes n LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = n.id LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = n.id')
def degree_in_out(spark, d):
    return algorithms.degrees(nodes_of(spark, d), edges_of(spark, d))


@query()
def community_users(spark, d):
    return algorithms.community(*people(spark, d))


# hop counts and numbers of shortest paths, level by level; nobody is further than REACH links from whom they reach
REACH = 8
FAR = ["f0 AS (SELECT id AS s, id AS t, 0 AS d, CAST(1 AS DOUBLE) AS p FROM u)"] + [f"f{k} AS MATERIALIZED (SELECT s, dst AS t, {k} AS d, sum(p * m) AS p FROM f{k - 1} JOIN hop ON src = t WHERE (s, dst) NOT IN ({' UNION ALL '.join(f'SELECT s, t FROM f{i}' for i in range(k))}) GROUP BY s, dst)" for k in range(1, REACH + 1)]


@query(f"WITH {GRAPH}, {HOP}, {', '.join(FAR)}, f AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(REACH + 1))}), c AS (SELECT count(*) AS n FROM u), b AS (SELECT x.t AS v, sum(x.p * y.p / z.p) AS part FROM f x JOIN f y ON y.s = x.t JOIN f z ON z.s = x.s AND z.t = y.t WHERE x.d > 0 AND y.d > 0 AND x.d + y.d = z.d GROUP BY x.t) SELECT u.id, round(coalesce(part, 0) / ((n - 1)::DOUBLE * (n - 2)), 9) AS score FROM u CROSS JOIN c LEFT JOIN b ON b.v = u.id")
def betweenness_users(spark, d):
    return algorithms.betweenness(*people(spark, d)).select("id", F.round("score", 9).alias("score"))


@query("WITH t AS (SELECT DISTINCT 'c:' || o_custkey AS id, 'p:' || l_partkey AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT count(DISTINCT id) AS n FROM t), f AS (SELECT tag, count(*) AS df FROM t GROUP BY tag) SELECT t.id, round(sum(ln(n.n::DOUBLE / df)), 6) AS score FROM t JOIN f USING (tag) CROSS JOIN n WHERE tag IN (SELECT tag FROM t WHERE id = 'c:7') AND t.id <> 'c:7' GROUP BY t.id ORDER BY score DESC, t.id LIMIT 10")
def tag_similarity_idf(spark, d):
    tags = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("id"), F.concat(F.lit("p:"), "l_partkey").alias("tag"))
    return algorithms.tag_similarity(tags, "c:7").select("id", F.round("score", 6).alias("score"))


@query("SELECT dst AS id, round(sum(weight) / max(sum(weight)) OVER (), 9) AS volume FROM edges WHERE rel = 'contains' GROUP BY dst")
def incoming_volume_normalised(spark, d):
    v = edges_of(spark, d, "contains").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("v"))
    most = v.agg(F.max("v").alias("m"))
    return v.crossJoin(F.broadcast(most)).select("id", F.round(F.col("v") / F.col("m"), 9).alias("volume"))  # one row


# retrieval

TOK = r"tk AS (SELECT doc_id AS ver, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM documents), d AS (SELECT ver, toks, len(toks) AS l FROM tk WHERE len(toks) > 0), terms AS (SELECT ver, term, count(*) AS tf FROM (SELECT ver, unnest(toks) AS term FROM d) GROUP BY ver, term), dict AS (SELECT term, count(*) AS df FROM terms GROUP BY term), st AS (SELECT count(*) AS n, avg(l) AS avgdl FROM d)"
BM = f"{TOK}, q AS (SELECT unnest(['the', 'and', 'thinking', 'of']) AS term), bm AS (SELECT t.ver, sum(log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS score FROM q JOIN terms t USING (term) JOIN dict USING (term) JOIN d ON d.ver = t.ver CROSS JOIN st GROUP BY t.ver)"


def bodies(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("ver"), F.col("text").alias("body"))


@query(f"WITH {TOK} SELECT ver, term, tf FROM terms")
def fts_terms(spark, d):
    return text.build_index(bodies(spark, d))["terms"]


@query(f"WITH {TOK} SELECT term, df FROM dict")
def fts_dict(spark, d):
    return text.build_index(bodies(spark, d))["dict"]


@query(f"WITH {TOK} SELECT n AS num_docs, round(avgdl, 6) AS avgdl FROM st")
def fts_stats(spark, d):
    return text.build_index(bodies(spark, d))["stats"].select("num_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM} SELECT ver, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, ver LIMIT 10")
def bm25_topk(spark, d):
    return text.bm25(bodies(spark, d), WORDS).select("ver", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "ver").limit(10)


@query(f"WITH {BM} SELECT ver, round(score, 6) AS score FROM bm JOIN documents ON doc_id = ver WHERE lang = 'en' ORDER BY round(score, 6) DESC, ver LIMIT 10")
def bm25_filtered(spark, d):
    live = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("ver"))
    return text.bm25(bodies(spark, d), WORDS).join(live, "ver", "left_semi").select("ver", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "ver").limit(10)


@query(f"WITH {TOK} SELECT DISTINCT ver FROM terms WHERE term IN ('thinking', 'disgusting')")
def fts_filter(spark, d):
    return text.fts_filter(bodies(spark, d), "thinking disgusting").select("ver")


COS = "v AS (SELECT 'v:' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT id, 1 - list_dot_product(e, (SELECT e FROM v WHERE id = 'v:0')) / sqrt(list_dot_product(e, e) * (SELECT list_dot_product(e, e) FROM v WHERE id = 'v:0')) AS dist FROM v)"


def vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.concat(F.lit("v:"), "vec_id").alias("id"), F.lit(0).alias("chunk"), F.col("embedding").alias("emb"))
    return v, list(v.filter("id = 'v:0'").first().emb)


@query(f"WITH {COS} SELECT id, round(dist, 6) AS dist FROM k ORDER BY dist, id LIMIT 20")
def knn_cosine(spark, d):
    return vector.vector_seeds(*vectors(spark, d), 20).select("id", F.round("dist", 6).alias("dist"))


@query(f"WITH {COS}, c AS (SELECT 'g:' || (substr(id, 3)::BIGINT // 4) AS id, dist FROM k ORDER BY dist, id LIMIT 40) SELECT id, round(min(dist), 6) AS dist FROM c GROUP BY id ORDER BY min(dist), id LIMIT 10")
def knn_grouped_chunks(spark, d):
    v, q = vectors(spark, d)
    n = F.substring("id", 3, 20).cast("long")
    return vector.vector_seeds(v.select(F.concat(F.lit("g:"), F.floor(n / 4)).alias("id"), (n % 4).alias("chunk"), "emb"), q, 10).select("id", F.round("dist", 6).alias("dist"))


@query("WITH w AS (SELECT c_custkey AS id, list_filter(regexp_split_to_array(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9_]+'), lambda x: x <> '') AS ws FROM customer), h AS (SELECT id, list_transform(ws, lambda s: list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) % 64) AS slots FROM w) SELECT id, array_to_string(list_transform(range(64), lambda i: len(list_filter(slots, lambda s: s = i))), ',') AS emb FROM h")
def hash_embed_vectors(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.array_join(F.transform(vector.hash_embed(F.concat_ws(" ", "c_name", "c_mktsegment")), lambda x: x.cast("int").cast("string")), ",").alias("emb"))


@query("SELECT doc_id, sha256('m1' || chr(0) || text) AS hash FROM documents")
def embed_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", vector.embed_hash("m1", F.col("text")).alias("hash"))


LEGS = f"{BM}, {COS}, a AS (SELECT ver AS id, row_number() OVER (ORDER BY round(score, 6) DESC, ver) AS rank FROM (SELECT * FROM bm ORDER BY round(score, 6) DESC, ver LIMIT 40)), b AS (SELECT substr(id, 3)::BIGINT AS id, row_number() OVER (ORDER BY round(dist, 6), id) AS rank FROM (SELECT * FROM k ORDER BY dist, id LIMIT 40))"


def legs(spark, d):
    top = text.bm25(bodies(spark, d), WORDS).select(F.col("ver").alias("id"), F.round("score", 6).alias("s")).orderBy(F.desc("s"), "id").limit(40)
    near = vector.vector_seeds(*vectors(spark, d), 40)
    near = near.select("id", F.round("dist", 6).alias("s"))
    ranks = hybrid.ranked(near, "s", "id").select(F.substring("id", 3, 20).cast("long").alias("id"), "rank")
    return hybrid.ranked(top, F.desc("s"), "id"), ranks


@query(f"WITH {LEGS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, id LIMIT 10")
def rrf_fusion(spark, d):
    return hybrid.rrf(*legs(spark, d), k=10).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {LEGS}, j AS (SELECT doc_id AS id, (quality + toxic)::BIGINT AS gain FROM labels), r AS (SELECT a.rank, gain FROM a JOIN j USING (id) WHERE rank <= 20), i AS (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS rn FROM j WHERE gain > 0) SELECT round((SELECT count(*) FROM r WHERE gain > 0) / (SELECT count(*) FROM i), 6) AS recall, round(coalesce(1.0::DOUBLE / (SELECT min(rank) FROM r WHERE gain > 0), 0), 6) AS mrr, round((SELECT coalesce(sum((2 ** gain - 1) / log2(rank + 1)), 0) FROM r) / (SELECT sum((2 ** gain - 1) / log2(rn + 1)) FROM i WHERE rn <= 20), 6) AS ndcg")
def retrieval_metrics(spark, d):
    judged = table(spark, d, "labels").select(F.lit("q").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).cast("long").alias("gain")).filter("gain > 0")
    m = hybrid.metrics(legs(spark, d)[0].withColumn("query", F.lit("q")), judged, 20)
    return m.select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"WITH {LEGS}, s AS (SELECT 'd:' || id AS id FROM (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) ORDER BY score DESC, id LIMIT 5), hop AS (SELECT 'd:' || doc_id AS x, 'src:' || source AS y FROM documents UNION SELECT 'src:' || source, 'd:' || doc_id FROM documents), w(id, depth, seed) AS (SELECT id, 0, id FROM s UNION SELECT y, depth + 1, seed FROM w JOIN hop ON x = w.id WHERE depth < 2) SELECT id, min(depth)::INTEGER AS depth, min(seed) FILTER (WHERE depth = m) AS seed FROM (SELECT *, min(depth) OVER (PARTITION BY id) AS m FROM w) GROUP BY id")
def hybrid_walk(spark, d):
    """Fused document seeds, walked along a chain of documents of one source."""
    docs = table(spark, d, "documents")
    # the SQL orders equal scores by the names, which are text, not by the numbers
    top = hybrid.rrf(*[leg.withColumn("id", F.concat(F.lit("d:"), "id")) for leg in legs(spark, d)], k=5).select("id")
    adj = docs.select(F.concat(F.lit("d:"), "doc_id").alias("a"), F.concat(F.lit("src:"), "source").alias("b"))
    return traverse.walk(top, adj.union(adj.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2, None)


# writes


def beliefs(spark, d):
    """One believed row an id: the users' last state, open since it began."""
    return users(spark, d).select("ver", "id", "data", "valid_from", "valid_to", "recorded_from", "recorded_to")


def corrections(spark, d, retract):
    b = beliefs(spark, d)
    return b.select("id", (F.col("valid_from") + 1000).alias("from"), (F.col("valid_from") + 5000).alias("to"), F.lit(retract).alias("retract"), F.lit('{"event":"fixed"}').alias("data"))


def portion_sql(retract: bool) -> str:
    new = "" if retract else f"UNION ALL SELECT -1, id, '{{\"event\":\"fixed\"}}', valid_from + 1000, valid_from + 5000, shut, {FOREVER} FROM b"
    return f"WITH b AS (SELECT ver, id, data, valid_from, valid_to, recorded_from, recorded_to, greatest(recorded_from + 1, {T2 * 2}) AS shut FROM versions WHERE {LIVE_SQL}) SELECT ver, id, data, valid_from, valid_to, recorded_from, shut AS recorded_to FROM b UNION ALL SELECT -1, id, data, valid_from, valid_from + 1000, shut, {FOREVER} FROM b UNION ALL SELECT -1, id, data, valid_from + 5000, valid_to, shut, {FOREVER} FROM b {new}"


@query(portion_sql(False))
def portion_supersede(spark, d):
    return write.supersede(beliefs(spark, d), corrections(spark, d, False), T2 * 2).fillna(-1, ["ver"])


@query(portion_sql(True))
def retract_interval(spark, d):
    return write.supersede(beliefs(spark, d), corrections(spark, d, True), T2 * 2).fillna(-1, ["ver"])


SUB = f"s AS (SELECT ver AS id, valid_from AS f, least(valid_to, {T2}) AS t FROM versions WHERE valid_from < {T2}), x AS (SELECT id, f, t, f + (t - f) // 4 AS a, f + (t - f) // 2 AS b FROM s)"


@query(f"WITH {SUB} SELECT id, f AS \"from\", a AS \"to\" FROM x WHERE f < a UNION ALL SELECT id, b, t FROM x WHERE b < t")
def bulk_subtract(spark, d):
    s = project(spark, d, "versions").filter(F.col("valid_from") < T2).select(F.col("ver").alias("id"), F.col("valid_from").alias("from"), F.least("valid_to", F.lit(T2).cast("long")).alias("to"))
    covers = s.select("id", F.expr("`from` + (`to` - `from`) div 4").alias("from"), F.expr("`from` + (`to` - `from`) div 2").alias("to"))
    return write.subtract_intervals(s, covers.filter("`from` < `to`"))


@query(f"SELECT ver, CASE WHEN valid_to > {T1} THEN {FOREVER} ELSE valid_to END AS valid_to, recorded_to FROM versions WHERE valid_from <= {T1}")
def fork_valid_cut(spark, d):
    return write.fork(project(spark, d, "versions"), T1).select("ver", "valid_to", "recorded_to")


@query(f"SELECT ver, valid_to, CASE WHEN recorded_to > {R1} THEN {FOREVER} ELSE recorded_to END AS recorded_to FROM versions WHERE recorded_from <= {R1}")
def fork_recorded_cut(spark, d):
    return write.fork(project(spark, d, "versions"), None, R1).select("ver", "valid_to", "recorded_to")


@query(f"SELECT json_extract_string(data, '$.name') AS value, count(*) AS n FROM nodes WHERE type = 'part' AND {LIVE_SQL} GROUP BY 1 HAVING count(*) > 1")
def unique_prop_violations(spark, d):
    return write.unique_violations(nodes_of(spark, d).filter(LIVE.predicate()), "part", "name")


@query(f"SELECT src, count(*) AS n FROM edges WHERE rel = 'supplied_by' AND {LIVE_SQL} GROUP BY src HAVING count(*) > 1")
def single_rel_violations(spark, d):
    return write.single_violations(edges_of(spark, d).filter(LIVE.predicate()), "supplied_by")


# change feed and triggers


@query("SELECT ver, id, data FROM versions WHERE ver > 500 ORDER BY ver LIMIT 100")
def change_feed_page(spark, d):
    return feed.change_feed(project(spark, d, "versions"), 500).select("ver", "id", "data")


@query("SELECT seq, op, id FROM outbox WHERE seq > 100 AND entity = 'edge' AND op IN ('click', 'view') ORDER BY seq LIMIT 50")
def outbox_filtered(spark, d):
    return feed.outbox_tail(project(spark, d, "outbox"), 100, "edge", ("click", "view"), 50).select("seq", "op", "id")


@query("SELECT max(seq) AS seq FROM outbox")
def outbox_head(spark, d):
    return feed.outbox_head(project(spark, d, "outbox"))


@query("SELECT seq, id FROM outbox WHERE op = 'purchase' AND shape = 'insert' AND source IS NULL")
def trigger_match(spark, d):
    return feed.matching(project(spark, d, "outbox"), ("purchase",), shape="insert").select("seq", "id")


# access


def access_tuples(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    none = F.lit(None).cast("string")
    parts = [
        n.select(F.concat(F.lit("n:"), "n_nationkey"), F.lit("viewer"), F.concat(F.lit("r:"), "n_regionkey"), F.lit("member")),
        c.select(F.concat(F.lit("r:"), F.col("c_custkey") % 5), F.lit("member"), F.concat(F.lit("c:"), "c_custkey"), none),
        c.filter("c_custkey % 7 = 0").select(F.concat(F.lit("n:"), "c_nationkey"), F.lit("owner"), F.concat(F.lit("c:"), "c_custkey"), none),
        c.filter("c_custkey % 4 = 0").select(F.concat(F.lit("n:"), "c_nationkey"), F.lit("banned"), F.concat(F.lit("c:"), "c_custkey"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("object", "relation", "subject", "subject_relation")


MODEL = {"member": access.Relation(), "owner": access.Relation(), "banned": access.Relation(), "viewer": access.Relation(any=("owner",)), "reader": access.Relation(any=("viewer",), minus=("banned",))}
HELD = "mem AS (SELECT 'r:' || (c_custkey % 5) AS g, 'c:' || c_custkey AS s FROM customer), own AS (SELECT 'n:' || c_nationkey AS o, 'c:' || c_custkey AS s FROM customer WHERE c_custkey % 7 = 0), ban AS (SELECT 'n:' || c_nationkey AS o, 'c:' || c_custkey AS s FROM customer WHERE c_custkey % 4 = 0), vw AS (SELECT 'n:' || n_nationkey AS o, s FROM nation JOIN mem ON g = 'r:' || n_regionkey UNION SELECT o, s FROM own), rd AS (SELECT * FROM vw EXCEPT SELECT * FROM ban)"


@query(f"WITH {HELD} SELECT g AS object, 'member' AS relation, s AS subject FROM mem UNION ALL SELECT o, 'owner', s FROM own UNION ALL SELECT o, 'banned', s FROM ban UNION ALL SELECT o, 'viewer', s FROM vw UNION ALL SELECT o, 'reader', s FROM rd")
def granted_set(spark, d):
    return access.granted(access_tuples(spark, d), MODEL)


@query(f"WITH {HELD} SELECT o AS object FROM rd WHERE s = 'c:7' ORDER BY o LIMIT 100")
def list_objects(spark, d):
    return access.list_objects(access.granted(access_tuples(spark, d), MODEL), "reader", "c:7")


# ingestion


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return ingest.page_links(table(spark, d, "pages"))


@query("WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages), w AS (SELECT 'page:' || page_id AS src, 'links' AS rel, link AS dst, CAST(page_id % 3 AS VARCHAR) AS data FROM l WHERE page_id % 10 <> 0), h AS (SELECT 'page:' || page_id AS src, 'links' AS rel, link AS dst, CAST(page_id % 2 AS VARCHAR) AS data FROM l WHERE page_id % 10 <> 1) SELECT coalesce(w.src, h.src) AS src, coalesce(w.rel, h.rel) AS rel, coalesce(w.dst, h.dst) AS dst, CASE WHEN h.src IS NULL THEN 'add' WHEN w.src IS NULL THEN 'close' WHEN w.data IS DISTINCT FROM h.data THEN 'drift' ELSE 'keep' END AS action FROM w FULL JOIN h ON w.src = h.src AND w.rel = h.rel AND w.dst = h.dst")
def edge_reconcile(spark, d):
    links = ingest.page_links(table(spark, d, "pages")).distinct()
    side = lambda skip, mod: links.filter(F.col("page_id") % 10 != skip).select(F.concat(F.lit("page:"), "page_id").alias("src"), F.lit("links").alias("rel"), F.col("link").alias("dst"), (F.col("page_id") % mod).cast("string").alias("data"))
    return ingest.reconcile(side(0, 3), side(1, 2))


# judgments


@query(f"SELECT least(floor(least(greatest(weight / 60, 0), 1) * 10), 9)::BIGINT AS bucket, count(*) AS written, count(*) FILTER (WHERE {LIVE_SQL}) AS live, count(*) - count(*) FILTER (WHERE {LIVE_SQL}) AS closed, round((count(*) - count(*) FILTER (WHERE {LIVE_SQL})) / count(*), 9) AS closed_rate FROM edges GROUP BY 1")
def calibration_buckets(spark, d):
    c = judge.calibration(edges_of(spark, d).withColumn("weight", F.col("weight") / 60))
    return c.withColumn("closed_rate", F.round("closed_rate", 9))


@query(f"WITH b AS (SELECT id, data FROM versions WHERE {at_sql(T1, 'valid')} AND {at_sql(None, 'recorded')}), a AS (SELECT id, data FROM versions WHERE {at_sql(T2, 'valid')} AND {at_sql(None, 'recorded')}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'deleted' ELSE 'updated' END AS change, b.data AS before, a.data AS after FROM a FULL JOIN b ON a.id = b.id WHERE a.data IS DISTINCT FROM b.data")
def judged_changes_class(spark, d):
    return judge.changes(project(spark, d, "versions"), T1, T2)


@query("WITH i AS (SELECT s_suppkey AS id, s_nationkey AS block FROM supplier), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM i a JOIN i b ON a.block = b.block AND a.id < b.id) SELECT * FROM p WHERE NOT (b = a + 25)")
def dedupe_pairs(spark, d):
    s = table(spark, d, "supplier")
    linked = s.select((F.col("s_suppkey") + 25).alias("src"), F.col("s_suppkey").alias("dst"))
    return judge.candidate_pairs(s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block")), linked)
