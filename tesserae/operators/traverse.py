"""Traversals as level-synchronous loops: walks, journeys, shortest costs, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.model import FOREVER, persisted
from tesserae.operators.pattern import adjacency
from tesserae.operators.scan import within_fanout


def walk(seeds: DataFrame, adj: DataFrame, max_depth: int = 2, max_fanout: int | None = 1_000, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth, seed): each node reached at its least depth, by the smallest seed that reaches it there.

    Only allowed nodes are reached, seeds too; nodes of more than max_fanout edges are reached, but not passed
    (None: all are passed)."""
    hop = adj.select("a", "b")
    hop = (hop if max_fanout is None else within_fanout(hop, max_fanout)).distinct()
    if allowed is not None:
        hop = hop.join(allowed.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
        seeds = seeds.join(allowed.select("id"), "id", "left_semi")
    hop = persisted(hop)  # read in every round
    seen = persisted(seeds.select("id", F.lit(0).alias("depth"), F.col("id").alias("seed")).distinct())
    front = seen
    for depth in range(1, max_depth + 1):
        reached = front.join(hop, front.id == hop.a).groupBy(F.col("b").alias("id")).agg(F.min("seed").alias("seed"))
        front = persisted(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "seed"))
        seen = seen.unionAll(front)
    return seen


def by_rank(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """A walk's rows (id, depth, seed) with their seed's rank, in the order depth, rank, id. seeds: (id, rank)."""
    return found.join(F.broadcast(seeds.select(F.col("id").alias("seed"), "rank")), "seed").orderBy("depth", "rank", "id")  # as many seeds as were asked for


def journey(start: str, t0: int, edges: DataFrame, max_depth: int = 6, max_fanout: int | None = None) -> DataFrame:
    """(id, arrival, hops): earliest arrival over edges still valid, and the fewest hops, each on its own.

    With max_fanout, nodes of more edges that are open now are reached, but not passed; nodes without such edges are."""
    e = edges.select("src", "dst", "valid_from", "valid_to")
    if max_fanout is not None:
        many = e.filter(F.col("valid_to") == FOREVER).groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > max_fanout).select("src")
        e = e.join(many, "src", "left_anti").select("src", "dst", "valid_from", "valid_to")
    e = persisted(e)  # read in every round
    spark = edges.sparkSession
    level = spark.createDataFrame([(start, t0)], "id string, t long")
    found = spark.createDataFrame([], "id string, t long, depth int")
    for depth in range(1, max_depth + 1):
        nxt = level.join(e, level.id == e.src).filter(F.col("valid_to") > F.col("t")).groupBy(F.col("dst").alias("id")).agg(F.min(F.greatest("t", "valid_from")).alias("t"))
        level = persisted(nxt.filter(F.col("id") != start))
        found = found.unionAll(level.select("id", "t", F.lit(depth).alias("depth")))
    return found.groupBy("id").agg(F.min("t").alias("arrival"), F.min("depth").cast("long").alias("hops"))


def shortest_costs(src: str, adj: DataFrame, weighted: bool = True, max_rounds: int | None = None) -> DataFrame:
    """(id, cost) from src by relaxing until nothing improves, or for max_rounds hops."""
    spark = adj.sparkSession
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    hop = persisted(adj.select("a", "b", w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    best = spark.createDataFrame([(src, 0.0)], "id string, cost double")
    front, rounds = best, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        tried = front.join(hop, front.id == hop.a).groupBy(F.col("b").alias("id")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        front = persisted(tried.join(best, "id", "left").filter("cost is null or new < cost").select("id", F.col("new").alias("cost")))
        if front.isEmpty():
            break
        best = persisted(best.unionAll(front).groupBy("id").agg(F.min("cost").alias("cost")))
    return best


def shortest_path(src: str, dst: str, adj: DataFrame, weighted: bool = True) -> tuple[list[str], float] | None:
    """The nodes of a cheapest path and its cost, None if there is none; of equal predecessors the smallest.

    Each round keeps a node's cost and predecessor; nodes that already cost as much as dst are not expanded.
    """
    if src == dst:
        return [src], 0.0
    spark = adj.sparkSession
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    hop = persisted(adj.select("a", "b", w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    best = front = spark.createDataFrame([(src, 0.0, None)], "id string, cost double, prev string")
    while True:
        tried = front.join(hop, front.id == hop.a).groupBy(F.col("b").alias("id")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("prev"))).alias("new"))
        better = tried.join(best.select("id", "cost"), "id", "left").filter("cost is null or new.cost < cost")
        front = persisted(better.select("id", "new.cost", "new.prev"))
        if front.isEmpty():
            break
        best = persisted(best.unionAll(front).groupBy("id").agg(F.min_by(F.struct("cost", "prev"), "cost").alias("m")).select("id", "m.cost", "m.prev"))
        found = best.filter(F.col("id") == dst).first()
        if found:
            front = front.filter(F.col("cost") < found.cost)
    found = best.filter(F.col("id") == dst).first()
    if found is None:
        return None
    path, at = [dst], found
    while at.prev is not None:
        path.append(at.prev)
        at = best.filter(F.col("id") == at.prev).first()
    return path[::-1], found.cost


def reachable(seeds: DataFrame, adj: DataFrame) -> DataFrame:
    """Ids reached from the seeds, the seeds with them."""
    hop = persisted(adj.select("a", "b").distinct())  # read in every round
    seen = front = persisted(seeds.select("id").distinct())
    while not front.isEmpty():
        front = persisted(front.join(hop, front.id == hop.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = persisted(seen.unionAll(front))
    return seen


def arrivals_in_force(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node version in force at each arrival."""
    current = nodes.filter(F.col("recorded_to") == FOREVER)
    return found.join(current, "id").filter((F.col("valid_from") <= F.col("arrival")) & (F.col("valid_to") > F.col("arrival")))


def two_hops(id: str, edges: DataFrame, rel: str) -> DataFrame:
    """(id): the node and what lies within two edges of the relation, in either direction."""
    adj = adjacency(edges, "both", rel)
    return walk(edges.sparkSession.createDataFrame([(id,)], "id string"), adj, 2, max(1, 2**31 - 1)).select("id")
