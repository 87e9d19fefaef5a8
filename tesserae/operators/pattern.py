"""Neighbours and pattern matches: chains of equi joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.model import LIVE, TimeSlice
from tesserae.operators.compact import Arrays, compact

#: Nodes whose names path_counts() broadcasts to the tasks, at most; more are joined by shuffles.
MAX_NAMES = 200_000


def json_text(data: str, key: str) -> Column:
    """The text of one key of a JSON object, whatever signs the key has; null for JSON null or an absent key."""
    return F.try_element_at(F.from_json(data, "map<string,string>"), F.lit(key))


def adjacency(edges: DataFrame, direction: str = "out", rel: str | None = None) -> DataFrame:
    """(a, b, weight, valid_from, valid_to) along the direction; a self-loop stands once under both."""
    e = edges.filter(F.col("rel") == rel) if rel else edges
    cols = ["weight", "valid_from", "valid_to"]
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), *cols)
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), *cols)
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction!r}")
    return out if direction == "out" else back if direction == "in" else out.unionAll(back.filter("a <> b"))


def neighbors(nodes: DataFrame, edges: DataFrame, id: str, direction: str = "out", rel: str | None = None, when: TimeSlice = LIVE) -> DataFrame:
    """Neighbour nodes; one direction keeps parallel edges, both does not."""
    ids = adjacency(edges.filter(when.predicate()), direction, rel).filter(F.col("a") == id).select(F.col("b").alias("id"))
    return nodes.filter(when.predicate()).join(ids.distinct() if direction == "both" else ids, "id")


@dataclass
class Pattern:
    """node(), out()/into()/both() and hops() in turn; to_dataframe() folds them into joins."""

    nodes: DataFrame
    edges: DataFrame
    when: TimeSlice = LIVE
    steps: list[tuple] = field(default_factory=list)
    conds: list[tuple[str, str, object]] = field(default_factory=list)

    def node(self, alias: str, type: str | None = None) -> Pattern:
        self.steps.append(("node", alias, type))
        return self

    def out(self, rel: str) -> Pattern:
        self.steps.append(("edge", rel, "out"))
        return self

    def into(self, rel: str) -> Pattern:
        self.steps.append(("edge", rel, "in"))
        return self

    def both(self, rel: str) -> Pattern:
        self.steps.append(("edge", rel, "both"))
        return self

    def hops(self, rel: str, least: int, most: int) -> Pattern:
        self.steps.append(("var", rel, least, most))
        return self

    def where(self, alias: str, key: str, value: object) -> Pattern:
        self.conds.append((alias, key, value))
        return self

    def _nodes(self, alias: str, type: str | None) -> DataFrame:
        n = self.nodes.filter(self.when.predicate())
        n = n.filter(F.col("type") == type) if type else n
        for a, key, value in self.conds:
            if a == alias:
                text = str(value).lower() if isinstance(value, bool) else None if value is None else str(value)
                n = n.filter(json_text("data", key) == F.lit(text))
        return n.select(F.col("id").alias(alias))

    def rows(self) -> DataFrame:
        """One struct (id, type, data) of the node in the slice under each alias, in place of its id."""
        out = self.to_dataframe()
        depth = [c for c in out.columns if c == "depth" and any(s[0] == "var" for s in self.steps)]
        aliases = [c for c in out.columns if c not in depth]
        held = self.nodes.filter(self.when.predicate()).select(F.col("id").alias("_id"), F.struct("id", "type", "data").alias("_node"))
        for a in aliases:
            out = out.join(held, F.col(a) == F.col("_id")).withColumn(a, F.col("_node")).drop("_id", "_node")
        return out.select(*aliases, *depth)

    def to_dataframe(self) -> DataFrame:
        if [s[0] for s in self.steps[::2]] != ["node"] * ((len(self.steps) + 1) // 2) or any(s[0] == "node" for s in self.steps[1::2]) or len(self.steps) % 2 == 0:
            raise ValueError("a pattern is a chain of nodes with one step between two of them")
        if any(s[0] == "var" for s in self.steps) and len(self.steps) != 3:
            raise ValueError("a variable segment stands between two nodes and alone")
        aliases = [s[1] for s in self.steps[::2]]
        missing = {a for a, _, _ in self.conds} - set(aliases)
        if missing or len(set(aliases)) != len(aliases):
            raise ValueError(f"unknown or repeated alias {missing or aliases}")
        live = self.edges.filter(self.when.predicate())
        rows = self._nodes(*self.steps[0][1:])
        for step, (_, alias, type) in zip(self.steps[1::2], self.steps[2::2], strict=True):
            last = rows.columns[-1]
            if step[0] == "var":
                return self._paths(rows, live, step, alias, type)
            hop = adjacency(live, step[2], step[1]).select(F.col("a").alias(last), F.col("b").alias(alias))
            rows = rows.join(hop, last).join(self._nodes(alias, type), alias).select(*rows.columns, alias)
        return rows

    def _paths(self, rows: DataFrame, live: DataFrame, step: tuple, alias: str, type: str | None) -> DataFrame:
        """One row for each simple path of least..most hops."""
        _, rel, least, most = step
        start = rows.columns[0]
        hop = adjacency(live, "out", rel).select(F.col("a").alias("_at"), F.col("b").alias("_next"))
        level = rows.withColumn("_at", F.col(start)).withColumn("_path", F.array(start))
        found = [level.withColumn("depth", F.lit(0))] if least == 0 else []
        for depth in range(1, most + 1):
            level = level.join(hop, "_at").filter(~F.array_contains("_path", F.col("_next"))).select(start, F.col("_next").alias("_at"), F.array_append("_path", F.col("_next")).alias("_path"))
            if depth >= least:
                found.append(level.withColumn("depth", F.lit(depth)))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.withColumn(alias, F.col("_at")).join(self._nodes(alias, type), alias).select(start, alias, "depth")


def path_counts(edges: DataFrame, least: int, most: int) -> DataFrame:
    """(a, b, depth, n): how many simple paths of least to most edges lead from a to b. Parallel edges are counted, not
    walked one by one; up to three edges no path is walked: walks are counted, and those that return are taken off."""
    if most <= 3:
        ids, size, g = compact(edges.select(F.col("src").alias("id")).union(edges.select("dst")), edges.filter("src <> dst"))
        if g is not None:
            spark = edges.sparkSession
            shared = spark.sparkContext.broadcast(g)
            starts = spark.range(0, size, 1, max(1, min(size, 8 * spark.sparkContext.defaultParallelism)))
            counts = starts.mapInArrow(lambda batches: _counted(shared.value, batches, least, most), "na long, nb long, depth int, n long")
            for end in ("a", "b"):
                # Spark takes the counts for as small as the starts that they come from, and would broadcast them by the driver
                names = ids.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"))
                counts = counts.join(F.broadcast(names) if size <= MAX_NAMES else names.hint("merge"), f"n{end}")
            return counts.select("a", "b", "depth", "n")
    hop = edges.groupBy("src", "dst").agg(F.count("*").alias("many")).filter("src <> dst")
    level = edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("a"), F.col("src").alias("at"), F.array("src").alias("path"), F.lit(1).cast("long").alias("n"))
    found = []
    for depth in range(1, most + 1):
        level = level.join(hop, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("a", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), (F.col("n") * F.col("many")).alias("n"))
        if depth >= least:
            found.append(level.groupBy("a", F.col("at").alias("b")).agg(F.sum("n").alias("n")).select("a", "b", F.lit(depth).alias("depth"), "n"))
    return reduce(DataFrame.unionByName, found)


def _added(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers n by place: in doubles while those are exact."""
    if not len(n) or float(n.max()) * len(n) < 2**53:
        return np.bincount(at, n, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def _counted(g: Arrays, batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Numbers of simple paths from each start of the batches."""
    size = len(g.start) - 1
    src = np.repeat(np.arange(size), np.diff(g.start))
    key, back = src * size + g.dst, g.dst.astype(np.int64) * size + src
    at = np.minimum(np.searchsorted(key, back), max(len(key) - 1, 0))
    back = np.where(key[at] == back, g.many[at], 0).astype(np.int64)  # edges the other way
    returns = _added(src, g.many * back, size)  # walks of two edges from a node to itself
    for batch in batches:
        for a in batch.column(0).to_numpy():
            mine = slice(g.start[a], g.start[a + 1])
            one, level = g.dst[mine], np.zeros(size, np.int64)
            level[one] = g.many[mine]
            direct = level
            for depth in range(1, most + 1):
                if depth > 1:
                    last, level = level, np.zeros(size, np.int64)
                    for via in g.parts(np.flatnonzero(last)):
                        which, edge = g.out(via)
                        level = level + _added(g.dst[edge], last[via][which] * g.many[edge], size)
                paths = level
                if depth == 3:  # a-b-a-b and a-b-y-b are no paths, nor is a-x-a-b; the first is among both others
                    m = direct[one]
                    paths = level.copy()
                    paths[one] -= m * (returns[a] + returns[one]) - m * m * back[mine]
                paths = np.where(np.arange(size) == a, 0, paths)
                if depth >= least and len(b := np.flatnonzero(paths)):
                    yield pa.RecordBatch.from_pydict({"na": np.full(len(b), a), "nb": b, "depth": np.full(len(b), depth, np.int32), "n": paths[b]})


class BadSpec(ValueError):
    pass


def match_from_spec(nodes: DataFrame, edges: DataFrame, spec: dict) -> DataFrame:
    """The same pattern from a dict: steps that are nodes {node, type} and edges {rel, direction} or {rel, hops} in turn, and
    `where` conditions {alias, key, value}. Raises BadSpec for anything else."""
    try:
        unknown = set(spec) - {"steps", "where", "asOf", "recordedAsOf"}
        if unknown:
            raise BadSpec(f"unknown members {sorted(unknown)}")
        p = Pattern(nodes, edges, TimeSlice(spec.get("asOf"), spec.get("recordedAsOf")))
        for s in spec["steps"]:
            if "node" in s:
                p.node(s["node"], s.get("type"))
            elif "hops" in s:
                p.hops(s["rel"], *s["hops"])
            else:
                p.steps.append(("edge", s["rel"], s.get("direction", "out")))
        for c in spec.get("where", []):
            p.where(c["alias"], c["key"], c["value"])
        return p.to_dataframe()
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise BadSpec(f"no pattern: {e}") from e
