"""Bitemporal writes on whole batches: portions, corrections, retractions, forks, constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.model import FOREVER, LIVE, persisted, ranked


def check_write_time(writes: DataFrame, now: int) -> None:
    """No future dating, no empty intervals."""
    bad = writes.filter((F.col("from") > now) | ((F.col("to") < FOREVER) & (F.col("to") > now)) | (F.col("from") >= F.col("to")))
    if not bad.isEmpty():
        raise ValueError("a write is dated in the future or has an empty interval")
    if not writes.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("one write an id in a batch")


def supersede(versions: DataFrame, writes: DataFrame, now: int, payload: tuple[str, ...] = ("data",), base_at_from: bool = False) -> DataFrame:
    """versions after writes (id, from, to, payload..., retract): for each id at most one write.

    Current beliefs that the interval overlaps are closed on the recorded axis; what of them lies left and right of
    it is believed on; the write's row stands between, unless it is a retraction. Its other columns are those of the
    live row (or the last one); with base_at_from, those of the belief that holds where the interval begins, if any."""
    w = writes.select(F.col("id"), F.col("from").alias("_f"), F.col("to").alias("_t"), "retract", *[F.col(p).alias(f"_{p}") for p in payload])
    j = versions.join(w, "id", "left").withColumn("_hit", F.coalesce((F.col("recorded_to") == FOREVER) & (F.col("valid_from") < F.col("_t")) & (F.col("valid_to") > F.col("_f")), F.lit(False)))
    cols = [c for c in versions.columns if c != "ver"]
    hit = j.filter("_hit")
    at = hit.groupBy("id").agg(F.greatest(F.max("recorded_from") + 1, F.lit(now)).alias("_at"))
    j = j.join(at, "id", "left")
    kept = j.select("ver", *[F.when(F.col("_hit"), F.col("_at")).otherwise(F.col(c)).alias(c) if c == "recorded_to" else F.col(c) for c in cols])

    def piece(rows: DataFrame, **new) -> DataFrame:
        new = {"recorded_from": F.col("_at"), "recorded_to": F.lit(FOREVER).cast("long"), **new}
        return rows.select(F.lit(None).cast("long").alias("ver"), *[new[c].alias(c) if c in new else F.col(c) for c in cols])

    hit = j.filter("_hit")
    left = piece(hit.filter("valid_from < _f"), valid_to=F.col("_f"))
    right = piece(hit.filter("valid_to > _t"), valid_from=F.col("_t"))
    base = w.join(at, "id", "left").filter("not retract").withColumn("_at", F.coalesce("_at", F.lit(now).cast("long")))
    carried = [c for c in cols if c not in ("id", "valid_from", "valid_to", "recorded_from", "recorded_to", *payload)]
    holds = F.coalesce((F.col("recorded_to") == FOREVER) & (F.col("valid_from") <= F.col("_f")) & (F.col("valid_to") > F.col("_f")), F.lit(False)) if base_at_from else F.lit(False)
    latest = F.max_by(F.struct("ver", *carried), F.struct(holds, "recorded_to", "valid_to", "ver")).alias("_o")
    other = versions.join(w.select("id", "_f"), "id").groupBy("id").agg(latest).select("id", *[F.col(f"_o.{c}").alias(c) for c in carried])
    new = piece(base.join(other, "id", "left"), valid_from=F.col("_f"), valid_to=F.col("_t"), **{p: F.col(f"_{p}") for p in payload})
    return kept.unionByName(left).unionByName(right).unionByName(new)


def merge_data(old: str, patch: str) -> str:
    """SQL for a shallow merge of two JSON objects: the patch's values win, whatever their kinds; null is a value."""
    m = lambda x: f"from_json({x}, 'map<string,variant>')"
    return f"to_json(map_from_entries(concat(filter(map_entries({m(old)}), e -> not array_contains(map_keys({m(patch)}), e.key)), map_entries({m(patch)}))))"


def subtract_intervals(stored: DataFrame, covers: DataFrame) -> DataFrame:
    """(id, from, to): what of stored (id, from, to) no interval of covers (id, from, to) takes."""
    s = stored.select("id", F.col("from").alias("sf"), F.col("to").alias("st"))
    c = covers.select("id", F.col("from").alias("cf"), F.col("to").alias("ct"))
    hit = s.join(c, (s.id == c.id) & (F.col("cf") < F.col("st")) & (F.col("ct") > F.col("sf")), "left").select(s.id, "sf", "st", "cf", "ct")
    w = W.partitionBy("id", "sf", "st").orderBy("cf", "ct")
    upto = F.greatest(F.col("sf"), F.coalesce(F.max("ct").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("sf")))
    gaps = hit.withColumn("g", upto).filter(F.col("cf").isNull() | (F.col("cf") > F.col("g"))).select("id", F.col("g").alias("from"), F.coalesce("cf", "st").alias("to"))
    tail = hit.filter("cf is not null").groupBy("id", "sf", "st").agg(F.max("ct").alias("m")).filter("m < st").select("id", F.col("m").alias("from"), F.col("st").alias("to"))
    return gaps.unionByName(tail).filter("from < to")


def fork(versions: DataFrame, valid_cut: int | None = None, recorded_cut: int | None = None) -> DataFrame:
    """The rows a branch starts with: what began by the cut, open again where it ended after it."""
    rows = versions
    for axis, cut in (("recorded", recorded_cut), ("valid", valid_cut)):
        if cut is not None:
            rows = rows.filter(F.col(f"{axis}_from") <= cut).withColumn(f"{axis}_to", F.when(F.col(f"{axis}_to") > cut, F.lit(FOREVER).cast("long")).otherwise(F.col(f"{axis}_to")))
    return rows


def unique_violations(live: DataFrame, type: str, key: str) -> DataFrame:
    """(value, n): values that several live nodes of a type share; nulls are exempt."""
    v = F.get_json_object("data", f"$.{key}")
    return live.filter(F.col("type") == type).filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def single_violations(live_edges: DataFrame, rel: str) -> DataFrame:
    return live_edges.filter(F.col("rel") == rel).groupBy("src").agg(F.count("*").alias("n")).filter("n > 1")


class Refused(ValueError):
    """A write that the schema, a constraint or stored versions do not allow; nothing has been written."""


def refuse(bad: DataFrame, why: str) -> None:
    """Raises if bad has rows; names the first of them."""
    some = bad.limit(3).collect()
    if some:
        raise Refused(f"{why}: {[tuple(r) for r in some]}")


@dataclass(frozen=True)
class Rel:
    """Types that may stand at either end (none named: any), and whether a node has one live edge of it at most."""

    source: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    single: bool = False


@dataclass(frozen=True)
class Schema:
    """Node types with the keys their data must have, keys unique among live nodes, and relations."""

    nodes: dict[str, tuple[str, ...]]
    edges: dict[str, Rel] = field(default_factory=dict)
    unique: tuple[tuple[str, str], ...] = ()

    def check_nodes(self, rows: DataFrame) -> None:
        refuse(rows.filter(~F.coalesce(F.col("type").isin(*self.nodes), F.lit(False))).select("id", "type"), "unknown node types")
        for type, keys in self.nodes.items():
            for key in keys:
                refuse(rows.filter((F.col("type") == type) & F.get_json_object("data", f"$.{key}").isNull()).select("id"), f"{type} without {key}")

    def check_edges(self, rows: DataFrame, live_nodes: DataFrame) -> None:
        refuse(rows.filter(~F.coalesce(F.col("rel").isin(*self.edges), F.lit(False))).select("id", "rel"), "unknown relations")
        refuse(rows.filter("weight < 0").select("id", "weight"), "negative weights")
        types = live_nodes.select(F.col("id").alias("_id"), F.col("type").alias("_type"))
        for end in ("src", "dst"):
            named = {r: d.source if end == "src" else d.target for r, d in self.edges.items()}
            ask = rows.filter(F.col("rel").isin(*[r for r, t in named.items() if t]))
            fits = F.lit(False)
            for r, t in named.items():
                if t:
                    fits = fits | ((F.col("rel") == r) & F.col("_type").isin(*t))
            found = ask.join(types, F.col(end) == F.col("_id"), "left")
            refuse(found.filter(~F.coalesce(fits, F.lit(False))).select("id", "rel", end, "_type"), f"{end} of the wrong type")

    def check_live(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        """Refuses live nodes that share a unique key, and several live edges of a single-valued relation."""
        for type, key in self.unique:
            refuse(unique_violations(nodes.filter(LIVE.predicate()), type, key), f"{type}.{key} is unique")
        for rel, d in self.edges.items():
            if d.single and edges is not None:
                refuse(single_violations(edges.filter(LIVE.predicate()), rel), f"{rel} is single-valued")


def fresh(rows: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """rows as new versions: from now and open unless they say otherwise, recorded now, without ver; what rows lack is null."""
    given = dict(rows.dtypes)
    own = {"valid_from": F.coalesce("valid_from", F.lit(now)) if "valid_from" in given else F.lit(now), "valid_to": F.coalesce("valid_to", F.lit(FOREVER)) if "valid_to" in given else F.lit(FOREVER), "recorded_from": F.lit(now), "recorded_to": F.lit(FOREVER), "ver": F.lit(None)}
    return rows.select(*[own.get(c, F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in versions.dtypes])


def events_of(rows: DataFrame, op: str, entity: str, shape: str) -> DataFrame:
    """Outbox events, without seq, of written rows."""
    ends = ["src", "dst"] if entity == "edge" else [F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst")]
    return rows.select(F.lit(op).alias("op"), F.lit(entity).alias("entity"), "id", F.col("rel" if entity == "edge" else "type").alias("label"), F.lit(shape).alias("shape"), F.col("valid_from").alias("ts"), *ends)


def check_instants(rows: DataFrame, now: int) -> None:
    refuse(rows.filter((F.col("valid_from") > now) | (F.col("valid_from") >= F.col("valid_to")) | ((F.col("valid_to") < FOREVER) & (F.col("valid_to") > now))).select("id", "valid_from", "valid_to"), "dated in the future or empty")


def add_nodes(versions: DataFrame, rows: DataFrame, schema: Schema, now: int) -> tuple[DataFrame, DataFrame]:
    """versions with new nodes (id, type, data, ...), and their events. Refuses ids that exist, unknown types, future dates."""
    new = fresh(rows, versions, now)
    schema.check_nodes(new)
    check_instants(new, now)
    refuse(new.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "one row an id")
    refuse(new.join(versions, "id", "left_semi").select("id"), "nodes that exist")
    out = versions.unionByName(new)
    schema.check_live(out)
    return out, events_of(new, "node.create", "node", "insert")


def add_edges(versions: DataFrame, nodes: DataFrame, rows: DataFrame, schema: Schema, now: int) -> tuple[DataFrame, DataFrame]:
    """versions with new edges (id, src, dst, rel, ...), and the events. A new edge of a single-valued relation closes every
    live edge of its (src, rel) from where it begins, past where those began, in the same write."""
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    singles = [r for r, d in schema.edges.items() if d.single]
    given = F.col("valid_from") if "valid_from" in rows.columns else F.lit(None).cast("long")
    new = fresh(rows, versions, now)
    schema.check_edges(new, nodes.filter(LIVE.predicate()))
    check_instants(new, now)
    refuse(new.filter(F.col("rel").isin(*singles)).groupBy("src", "rel").agg(F.count("*").alias("n")).filter("n > 1"), "one new edge a source of a single-valued relation")
    prior = versions.filter(LIVE.predicate() & F.col("rel").isin(*singles)).select(F.col("id").alias("_old"), "src", "rel", F.col("valid_from").alias("_vf"), F.col("recorded_from").alias("_rf"), F.col("dst").alias("_dst"))
    ask = rows.select("id", "src", "rel", given.alias("_said")).filter(F.col("rel").isin(*singles))
    hit = ask.join(prior, ["src", "rel"])
    per = hit.groupBy("id").agg(F.coalesce(F.max("_said"), F.greatest(F.lit(now).cast("long"), F.max("_vf") + 1, F.max("_rf") + 1)).alias("_from"), F.greatest(F.lit(now).cast("long"), F.max("_rf") + 1).alias("_at"))
    hit = persisted(hit.join(per, "id").select("_old", "src", "rel", "_dst", "_from"))
    closes = hit.select(F.col("_old").alias("id"), F.col("_from").alias("from"), F.lit(FOREVER).cast("long").alias("to"), F.lit(True).alias("retract"), F.lit(None).cast("string").alias("data"))
    new = new.join(per, "id", "left").withColumn("valid_from", F.coalesce("_from", "valid_from")).withColumn("recorded_from", F.coalesce("_at", "recorded_from")).select(*versions.columns)
    closed = events_of(hit.select(F.col("_old").alias("id"), "src", F.col("_dst").alias("dst"), "rel", F.col("_from").alias("valid_from")), "edge.supersede", "edge", "close")
    return supersede(versions, closes, now).unionByName(new), closed.unionByName(events_of(new, "edge.create", "edge", "insert"))


def update_nodes(versions: DataFrame, patches: DataFrame, now: int) -> DataFrame:
    """versions after patches (id, data: JSON object to merge, or null; body, if it is to be replaced; valid_from, if given).

    The live row is superseded from there, or from now and past its own start; other columns are carried on."""
    live = versions.filter(LIVE.predicate()).select("id", F.col("data").alias("_data"), F.col("valid_from").alias("_vf"), F.col("recorded_from").alias("_rf"))
    asked = patches.join(live, "id", "left")
    refuse(asked.filter("_vf is null").select("id"), "no live version")
    start = F.greatest(F.lit(now).cast("long"), F.col("_vf") + 1, F.col("_rf") + 1)
    start = F.coalesce("valid_from", start) if "valid_from" in patches.columns else start
    merged = F.when(F.col("data").isNull(), F.col("_data")).otherwise(F.expr(merge_data("_data", "data")))
    keep = ["body"] if "body" in patches.columns else []
    writes = asked.select("id", start.alias("from"), F.lit(FOREVER).cast("long").alias("to"), F.lit(False).alias("retract"), merged.alias("data"), *keep)
    if "valid_from" in patches.columns:
        check_write_time(writes.join(patches.filter("valid_from is not null").select("id"), "id"), now)
    return supersede(versions, writes, now, ("data", *keep))


def correct(versions: DataFrame, patches: DataFrame, now: int, payload: tuple[str, ...] = ()) -> DataFrame:
    """versions of nodes or edges after corrections (id, from, to, data: JSON object to merge, or null; payload...).

    What is corrected is the belief that holds where the interval begins, else the live one; null payload leaves it."""
    beliefs = versions.filter(F.col("recorded_to") == FOREVER)
    kept = ("data", *payload)
    best = beliefs.join(patches.select("id", F.col("from").alias("_f")), "id")
    holds = (F.col("valid_from") <= F.col("_f")) & (F.col("valid_to") > F.col("_f"))
    best = best.filter(holds | (F.col("valid_to") == FOREVER)).groupBy("id").agg(F.max_by(F.struct(*kept), F.struct(holds, "valid_to")).alias("_b"))
    asked = patches.join(best, "id", "left")
    refuse(asked.filter("_b is null").select("id"), "no version to correct")
    data = F.when(F.col("data").isNull(), F.col("_b.data")).otherwise(F.expr(merge_data("_b.data", "data")))
    writes = asked.select("id", "from", "to", F.lit(False).alias("retract"), data.alias("data"), *[F.coalesce(F.col(p), F.col(f"_b.{p}")).alias(p) for p in payload])
    check_write_time(writes, now)
    return supersede(versions, writes, now, kept, base_at_from=True)


def correct_edges(versions: DataFrame, patches: DataFrame, now: int) -> DataFrame:
    """The same for edges (id, from, to, data, weight, source)."""
    refuse(patches.filter("weight < 0").select("id", "weight"), "negative weights")
    return correct(versions, patches, now, ("weight", "source"))


def bulk_load(versions: DataFrame, rows: DataFrame, now: int, mode: str = "refuse") -> DataFrame:
    """versions with rows (id, valid_from, valid_to, ...), all of them or none.

    Intervals of one id must not overlap, with one open at most. Current beliefs that a row overlaps are refused, or
    (mode `correct`) superseded: what of them no row covers is believed on. All is recorded at one instant, past those."""
    if mode not in ("refuse", "correct"):
        raise ValueError(f"no mode {mode!r}")
    new = persisted(fresh(rows, versions, now))
    check_instants(new, now)
    last = F.max("valid_to").over(W.partitionBy("id").orderBy("valid_from", "valid_to").rowsBetween(W.unboundedPreceding, -1))
    refuse(new.withColumn("_before", last).filter("valid_from < _before").select("id", "valid_from"), "intervals of one id overlap")
    covers = new.select("id", F.col("valid_from").alias("_cf"), F.col("valid_to").alias("_ct"))
    hits = versions.filter(F.col("recorded_to") == FOREVER).select("ver", "id", "valid_from", "valid_to", "recorded_from").join(covers, "id").filter("_cf < valid_to and valid_from < _ct")
    if mode == "refuse":
        refuse(hits.select("id", "valid_from", "valid_to", "_cf", "_ct"), "stored versions overlap")
        return versions.unionByName(new)
    hits = persisted(hits)
    at = F.broadcast(hits.agg(F.greatest(F.lit(now).cast("long"), F.coalesce(F.max("recorded_from") + 1, F.lit(now).cast("long"))).alias("_at")))  # one row
    closed = hits.select("ver").distinct().withColumn("_hit", F.lit(True))
    kept = versions.join(closed, "ver", "left").crossJoin(at).withColumn("recorded_to", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("recorded_to"))).select(*versions.columns)
    whole = hits.select(F.col("ver").alias("id"), F.col("valid_from").alias("from"), F.col("valid_to").alias("to")).distinct()
    pieces = subtract_intervals(whole, hits.select(F.col("ver").alias("id"), F.col("_cf").alias("from"), F.col("_ct").alias("to")))
    left = versions.join(pieces.select(F.col("id").alias("ver"), "from", "to"), "ver").crossJoin(at)
    left = left.withColumn("valid_from", F.col("from")).withColumn("valid_to", F.col("to")).withColumn("recorded_from", F.col("_at")).withColumn("recorded_to", F.lit(FOREVER).cast("long")).withColumn("ver", F.lit(None).cast("long")).select(*versions.columns)
    return kept.unionByName(left).unionByName(new.crossJoin(at).withColumn("recorded_from", F.col("_at")).select(*versions.columns))


def bulk_edges(versions: DataFrame, rows: DataFrame, schema: Schema, now: int, nodes: DataFrame | None = None, mode: str = "refuse") -> DataFrame:
    """The same for edges; refuses single-valued relations, and, where nodes are given, ends of the wrong type."""
    refuse(rows.filter(F.col("rel").isin(*[r for r, d in schema.edges.items() if d.single])).select("id", "rel"), "single-valued relations are added one by one")
    full = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    if nodes is not None:
        schema.check_edges(full, nodes.filter(LIVE.predicate()))
    return bulk_load(versions, full, now, mode)


def numbered(versions: DataFrame) -> DataFrame:
    """versions whose new rows (ver null) are numbered after the highest ver, by when they were recorded and their ids."""
    top = versions.agg(F.coalesce(F.max("ver"), F.lit(0).cast("long"))).first()[0]
    new = ranked(versions.filter("ver is null").drop("ver"), ["recorded_from", "id", "valid_from"], "_n").withColumn("ver", F.col("_n") + top + 1)
    return versions.filter("ver is not null").unionByName(new.select(*versions.columns))


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the nodes of these ids and the edges that touch them: the one hard delete."""
    out = {}
    for name, t in tables.items():
        for c in ("id", *(x for x in ("src", "dst") if x in t.columns)):
            t = t.join(ids.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = t
    return out
