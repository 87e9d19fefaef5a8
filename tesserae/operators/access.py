"""Relationship-based access: granted sets by fixpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.model import FOREVER, LIVE, TimeSlice, persisted
from tesserae.operators.scan import page
from tesserae.operators.write import fresh, supersede


@dataclass(frozen=True)
class Relation:
    """Who has it: own tuples and computed relations (any), all of `both`, none of `minus`; via = (tupleset, relation)."""

    any: tuple[str, ...] = ()
    both: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    via: tuple[tuple[str, str], ...] = ()


def check_model(model: dict[str, Relation]) -> list[str]:
    """Relations in an order in which what a relation subtracts or intersects comes first; raises on a cycle through them."""
    for name, r in model.items():
        for other in (*r.any, *r.both, *r.minus, *(x for v in r.via for x in v)):
            if other not in model:
                raise ValueError(f"{name} names {other}, which is not a relation")
    order: list[str] = []

    def visit(n: str, above: tuple[str, ...]) -> None:
        if n in above:
            raise ValueError(f"{n} depends on its own exclusion")
        if n not in order:
            for other in (*model[n].both, *model[n].minus):
                visit(other, (*above, n))
            order.append(n)

    for n in model:
        visit(n, ())
    return order


def strata(model: dict[str, Relation], usersets: list[tuple[str, str]] = ()) -> list[list[str]]:
    """Relations in layers: what a relation intersects with or subtracts lies in layers before it, what it follows from no
    later than it. usersets: pairs (relation, relation of its subjects) that the tuples have. Raises on a cycle through those."""
    check_model(model)
    follows = {n: {*r.any, *(rel for _, rel in r.via), *(x for m, x in usersets if m == n and x in model)} for n, r in model.items()}
    layer = dict.fromkeys(model, 0)
    changed = True
    while changed:
        changed = False
        for n, r in model.items():
            need = max([layer[n], *(layer[x] for x in follows[n]), *(layer[x] + 1 for x in (*r.both, *r.minus))])
            if need > len(model):
                raise ValueError(f"{n} depends on its own exclusion")
            changed |= need != layer[n]
            layer[n] = need
    return [[n for n in model if layer[n] == k] for k in range(max(layer.values(), default=-1) + 1)]


def granted(tuples: DataFrame, model: dict[str, Relation]) -> DataFrame:
    """(object, relation, subject) that hold. tuples: object, relation, subject, subject_relation (null: the subject itself).

    Layer by layer, each to its fixpoint: a relation follows from own tuples, usersets, computed relations and those of
    parents, of all that holds, and what it subtracts or must have besides is complete by then."""
    check_model(model)
    tuples = persisted(tuples.select("object", "relation", "subject", "subject_relation").distinct())  # read in every round
    spark = tuples.sparkSession
    named = tuples.filter("subject_relation is not null")
    pairs = [(r.relation, r.subject_relation) for r in named.select("relation", "subject_relation").distinct().collect() if r.relation in model]  # names of relations
    sets = named.select(F.col("object").alias("o"), F.col("relation").alias("r"), F.col("subject").alias("via_object"), F.col("subject_relation").alias("via_relation"))
    through = [(n, t, rel) for n, r in model.items() for t, rel in r.via]
    if through:  # (child, to) has whoever has via_relation of the parent
        ttu = F.broadcast(spark.createDataFrame(through, "to string, tupleset string, via_relation string"))  # the model's
        parents = tuples.join(ttu, F.col("relation") == F.col("tupleset")).select(F.col("object").alias("o"), F.col("to").alias("r"), F.col("subject").alias("via_object"), "via_relation")
        sets = sets.unionByName(parents)
    sets = persisted(sets.distinct())
    cols = ["object", "relation", "subject"]
    held = None
    for layer in strata(model, pairs):
        computed = [(a, n) for n in layer for a in model[n].any]

        def follow(rows: DataFrame, layer=layer, computed=computed) -> DataFrame:
            out = rows.join(sets.filter(F.col("r").isin(*layer)), (F.col("object") == F.col("via_object")) & (F.col("relation") == F.col("via_relation"))).select(F.col("o").alias("object"), F.col("r").alias("relation"), "subject")
            if computed:
                table = F.broadcast(spark.createDataFrame(computed, "relation string, to string"))  # the model's
                out = out.unionByName(rows.join(table, "relation").select("object", F.col("to").alias("relation"), "subject"))
            return out

        def allowed(rows: DataFrame, layer=layer, held=held) -> DataFrame:
            for n in layer:
                for other in model[n].minus:
                    rows = rows.join(held.filter(F.col("relation") == other).select("object", F.lit(n).alias("relation"), "subject"), cols, "left_anti")
                for other in model[n].both:
                    both = held.filter(F.col("relation") == other).select("object", F.lit(n).alias("relation"), "subject")
                    rows = rows.filter(F.col("relation") != n).unionByName(rows.filter(F.col("relation") == n).join(both, cols, "left_semi"))
            return rows.select(*cols)

        first = tuples.filter("subject_relation is null").filter(F.col("relation").isin(*layer)).select(*cols)
        if held is not None:
            first = first.unionByName(follow(held))
        front = mine = persisted(allowed(first.distinct()))
        while not front.isEmpty():
            front = persisted(allowed(follow(front).distinct()).join(mine, cols, "left_anti"))
            mine = mine.unionByName(front)
        held = persisted(mine if held is None else held.unionByName(mine))
    return tuples.select(*cols).limit(0) if held is None else held


def list_objects(held: DataFrame, relation: str, subject: str, limit: int = 100, cursor: str | None = None) -> DataFrame:
    objects = held.filter((F.col("relation") == relation) & (F.col("subject") == subject)).select("object").distinct()
    return page(objects, ["object"], limit, cursor)


def as_tuples(edges: DataFrame, when: int | None = None) -> DataFrame:
    """(object, relation, subject, subject_relation) of the edges subject -> object that are believed now to hold at an instant."""
    held = edges.filter(TimeSlice(as_of=when).predicate())
    return held.select(F.col("dst").alias("object"), F.col("rel").alias("relation"), F.col("src").alias("subject"), F.get_json_object("data", "$.subjectRelation").alias("subject_relation"))


def check(held: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (object, relation, subject) with whether they hold."""
    return asks.join(held.withColumn("_held", F.lit(True)), ["object", "relation", "subject"], "left").withColumn("allowed", F.coalesce("_held", F.lit(False))).drop("_held")


def write_tuples(edges: DataFrame, tuples: DataFrame, now: int) -> DataFrame:
    """edges with the tuples (id, object, relation, subject, subject_relation) that no live edge says yet."""
    known = as_tuples(edges)
    cols = ("object", "relation", "subject", "subject_relation")
    same = F.lit(True)
    for c in cols:
        same = same & tuples[c].eqNullSafe(known[c])
    new = tuples.dropDuplicates(list(cols)).join(known, same, "left_anti")
    data = F.when(F.col("subject_relation").isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(F.col("subject_relation").alias("subjectRelation"))))
    rows = new.select("id", F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("relation").alias("rel"), F.lit(1.0).alias("weight"), data.alias("data"))
    return edges.unionByName(fresh(rows, edges, now))


def revoke_tuples(edges: DataFrame, tuples: DataFrame, now: int) -> DataFrame:
    """edges whose live ones that say the tuples hold no longer from now; that they did is kept. Tuples that no edge says do nothing."""
    live = edges.filter(LIVE.predicate()).withColumn("_r", F.get_json_object("data", "$.subjectRelation"))
    same = (live["dst"] == tuples["object"]) & (live["rel"] == tuples["relation"]) & (live["src"] == tuples["subject"]) & live["_r"].eqNullSafe(tuples["subject_relation"])
    hit = persisted(live.join(tuples, same, "left_semi").select("id", "valid_from", "recorded_from"))
    at = F.greatest(F.lit(now).cast("long"), F.col("valid_from") + 1, F.col("recorded_from") + 1)
    return supersede(edges, hit.select("id", at.alias("from"), F.lit(FOREVER).cast("long").alias("to"), F.lit(True).alias("retract"), F.lit(None).cast("string").alias("data")), now)


def expand(tuples: DataFrame, model: dict[str, Relation], object: str, relation: str) -> dict:
    """The tree of who has a relation: leaves with subjects and usersets, unions, intersections, exclusions. A relation met
    again on its own path is an empty leaf. Reads the tuples of the objects on the tree, level by level."""
    check_model(model)
    known: dict[str, list] = {}

    def fetch(objects: set[str]) -> None:
        objects -= set(known)
        while objects:
            rows = tuples.filter(F.col("object").isin(*objects)).collect()
            for o in objects:
                known[o] = [r for r in rows if r.object == o]
            sets = {t for r in model.values() for t, _ in r.via}
            objects = {r.subject for r in rows if r.relation in sets} - set(known)

    def leaf(o: str, r: str) -> dict:
        mine = [t for t in known.get(o, []) if t.relation == r]
        return {"type": "leaf", "subjects": sorted(t.subject for t in mine if t.subject_relation is None), "usersets": sorted(f"{t.subject}#{t.subject_relation}" for t in mine if t.subject_relation is not None)}

    def tree(o: str, r: str, above: tuple) -> dict:
        if (o, r) in above:
            return {"type": "leaf", "subjects": [], "usersets": []}
        d, here = model[r], (*above, (o, r))
        children = [leaf(o, r), *(tree(o, x, here) for x in d.any)]
        for tupleset, computed in d.via:
            parents = sorted(t.subject for t in known.get(o, []) if t.relation == tupleset)
            children.append({"type": "union", "children": [tree(p, computed, here) for p in parents]})
        out = {"type": "union", "children": children} if len(children) > 1 else children[0]
        if d.both:
            out = {"type": "intersection", "children": [out, *(tree(o, x, here) for x in d.both)]}
        for x in d.minus:
            out = {"type": "exclusion", "base": out, "subtract": tree(o, x, here)}
        return out

    fetch({object})
    return tree(object, relation, ())


#: Roles in a tenant, the weaker first.
ROLES = ("viewer", "editor", "owner")


def role_checks(members: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (tenant, user, role) with status: 200 if the user has the role or a stronger one, 403 if a weaker one, 404 if the
    user is not of the tenant. members: (tenant, user, role)."""
    level = lambda c: sum((F.when(F.col(c) == r, i + 1).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
    best = members.groupBy("tenant", "user").agg(F.max(level("role")).alias("_has"))
    j = asks.join(best, ["tenant", "user"], "left")
    return j.select("tenant", "user", "role", F.when(F.col("_has").isNull(), 404).when(F.col("_has") >= level("role"), 200).otherwise(403).alias("status"))
