"""Queries over contests, titles and recipes: leaderboards, meetings, holders of a title, cheapest routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.model import persisted


def leaderboard(nodes: DataFrame, metric: str, allowed: tuple[str, ...], limit: int = 25) -> DataFrame:
    """(id, name, value) by value, ties by name, of nodes whose data has a number under `derived`; at most 200."""
    if metric not in allowed:
        raise ValueError(f"the metric is one of {', '.join(allowed)}")
    value = F.try_variant_get(F.try_parse_json("data"), f"$.derived.{metric}", "double")
    rows = nodes.select("id", F.get_json_object("data", "$.name").alias("name"), value.alias("value")).filter("value is not null")
    return rows.orderBy(F.desc("value"), "name", "id").limit(min(limit, 200))


def head_to_head(entries: DataFrame, a: str, b: str) -> DataFrame:
    """(contest, a_result, b_result): contests in which both took part. entries: (contest, who, result)."""
    side = lambda who, name: entries.filter(F.col("who") == who).select("contest", F.col("result").alias(name))
    return side(a, "a_result").join(side(b, "b_result"), "contest")


def holders(changes: DataFrame, as_of: int | None = None) -> DataFrame:
    """(title, holder, since): who held each title at an instant. changes: (title, holder, t); the last one up to then counts,
    and a null holder leaves the title vacant."""
    rows = changes.filter(F.col("t") <= as_of) if as_of is not None else changes
    last = rows.groupBy("title").agg(F.max(F.struct("t", "holder")).alias("m"))
    return last.select("title", F.col("m.holder").alias("holder"), F.col("m.t").alias("since"))


def reigns(changes: DataFrame) -> DataFrame:
    """(title, holder, since, until): every reign, until the next change of the title (null: it lasts)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("title").orderBy("t", "holder")
    return changes.select("title", "holder", F.col("t").alias("since"), F.lead("t").over(w).alias("until"))


def cheapest_routes(prices: DataFrame, reactions: DataFrame, inputs: DataFrame, outputs: DataFrame, by: str = "cost") -> DataFrame:
    """(id, cost, steps, via): what each substance costs at best, bought or made, and the reaction that makes it.

    prices: (id, price); reactions: (reaction, yield); inputs: (reaction, id, stoich); outputs: (reaction, id). A reaction
    needs all its inputs; its product costs sum(stoich * cost) / yield and one step more than its longest input. `by` is
    what is least, cost or steps, the other one breaks ties. Rounds go on until nothing improves."""
    if by not in ("cost", "steps"):
        raise ValueError(f"least {by!r} is neither cost nor steps")
    key = (lambda c, s: F.struct(c, s)) if by == "cost" else (lambda c, s: F.struct(s, c))
    inputs, outputs = persisted(inputs.select("reaction", "id", "stoich")), persisted(outputs.select("reaction", "id").distinct())
    need = persisted(inputs.groupBy("reaction").agg(F.count("*").alias("need")).join(reactions.select("reaction", "yield"), "reaction"))
    best = persisted(prices.filter("price is not null").select("id", F.col("price").cast("double").alias("cost"), F.lit(0).alias("steps"), F.lit(None).cast("string").alias("via")))
    while True:
        made = inputs.join(best, "id").groupBy("reaction").agg(F.count("*").alias("n"), F.sum(F.col("stoich") * F.col("cost")).alias("sum"), (F.max("steps") + 1).alias("steps"))
        made = made.join(need, "reaction").filter("n = need").select("reaction", F.round(F.col("sum") / F.col("yield"), 9).alias("cost"), "steps")
        tried = made.join(outputs, "reaction").select("id", "cost", "steps", F.col("reaction").alias("via"))
        new = tried.groupBy("id").agg(F.min(F.struct(key(F.col("cost"), F.col("steps")).alias("k"), "via", "cost", "steps")).alias("m")).select("id", "m.cost", "m.steps", "m.via")
        old = best.select("id", F.col("cost").alias("c0"), F.col("steps").alias("s0"))
        less = (F.col("cost") < F.col("c0") - 1e-9) | ((F.abs(F.col("cost") - F.col("c0")) <= 1e-9) & (F.col("steps") < F.col("s0")))
        if by == "steps":
            less = (F.col("steps") < F.col("s0")) | ((F.col("steps") == F.col("s0")) & (F.col("cost") < F.col("c0") - 1e-9))
        better = persisted(new.join(old, "id", "left").filter(F.col("c0").isNull() | less).select("id", "cost", "steps", "via"))
        if better.isEmpty():
            return best
        best = persisted(best.join(better.select("id"), "id", "left_anti").unionByName(better))
