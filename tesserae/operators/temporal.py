"""Temporal reads: slices, history, diffs, timelines, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.model import FOREVER, TimeSlice, ranked


def at(versions: DataFrame, as_of: int | None = None, recorded_as_of: int | None = None) -> DataFrame:
    return versions.filter(TimeSlice(as_of, recorded_as_of).predicate())


def node(versions: DataFrame, id: str, **when: int) -> DataFrame:
    return at(versions.filter(F.col("id") == id), **when)


def node_version(versions: DataFrame, id: str, **when: int) -> DataFrame:
    return node(versions, id, **when).withColumn("revision", F.col("ver").cast("string"))


def node_content(versions: DataFrame, id: str, **when: int) -> DataFrame:
    return node(versions, id, **when).select("id", "body", "uri", "content_hash", "content_type")


def history(versions: DataFrame, id: str) -> DataFrame:
    return versions.filter(F.col("id") == id).withColumn("current", F.col("recorded_to") == FOREVER).orderBy("valid_from", "recorded_from", "ver")


def diff(versions: DataFrame, t1: int, t2: int, axis: str = "valid") -> DataFrame:
    """Rows that began or ended in (t1, t2]; on the valid axis, of current beliefs only."""
    inside = lambda c: (F.col(c) > t1) & (F.col(c) <= t2)
    rows = versions.filter(inside(f"{axis}_from") | inside(f"{axis}_to"))
    return rows.filter(F.col("recorded_to") == FOREVER) if axis == "valid" else rows


def change_points(*tables: DataFrame, axis: str = "valid") -> DataFrame:
    parts = [t.select(F.col(f"{axis}_from").alias("t")) for t in tables] + [t.select(F.col(f"{axis}_to").alias("t")).filter(F.col("t") < FOREVER) for t in tables]
    return reduce(DataFrame.unionAll, parts)


def timeline_extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def timeline_buckets(points: DataFrame, start: int, end: int, buckets: int = 240) -> DataFrame:
    """Counts of change points in [start, end] for each of the buckets, empty ones too."""
    b, span = min(1000, max(1, buckets)), end - start
    slot = F.lit(0).cast("long") if span <= 0 else F.greatest(F.lit(0).cast("long"), F.least(F.lit(b - 1).cast("long"), F.expr(f"(t - {start}L) * {b} div {span}L")))
    counts = points.filter((F.col("t") >= start) & (F.col("t") <= end)).groupBy(slot.alias("bucket")).agg(F.count("*").alias("n"))
    return points.sparkSession.range(b).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def timeline_ticks(points: DataFrame, cap: int) -> DataFrame:
    """Distinct instants; above cap every k-th by rank with both ends."""
    t = points.select("t").distinct()
    n = t.count()
    if n <= cap:
        return t
    if cap == 1:
        return t.agg(F.max("t").alias("t"))
    k = -(-(n - 1) // (cap - 1))
    return ranked(t, ["t"], "rn").filter((F.col("rn") % k == 0) | (F.col("rn") == n - 1)).select("t")


def latest_instant(versions: DataFrame) -> DataFrame:
    closed = F.max(F.when(F.col("valid_to") < FOREVER, F.col("valid_to")))
    return versions.agg(F.greatest(F.max("valid_from"), closed, F.max("recorded_from")).alias("t"))


def overlaps(versions: DataFrame) -> DataFrame:
    """Ids with more than one live row."""
    return at(versions).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def repair_overlaps(versions: DataFrame, when: int) -> DataFrame:
    """Live rows but the one of the highest ver are closed on the recorded axis."""
    live = TimeSlice().predicate()
    rank = F.row_number().over(W.partitionBy("id", live).orderBy(F.desc("ver")))
    return versions.withColumn("_rn", F.when(live, rank)).withColumn("recorded_to", F.when(F.col("_rn") > 1, F.lit(when)).otherwise(F.col("recorded_to"))).drop("_rn")


def backfill_recorded(versions: DataFrame) -> DataFrame:
    return versions.withColumn("recorded_from", F.when(F.col("recorded_from") == 0, F.col("valid_from")).otherwise(F.col("recorded_from")))
