"""Schema evolution at read time: data written under an older shape is read in the newest one; storage is not touched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.model import FOREVER, LIVE


@dataclass(frozen=True)
class Chain:
    """Shapes of a type's data by version (DDL, from version 1) and the steps from each to the next, on structs."""

    shapes: tuple[str, ...]
    steps: tuple[Callable[[Column], Column], ...] = ()

    def __post_init__(self) -> None:
        if not self.shapes or len(self.steps) != len(self.shapes) - 1:
            raise ValueError("a chain needs a shape and one step between neighbouring shapes")

    @property
    def current(self) -> int:
        return len(self.shapes)

    def newest(self, data: Column, version: Column) -> Column:
        """The struct of the newest shape, whatever version wrote the data."""
        out = None
        for v, shape in enumerate(self.shapes, 1):
            value = F.from_json(data, shape)
            for step in self.steps[v - 1 :]:
                value = step(value)
            value = value.cast(f"struct<{_fields(self.shapes[-1])}>")
            out = F.when(version == v, value) if out is None else out.when(version == v, value)
        return out


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def stored_version(data: Column) -> Column:
    """The number under _v; 1 where it is missing, not a whole number or below 1."""
    v = F.from_json(data, "_v long")["_v"]
    return F.when(v >= 1, v).otherwise(F.lit(1).cast("long"))


def _newest(rows: DataFrame, chains: dict[str, Chain], stamp: bool) -> Column:
    version = stored_version(F.col("data"))
    out = F.col("data")
    for kind, chain in chains.items():
        value = chain.newest(F.col("data"), version)
        value = F.to_json(value.withField("_v", F.lit(chain.current)) if stamp else value)
        newer = F.raise_error(F.concat(F.lit(f"{kind}: stored version "), version.cast("string"), F.lit(f" is newer than {chain.current}")))
        out = F.when((F.col("type") == kind) & F.col("data").isNotNull(), F.when(version > chain.current, newer.cast("string")).otherwise(value)).otherwise(out)
    return out


def upcast(rows: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """rows (type, data, ...) with data in the newest shape, without _v. Types without a chain, and null data, stay as
    they are; data from a version newer than the chain fails the read."""
    return rows.withColumn("data", _newest(rows, chains, False))


def upcast_report(versions: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """(type, current, live, behind) for every type with a chain, those without live rows too."""
    spark = versions.sparkSession
    known = spark.createDataFrame([(k, c.current) for k, c in chains.items()], "type string, current int")
    live = versions.filter(LIVE.predicate()).select("type", stored_version(F.col("data")).alias("v"))
    joined = F.broadcast(known).join(live, "type").groupBy("type", "current").agg(F.count("*").alias("live"), F.count_if(F.col("v") < F.col("current")).alias("behind"))
    return known.join(joined.drop("current"), "type", "left").fillna(0, ["live", "behind"])


def upcast_writes(versions: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """Writes for supersede() that bring live rows below their type's version up to it, over their own valid interval:
    the fact's dates stay, only recorded time moves."""
    current = None
    for kind, chain in chains.items():
        current = F.when(F.col("type") == kind, chain.current) if current is None else current.when(F.col("type") == kind, chain.current)
    behind = versions.filter(LIVE.predicate()).filter(F.col("type").isin(*chains) & (stored_version(F.col("data")) < current))
    return behind.select("id", F.col("valid_from").alias("from"), F.lit(FOREVER).alias("to"), F.lit(False).alias("retract"), _newest(behind, chains, True).alias("data"))
