"""Bitemporal version rows: sentinels, time slices, shared storage for iterative plans."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Open end of an interval, in epoch milliseconds (fixed value).
FOREVER = 8640000000000000

NODE_SCHEMA = "ver long, id string, type string, body string, uri string, content_hash string, content_type string, data string, valid_from long, valid_to long, recorded_from long, recorded_to long"
EDGE_SCHEMA = "ver long, id string, src string, dst string, rel string, weight double, data string, source string, valid_from long, valid_to long, recorded_from long, recorded_to long"
_own: dict[str, str] = {}


@dataclass(frozen=True)
class TimeSlice:
    """Instants on the valid and the recorded axis; None, or FOREVER and later, means now."""

    as_of: int | None = None
    recorded_as_of: int | None = None

    def __post_init__(self) -> None:
        for t in (self.as_of, self.recorded_as_of):
            if t is not None and (isinstance(t, bool) or not isinstance(t, int)):
                raise ValueError("instants are whole epoch milliseconds")

    def predicate(self) -> Column:
        def axis(name: str, t: int | None) -> Column:
            if t is None or t >= FOREVER:
                return F.col(f"{name}_to") == FOREVER
            return (F.col(f"{name}_from") <= t) & (F.col(f"{name}_to") > t)

        return axis("valid", self.as_of) & axis("recorded", self.recorded_as_of)


LIVE = TimeSlice()


_written: dict[str, list[str]] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or setCheckpointDir(); one of our own only where both are unset (local runs, tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (base or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tesserae-"))).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tesserae-")) / f"{root.name}.zip"  # on the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def persisted(df: DataFrame) -> DataFrame:
    """Writes a round of an iterative plan to the shared folder and reads it back, so that its lineage ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what persisted() wrote in this application: for a caller whose results have been taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with the place of each row, from 0, in that order: ranges, a count a range, a window in each range."""
    parts = persisted(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, rows = 0, []
    for r in sorted(parts.groupBy("_range").count().collect(), key=lambda r: r["_range"]):  # a row for each range
        rows.append((r["_range"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(rows, "_range int, _before long")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return parts.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def register_views(nodes: DataFrame, edges: DataFrame) -> None:
    """Temporary views `nodes` and `edges` of what is live now, for SQL."""
    nodes.filter(LIVE.predicate()).createOrReplaceTempView("nodes")
    edges.filter(LIVE.predicate()).createOrReplaceTempView("edges")
