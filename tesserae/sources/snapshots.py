"""Snapshot directories with manifests: a commit is the exclusive appearance of the next manifest.

A manifest is written aside and renamed to its number without overwriting, so that a reader sees whole manifests only and
of two writers of one number one fails. Version tables are kept as live and history parts; a table may have tombstones,
ids that reads leave out.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import LIVE

AXES = {"valid_to", "recorded_to"}
EXISTS = ("FileAlreadyExistsException", "already exists")


class SnapshotConflict(RuntimeError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def head(spark: SparkSession, root: str) -> int:
    """Number of the last snapshot, 0 if there is none."""
    fs, p = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])


def manifest(spark: SparkSession, root: str, n: int) -> dict:
    text = spark.read.text(f"{root}/manifests/{n:012d}.json", wholetext=True).first()
    return json.loads(text[0])


def _publish(spark: SparkSession, root: str, n: int, body: dict) -> None:
    aside = f"{root}/manifests/.{n:012d}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, aside)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(p, jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{n:012d}.json"), none)
    except Py4JJavaError as e:
        fs.delete(p, False)
        if any(x in str(e.java_exception) for x in EXISTS):
            raise SnapshotConflict(f"snapshot {n} exists") from e
        raise


def commit(spark: SparkSession, root: str, dirty: dict[str, DataFrame], base: int, tombstones: dict[str, DataFrame] | None = None) -> int:
    """Writes the dirty tables and the next manifest; raises SnapshotConflict if another commit came between."""
    n = base + 1
    old = manifest(spark, root, base) if base else {"tables": {}}
    tables, gone = dict(old["tables"]), dict(old.get("tombstones", {}))
    for name, df in dirty.items():
        path = f"{root}/tables/{name}/{n:012d}-{uuid.uuid4().hex}"
        order = [c for c in ("id", "valid_from") if c in df.columns]
        parts = {"live": df.filter(LIVE.predicate()), "history": df.filter(~LIVE.predicate())} if set(df.columns) >= AXES | {"valid_from", "recorded_from"} else {"all": df}
        for part, rows in parts.items():
            (rows.sortWithinPartitions(*order) if order else rows).write.option("compression", "zstd").parquet(f"{path}/{part}")
        tables[name] = [f"{path}/{part}" for part in parts]
        gone.pop(name, None)
    for name, ids in (tombstones or {}).items():
        path = f"{root}/tombstones/{name}/{n:012d}-{uuid.uuid4().hex}"
        ids.select("id").distinct().write.option("compression", "zstd").parquet(path)
        gone[name] = [*gone.get(name, []), path]
    _publish(spark, root, n, {"snapshot": n, "tables": tables, "tombstones": gone})
    return n


def retried(spark: SparkSession, root: str, change: Callable[[int], dict[str, DataFrame]], attempts: int = 50, wait: float = 0.05) -> int:
    """Commits change(head), which reads what it needs from that snapshot; again from the new head on a conflict."""
    for attempt in range(attempts):
        base = head(spark, root)
        try:
            return commit(spark, root, change(base), base)
        except SnapshotConflict:
            if attempt == attempts - 1:
                raise
            time.sleep(random.uniform(0, wait * min(2**attempt, 64)))
    raise AssertionError("unreachable")


def read(spark: SparkSession, root: str, table: str, n: int | None = None, part: str | None = None) -> DataFrame:
    """A table as of a snapshot, parts joined by column names; with part `live`, only that one."""
    m = manifest(spark, root, n or head(spark, root))
    paths = [p for p in m["tables"][table] if part is None or p.endswith(f"/{part}")]
    df = spark.read.parquet(paths[0])
    for p in paths[1:]:
        df = df.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    for p in m.get("tombstones", {}).get(table, []):
        df = df.join(spark.read.parquet(p).select(F.col("id")), "id", "left_anti")
    return df
