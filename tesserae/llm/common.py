"""Helpers that the training-data operators share: shared storage, skew-safe lookups, components, shingles."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a looked-up table that are broadcast: its keys with the most rows. A bound by construction.
HOT_KEYS = 1024
#: Intermediate tables after which the driver's JVM is asked to collect what it no longer uses, and to give memory back.
COLLECT_EVERY, TRIM_EVERY = 12, 2
#: No marker file beside what only this program reads, after the write has returned.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or setCheckpointDir(); one of our own only where both are unset (local runs, tests)."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if said:
        return said.rstrip("/")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tesserae-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**NO_MARK).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    made = len(_written[spark.sparkContext.applicationId])
    if made % COLLECT_EVERY == 0:
        # many plans, each with generated classes, broadcasts and shuffles of its own, pile up in the driver otherwise
        spark.sparkContext._jvm.System.gc()
    if made % TRIM_EVERY == 0:
        trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more: what was made of them has been materialized itself."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes what materialize() wrote in this application: for a caller whose results have been taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lookup(big: DataFrame, small: DataFrame, key: str | list[str], count: str, spread: Column) -> DataFrame:
    """big left join small on key (one column or more). small has one row a key; count says how many rows of big have it.

    The HOT_KEYS most frequent keys are broadcast and their rows of big are dealt by spread, so that
    no key with many rows meets in one task. Null keys match nothing.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in small.columns if c not in (*keys, count)]
    hot = small.orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS).select(*keys, F.struct(*values).alias("_hot"))
    salt = F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int") + 1
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull() & known, F.lit(0)).otherwise(salt))
    # pmod(hash, 1) is 0 for every row, but no constant that the optimizer would fold out of the join key
    cold = small.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int").alias("_salt"), F.struct(*values).alias("_cold"))
    out = dealt.join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*[F.col(c) for c in big.columns], *[F.col(f"_found.{c}").alias(c) for c in values])


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, by new name, the sum of a column over all rows before a row in that order (exact for whole numbers).

    Rows are dealt by ranges and written; one sum for each range comes to the driver; a window runs in each range.
    Rows equal in order fall into one range: give an order that tells rows apart where many may be equal."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    names = list(sums)
    totals = ranged.groupBy("_range").agg(*[F.sum(sums[n]).alias(n) for n in names]).collect()  # a row for each range
    before: list = [0.0 if ranged.schema[sums[n]].dataType.typeName() == "double" else 0 for n in names]
    rows = []
    for r in sorted(totals, key=lambda r: r["_range"]):
        rows.append((r["_range"], *before))
        before = [b + r[n] for b, n in zip(before, names, strict=True)]
    kinds = {n: "double" if ranged.schema[sums[n]].dataType.typeName() == "double" else "long" for n in names}
    starts = spark.createDataFrame(rows, "_range int, " + ", ".join(f"_at_{n} {kinds[n]}" for n in names))
    w = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range")
    for n in names:
        out = out.withColumn(n, F.col(f"_at_{n}") + F.coalesce(F.sum(sums[n]).over(w), F.lit(0)))
    return out.drop("_range", *[f"_at_{n}" for n in names])


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with rows of equal keys (not null) numbered from 0, however many they are: each task numbers its own."""
    rows = materialize(df.withColumn("_task", F.spark_partition_id()).withColumn("_serial", F.monotonically_increasing_id()), "rows")
    tasks = rows.groupBy(*keys, "_task").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*keys, "_task").orderBy("_serial")) - 1
    return rows.withColumn("_own", own).join(tasks, [*keys, "_task"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_task", "_serial", "_own", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id in edges (a long, b long): the smallest id that links reach.

    Each round hooks every node to its neighbour of the smallest hash and contracts; hash order keeps
    chains short, so the rounds grow with the logarithm of the longest path.
    """
    empty = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).limit(0)
    e = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    found: DataFrame | None = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("i"))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("m"), F.count("*").alias("n"))
        hook = materialize(hook.select(F.col("a").alias("id"), F.least(F.col("m"), order("a"))["i"].alias("to"), "n"), "hook")
        if found is None:
            found = hook.select("id", F.col("to").alias("root"))
        else:
            sizes = found.groupBy("root").agg(F.count("*").alias("n"))
            step = hook.select(F.col("id").alias("root"), "to").join(sizes, "root")
            found = lookup(found, step, "root", "n", F.col("id")).select("id", F.coalesce("to", "root").alias("root"))
        found = materialize(found, "roots")
        moved = lookup(e, hook.select(F.col("id").alias("a"), F.col("to").alias("ta"), "n"), "a", "n", F.col("b"))
        moved = lookup(moved, hook.select(F.col("id").alias("b"), F.col("to").alias("tb"), "n"), "b", "n", F.col("a"))
        e = materialize(moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if found is None:
        return empty
    least = found.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    return lookup(found, least, "root", "n", F.col("id")).select("id", "component_id")


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence.

    bytes.lower() lowers A-Z only and bytes.split() parts at x20 and x09-x0D only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        acc = (acc ^ h[i : len(h) - k + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def mix(*parts: np.ndarray | int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(int(p).to_bytes(8, "little", signed=int(p) < 0) for p in parts))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, size: int = 4096) -> DataFrame:
    """mapInArrow with rows as dicts; at most size rows are held for output."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                for lo in range(0, b.num_rows, 256):
                    part = {n: c.slice(lo, 256).to_pylist() for n, c in cols.items()}
                    for row in zip(*part.values(), strict=True):
                        yield dict(zip(part, row, strict=True))

        held: list[dict] = []
        for row in fn(rows()):
            held.append(row)
            if len(held) >= size:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that this process no longer uses back to the system, where that can be asked for: Python workers stay,
    idle, beside the executor's next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap back to the system; False where this JVM cannot.

    The compilers and buffers of many plans take and free memory in many threads, and glibc keeps it for each of them. The
    command is HotSpot's System.trim_native_heap; it goes by reflection, as the server's class is not open to py4j."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)
    except Py4JJavaError:  # another JVM, an older one or another C library
        return False
    return True


class Forest:
    """Union-find over the ids of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
