"""Hilbert-curve ordering: several metadata dimensions are quantised, documents sorted by their place on the curve, and runs cut.

Documents of equal text are one group and take the place of their first member (smallest doc_id), so that copies
stay side by side. The law is `bytes`: shards are cut where the running size passes a sixteenth of all sizes; a
group of at most 1/TOLERANCE of a shard is not cut, a larger one may be. Running sizes come from a range partitioning
(large groups spread by doc_id), one sum a partition, and a window in each partition.

A dimension of strings is quantised by the rank of the whole value among the distinct ones, sizes by their quantiles.

Size: UTF-8 bytes of the text (null: none) plus 1. Null metadata stand with the first values. Rows that repeat an id are
rows of their own. Null texts are a group apart from empty ones. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import lookup, materialize, read, running

SHARDS, BITS, TOLERANCE = 16, 4, 50


def hilbert(levels: tuple[int, ...], bits: int) -> int:
    """Place on the curve of a cell of the grid of 2**bits levels in each dimension."""
    x, n = list(levels), len(levels)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] ^ t) >> b & 1
    return place


def levels(groups: DataFrame, c: str, side: int) -> DataFrame:
    """(c, n, level): each value's place among the distinct values, in side steps; n groups have it. Null is not among them."""
    values = groups.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    ranked = materialize(running(values, [c], {"rank": "one"}), "levels")
    return ranked.join(F.broadcast(ranked.agg(F.count("*").alias("of"))), how="cross").select(c, "n", F.floor(F.col("rank") * side / F.col("of")).cast("int").alias("level"))  # of: one row


def shard_documents(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve. The text's length is a dimension besides dims."""
    spark, side = docs.sparkSession, 1 << bits
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    names = [f"m{i}" for i in range(len(dims))]
    crc = F.crc32(text.cast("binary"))
    fp = F.concat_ws(":", F.hex(F.xxhash64(text)), crc, size, F.col("text").isNull())
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("crc"), fp.alias("fp"), *[F.col(c).cast("string").alias(m) for c, m in zip(dims, names, strict=True)]), "slim")
    stats = slim.agg(F.sum("size").alias("total"), F.percentile_approx("size", [i / side for i in range(1, side)], 2000).alias("steps")).first()
    total = stats.total or 1
    tolerance = total // (shards * TOLERANCE)
    groups = slim.groupBy("fp").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"), F.min(F.struct("doc_id", *names, "size")).alias("first"))
    groups = materialize(groups.select("fp", "copies", "bytes", *[F.col(f"first.{m}").alias(m) for m in names], F.col("first.size").alias("one")), "groups")
    cell = sum(((F.col("one") > F.lit(b)).cast("int") for b in sorted(set(stats.steps or []))), F.lit(0)) * side ** len(names)
    for i, m in enumerate(names):
        groups = lookup(groups, levels(groups, m, side), m, "n", F.col("fp"))
        cell = cell + F.coalesce(F.col("level"), F.lit(0)) * side**i
        groups = groups.withColumn("cell", cell).drop("level")
        cell = F.col("cell")
    curve = [(c, hilbert(tuple(c // side**i % side for i in range(len(names) + 1)), bits)) for c in range(side ** (len(names) + 1))]
    groups = groups.withColumn("cell", cell).join(F.broadcast(spark.createDataFrame(curve, "cell int, curve int")), "cell").select("fp", "copies", "bytes", "curve")
    rows = lookup(slim.select("doc_id", "size", "crc", "fp"), groups, "fp", "copies", F.col("doc_id"))
    rows = rows.withColumn("spread", F.when(F.col("bytes") > tolerance, F.coalesce("doc_id", F.lit(-1))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, "curve", "fp", "spread").withColumn("pid", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("pid").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # a row for each partition
    before, offsets = (0, 0), []
    for r in sorted(sums, key=lambda r: r.pid):
        offsets.append((r.pid, *before))
        before = (before[0] + r.s, before[1] + r.n)
    placed = ranged.join(F.broadcast(spark.createDataFrame(offsets, "pid int, bytes_before long, rows_before long")), "pid")
    w = W.partitionBy("pid").orderBy("curve", "fp", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.col("bytes_before") + F.sum("size").over(w) - F.col("size")).withColumn("rank", F.col("rows_before") + F.count("*").over(w) - 1)
    start = F.min("at").over(W.partitionBy("pid", "curve", "fp"))
    placed = placed.withColumn("at", F.when(F.col("bytes") > tolerance, F.col("at")).otherwise(start))
    shard = F.least(F.lit(shards - 1), F.floor(F.col("at") / total * shards)).cast("int")
    placed = materialize(placed.select("doc_id", "size", "crc", "curve", "rank", shard.alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
