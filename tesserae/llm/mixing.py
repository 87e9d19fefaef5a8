"""Mixing sources to target weights by capped water-filling.

Sources, by code point with null last, have weights that repeat from a list. A budget (a share of all sizes) is
poured by weight; a source is clamped at max_epochs times its size and its excess goes to the others by weight until
none is above. Of each source every document is taken floor(target / size) times, and the rest of the target is
met by documents taken once more in the order of a seeded hash, up to the document that crosses the target if that
comes nearer. The order's threshold is found from sizes by hash bucket; only the bucket it falls in is sorted. Sources
stay in Spark, however many they are: the water's level is found by running sums over them.

Size: number of words [^\\x20\\x09-\\x0D]+ (null text: 0). Rows that repeat an id share their hash and are told apart by
their size and text; rows equal in id, source and text are one group, of which the target may part some from others.
Documents without words take 0. Empty table: no rows. Other columns, whatever their names, are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import lookup, materialize, numbered, read, running

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
#: Hash buckets of a source. Equal rows that one task makes at once.
BUCKETS, RUN = 4096, 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def water_fill(sizes: list[float], weights: list[float], total: float, epochs: float) -> list[float]:
    """Targets: total dealt by weight, none above epochs * size, what is above dealt again by weight."""
    caps = [epochs * s for s in sizes]
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), min(total, sum(caps))
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if per * weights[i] >= caps[i]]
        if not full:
            for i in free:
                targets[i] = per * weights[i]
            break
        for i in full:
            targets[i] = caps[i]
            left -= caps[i]
        free = [i for i in free if i not in set(full)]
    return targets


def with_targets(sources: DataFrame, weights: tuple, share: float, epochs: float) -> DataFrame:
    """sources (source, s: size, documents) with target: the same as water_fill, by running sums, for any number of sources."""
    ranked = running(sources.withColumn("null", F.col("source").isNull()).withColumn("one", F.lit(1)), ["null", "source"], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "s", "documents", "null", weight.alias("w"), (F.col("s") / weight).alias("full")).withColumn("cap", epochs * F.col("s"))
    # those with the smallest caps for their weights are full first
    order = running(ranked, ["full", "null", "source"], {"caps": "cap", "ws": "w", "k": "documents"})
    order = materialize(order, "order")
    sums = order.agg(F.sum("s").alias("s"), F.sum("w").alias("w")).first()
    total = min(share * (sums.s or 0), epochs * (sums.s or 0))
    per = (F.lit(float(total)) - F.col("caps")) / (F.lit(float(sums.w or 0)) - F.col("ws"))
    level = order.filter(per * F.col("w") < F.col("cap")).agg(F.min_by(per, F.struct("full", "null", "source")).alias("level")).first().level
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return order.select("source", F.col("s").alias("source_size"), "documents", target.alias("target"))


def plan(docs: DataFrame, size: Column, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row for each (doc_id, source, same, size): its n equal rows, source_size, target, and how often they are taken:
    `more` of them whole + 1 times, the others whole times. same: the text's hash."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("same"), size.alias("size"), key.alias("u"))
    groups = materialize(rows.groupBy("doc_id", "source", "same", "size", "u").agg(F.count("*").alias("n")), "sizes")
    sources = materialize(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.count("*").alias("documents")), "sources")
    t = with_targets(sources, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    t = t.select(*named_source(F.col("source")), "documents", F.col("documents").alias("of"), "source_size", "target", "whole", "extra")
    d = groups.select(*groups.columns, *named_source(F.col("source")))
    d = materialize(lookup(d, t, ["_s", "_null"], "documents", F.struct("doc_id", "same")), "targets")
    d = d.withColumn("bucket", F.shiftrightunsigned("u", 48 - BUCKETS.bit_length() + 1))
    # of each source, the bucket in which the running size meets what is to be taken once more
    sums = d.groupBy("_s", "_null", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.first("extra").alias("extra"), F.first("of").alias("documents"))
    run = sums.withColumn("before", F.sum("b").over(W.partitionBy("_s", "_null").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    run = run.withColumn("before", F.coalesce("before", F.lit(0))).filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("b") >= F.col("extra")))
    d = lookup(d.drop("of"), run.select("_s", "_null", F.col("bucket").alias("cut"), "before", "documents"), ["_s", "_null"], "documents", F.struct("doc_id", "same"))
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    order = W.partitionBy("_s", "_null").orderBy("u", "doc_id", "size", "same").rowsBetween(W.unboundedPreceding, -1)
    edge = d.filter(at_cut).withColumn("left", F.col("extra") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    # the j-th equal row crosses the target and comes nearer by it if 2 * j * size - size <= 2 * left
    taken = F.when(F.col("size") > 0, F.floor((2 * F.col("left") + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(F.col("left") >= 0, F.col("n")).otherwise(F.lit(0)))
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), taken)).cast("long"))
    rest = d.filter(~at_cut).withColumn("more", F.when(F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)), F.col("n")).otherwise(F.lit(0)).cast("long"))
    cols = ["doc_id", "source", "same", "size", "n", "source_size", "target", "whole", "more"]
    return edge.select(*cols).unionByName(rest.select(*cols))


def named_source(c: Column) -> list[Column]:
    """A source as two columns without nulls."""
    return [F.coalesce(c, F.lit("")).alias("_s"), c.isNull().alias("_null")]


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, same, size, source_size, target, copies for every row of docs."""
    p = plan(docs, word_count(F.col("text")))
    many = p.filter(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("doc_id", "run")
    some = p.filter(F.col("n") <= RUN).withColumn("run", F.lit(0).cast("long")).unionByName(many)
    first = F.col("run") * RUN
    some = some.withColumn("j", F.explode(F.sequence(first, F.least(F.col("n"), first + RUN) - 1)))
    return some.select("doc_id", "source", "same", "size", "source_size", "target", (F.col("whole") + (F.col("j") < F.col("more")).cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Of rows equal in id, source and text it does not
    matter which are taken once more."""
    p = materialize(plan(docs, word_count(F.col("text"))).filter("whole > 0 or more > 0"), "plan")
    keys = ["_id", "_noid", "_s", "_null", "_same"]
    of = lambda i, s, h: [F.coalesce(i, F.lit(0).cast("long")).alias("_id"), i.isNull().alias("_noid"), *named_source(s), h.alias("_same")]
    p = p.select(*of(F.col("doc_id"), F.col("source"), F.col("same")), "n", F.col("n").alias("equal"), "whole", "more")
    d = docs.select(F.struct(*docs.columns).alias("_row"), *of(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text")), F.monotonically_increasing_id().alias("_at"))
    alike = p.filter("more = 0 or more = equal").select(*keys, "n", (F.col("whole") + (F.col("more") > 0).cast("long")).alias("copies"))
    alike = lookup(d, alike, keys, "n", F.col("_at")).filter("copies > 0").select("_row", "copies")
    # equal rows that the target parts: one group a source at most
    parted = numbered(d.drop("_at").join(p.filter("more > 0 and more < equal").drop("n"), keys), keys, "j")
    parted = parted.select("_row", (F.col("whole") + (F.col("j") < F.col("more")).cast("long")).alias("copies")).filter("copies > 0")
    out = alike.unionByName(parted)
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(read(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
-- capped sources are those of the smallest cap for their weight
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(2.0::DOUBLE * source_size) OVER r, 0) AS caps_before, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_left, row_number() OVER r AS k
    FROM s WINDOW r AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - caps_before) / w_left, k) FILTER (WHERE (total - caps_before) / w_left * w < cap), 'inf'::DOUBLE) AS per FROM o),
t AS (SELECT source, source_size, w, least(cap, per * w) AS target FROM o, l),
m AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, round(target - whole * source_size)::BIGINT AS more,
    sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more > 0 AND upto - more <= more - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken, source FROM r
"""
