"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is dropped if an earlier line (by doc_id and line number) equals it, or is within TAU edits of it and both have
MIN_CHARS characters or more. Distinct lines are split into TAU + 1 segments; two lines within TAU edits share one
segment, at places that their lengths and the segment's number bound. So each line probes the segments of lines as
long as it or up to TAU shorter with the substrings at those places. Pairs found that way must have letter counts that differ
no more than TAU edits can explain; they are then compared exactly: common prefix and suffix are cut off and a
bit-parallel edit distance runs over a band of 2 * TAU + 1 diagonals.

Lines are parted by \\n; lines of white space only are never dropped. Null text: null, no lines. Rows equal in id and
text are one document. Null ids stand first. Other columns are kept by dedup_lines(); where all lines go, so does the
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import HOT_KEYS, discard, lookup, materialize, read

TAU, MIN_CHARS = 2, 24
#: Lines of the index that one task has of one key, about; keys of more are dealt out (the HOT_KEYS most frequent ones).
PART = 2_000
#: Letters whose counts are compared before texts are fetched: the sixteen most frequent ones of English.
LETTERS = "etaoinshrdlcumwf"


def segment(i: int, length: Column, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 1) of a line of that length: the last ones are one longer."""
    m = tau + 1
    base, more = F.floor(length / m).cast("int"), (length % m).cast("int")
    return (base * (i - 1) + F.greatest(F.lit(0), more - (m - i + 1)) + 1), base + (F.lit(m - i) < more).cast("int")


def segment_keys(chars: Column, length: Column, tau: int) -> Column:
    keys = []
    for i in range(1, tau + 2):
        start, size = segment(i, length, tau)
        keys.append(F.xxhash64(F.lit(i), length, part(chars, start, size)))
    return F.array(*keys)


def probe_keys(chars: Column, length: Column, tau: int) -> Column:
    """Keys of the substrings that can be segment i of a line shorter by 0 to tau."""
    keys = []
    for delta in range(tau + 1):
        other = length - delta
        for i in range(1, tau + 2):
            start, size = segment(i, other, tau)
            for shift in range(max(-(i - 1), delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1):
                keys.append(F.xxhash64(F.lit(i), other, part(chars, start + shift, size)))
    return F.array(*keys)


def part(chars: Column, start: Column, size: Column) -> Column:
    """Characters start (from 1) to start + size of a line in UTF-32, where places are found without a scan."""
    return F.substring(chars, start * 4 - 3, size * 4)


def sketched(lines: DataFrame, text: Column) -> DataFrame:
    """lines with w, a long: the counts of LETTERS in the text, each modulo 16; null for null.

    An edit changes the counts of two letters by one at most. Letters counted are taken out before the next is, each in
    a projection of its own, so that a letter is removed once and later passes read shorter texts."""
    kept = lines.columns
    out = lines.withColumn("_rest0", text)
    for k, c in enumerate(LETTERS):
        out = out.withColumn(f"_rest{k + 1}", F.replace(f"_rest{k}", F.lit(c), F.lit("")))
    counts = [f"shiftleft(cast((octet_length(_rest{k}) - octet_length(_rest{k + 1})) & 15 as bigint), {4 * k})" for k in range(len(LETTERS))]
    return out.select(*kept, F.expr(" | ".join(counts)).alias("w"))


def explained(a: Column, b: Column, tau: int) -> Column:
    """Whether tau edits can make a line of sketch a one of sketch b."""
    apart = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = (F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15))).bitwiseAND(F.lit(15))
        apart = apart + F.least(d, F.lit(16) - d)
    return apart <= 2 * tau


def within(a: str, b: str, tau: int) -> str:
    """SQL for: columns a and b are within tau edits. Needs their lengths to differ by tau at most."""
    steps = ", ".join(str(1 << p) for p in range(30, -1, -1))
    prefix = f"aggregate(array({steps}), 0, (n, s) -> if(n + s <= least(length({{x}}), length({{y}})) and substr({{x}}, n + 1, s) = substr({{y}}, n + 1, s), n + s, n))"
    bits = " + ".join(f"if(get(p, j - {tau + 1} + {k}) = t[j - 1], {1 << k}, 0)" for k in range(2 * tau + 1))
    full, top = (1 << (2 * tau + 1)) - 1, 1 << (2 * tau)
    vn, vp = sum(1 << k for k in range(1, tau + 1)), sum(1 << k for k in range(tau + 1, 2 * tau + 1))
    # one column of the band: bit k is the row j - tau + k; what lies outside the band counts as growing
    step = f"""transform(array(named_struct('e', {bits}, 'p', (shiftright(s.vp, 1) | {top}), 'n', shiftright(s.vn, 1))), x ->
      named_struct('d', (((((x.e & x.p) + x.p) ^ x.p) | x.e | x.n) & {full}), 'p', x.p, 'n', x.n))"""
    step = f"transform({step}, x -> named_struct('d', x.d, 'hp', ((shiftleft((x.n | ~(x.d | x.p)), 1) | 1) & {full}), 'hn', (shiftleft((x.d & x.p), 1) & {full})))"
    step = f"transform({step}, x -> named_struct('vp', ((x.hn | ~(x.d | x.hp)) & {full}), 'vn', (x.hp & x.d), 'score', s.score + 1 - (shiftright(x.d, k) & 1)))[0]"
    band = f"""aggregate(sequence(1, size(t)), named_struct('vp', {vp}, 'vn', {vn}, 'score', size(p) - size(t)), (s, j) -> if(s.score > {tau}, s, {step})).score"""
    # the score never falls along its diagonal, so that past tau nothing more is to be done
    # names: x, y trimmed texts, the longer first; p, t their characters; k the diagonal of the last cell
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    run = let("k", f"size(p) - size(t) + {tau}", f"if(size(t) = 0, size(p) - size(t), {band})")
    run = let("p", "split(x, '')", let("t", "if(y = '', array(), split(y, ''))", run))
    run = f"if(x = '', 0, {run})"
    cut = let("m", prefix.format(x="reverse(v)", y="reverse(w)"), let("x", "left(v, length(v) - m)", let("y", "left(w, length(w) - m)", run)))
    cut = let("n", prefix.format(x="g", y="h"), let("v", "substr(g, n + 1)", let("w", "substr(h, n + 1)", cut)))
    return let("g", f"if(length({a}) >= length({b}), {a}, {b})", let("h", f"if(length({a}) >= length({b}), {b}, {a})", f"({cut}) <= {tau}"))


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, same (hash of the text), n_lines, n_exact, n_near, dropped (line numbers from 0) for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), F.col("text").cast("string").alias("text"))
    lines = rows.select("doc_id", "same", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    length = F.char_length("line")
    code = F.xxhash64("line").alias("h"), (F.crc32(F.col("line").cast("binary")) * 65536 + F.pmod(length, F.lit(65536))).alias("c")
    place = F.struct("doc_id", "same", "pos")
    coded = lines.select(place.alias("place"), *code, F.encode("line", "UTF-32").alias("u"), length.alias("size"), "line")
    # keys of every line, also of those too short for them: within a condition u would be made once for each key
    keyed = coded.select("place", "h", "c", "line", "size", segment_keys(F.col("u"), F.col("size"), tau).alias("parts"), probe_keys(F.col("u"), F.col("size"), tau).alias("probes"))
    keyed = sketched(keyed, F.col("line")).drop("line")
    distinct = keyed.groupBy("h", "c").agg(F.min("place").alias("first"), F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("w", "size", "parts", "probes")])
    distinct = materialize(distinct, "distinct")
    near = distinct.filter(F.col("size") >= min_chars)
    index = near.select(F.explode("parts").alias("key"), F.col("h").alias("b"), F.col("w").alias("wb"))
    probes = near.select(F.explode("probes").alias("key"), F.col("h").alias("a"), F.col("w").alias("wa"))
    # a key of many lines: its index is dealt over parts, each of which all its probes meet
    busy = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PART).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    busy = materialize(busy.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "busy")
    index = index.join(F.broadcast(busy), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)))
    probes = probes.join(F.broadcast(busy), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    fits = (F.col("a") != F.col("b")) & explained(F.col("wa"), F.col("wb"), tau)
    pairs = probes.alias("l").join(index.hint("shuffle_hash").alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part")) & fits)
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    found = distinct.select("h", "first").join(wanted, "h").select("h", "links", "first")
    by_doc = found.groupBy(F.col("first.doc_id").alias("_d"), F.col("first.same").alias("_s")).agg(F.collect_list(F.struct("h", "links", "first")).alias("want"))  # no more than a document's lines
    texts = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("same") == F.col("_s"))).withColumn("all", F.split("text", "\n", -1))
    texts = texts.select(F.explode(F.transform("want", lambda x: F.struct(x["h"].alias("h"), x["links"].alias("links"), x["first"].alias("first"), F.get(F.col("all"), x["first"]["pos"]).alias("line")))).alias("x")).select("x.*")
    texts = materialize(texts.dropDuplicates(["h"]), "texts")
    side = lambda c: texts.select(F.col("h").alias(c), "links", F.col("first").alias(f"f{c}"), F.col("line").alias(f"l{c}"))
    both = lookup(lookup(pairs, side("a"), "a", "links", F.col("b")), side("b"), "b", "links", F.col("a"))
    close = both.filter((F.abs(F.char_length("la") - F.char_length("lb")) <= tau) & F.expr(within("la", "lb", tau)))
    gone = close.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct().withColumn("near", F.lit(True))
    marked = materialize(distinct.select("h", "c", "first", "n").join(gone, "h", "left").filter("n > 1 or near"), "marked")
    discard(distinct, busy, pairs, texts)
    out = lookup(lines.select("doc_id", "same", "pos", *code), marked, ["h", "c"], "n", place)
    exact = F.coalesce(place != F.col("first"), F.lit(False))
    out = out.withColumn("exact", exact).filter("exact or near")
    per = out.groupBy("doc_id", "same").agg(F.sort_array(F.collect_set(F.struct("pos", "exact"))).alias("gone"))
    # a document without lines has no row yet
    all_docs = rows.select("doc_id", "same", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = all_docs.join(per.withColumnsRenamed({"doc_id": "_d", "same": "_s"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("same") == F.col("_s")), "left")
    gone = F.coalesce("gone", F.array().cast("array<struct<pos:int,exact:boolean>>"))
    of = lambda exact: F.size(F.filter(gone, lambda x: x["exact"] == F.lit(exact))).cast("long")
    return joined.select("doc_id", "same", "n_lines", of(True).alias("n_exact"), of(False).alias("n_near"), F.transform(gone, lambda x: x["pos"]).alias("dropped"))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of docs without the dropped lines; n_chars, if there is one, counts again; documents left without words go."""
    cut = dropped_lines(docs, tau, min_chars).filter("size(dropped) > 0").select(F.col("doc_id").alias("_d"), F.col("same").alias("_s"), F.col("dropped").alias("_dropped")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_h"))
    joined = rows.join(cut, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_s")), "left")
    cut_at = F.col("_dropped").isNotNull()
    kept = F.filter(F.split("_row.text", "\n", -1), lambda line, i: ~F.array_contains("_dropped", i))
    joined = joined.withColumn("_text", F.when(cut_at, F.array_join(kept, "\n")).otherwise(F.col("_row.text")))
    joined = joined.filter(~cut_at | F.col("_text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut_at, F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return joined.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dropped_lines(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_exact", "n_near", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
