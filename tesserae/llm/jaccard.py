"""N-gram Jaccard join with a token-group matrix.

Documents with the same shingle set are one class. Classes fall into groups of likely similar ones (same two smallest
shingle hashes and size band), large groups into blocks of about BLOCK. Candidates come from prefixes: a row for each
(token, group) holds that some member has the token in its prefix, with the members' size range. Prefixes are
overlong(n) tokens longer than a first shared token needs; so a query that meets fewer rows of a group than
needed() can have no partner in it. The token-group matrix then has, for each block that is asked, the union of its
members' whole sets, as the first 16 or 32 bits of their hashes: a query whose tokens in the union are fewer than
threshold * |query| can have no partner there, and the block is not opened for it. No text is read up to here.

Opened blocks compare whole sets, exactly. First, each block is opened for its own members and for one query of every
other block that asks, then for all others; a block whose members are all in the component of the query that asks is not
opened again. So near copies that link cost their blocks' pairs, not their own. Tokens found in many documents stand last in the global order that prefixes follow, so that common
passages make no candidates; the most common are split over tasks. Any order gives the same links.

Nulls, empty texts: an empty set, linked with nothing. Null ids: never linked, component_id null. Rows that
repeat an id are one node with the links of all its texts. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Forest, WordHashes, components, discard, lookup, map_rows, materialize, mix, read, shingle_hashes, signed, trim

BLOCK, QUERIES = 128, 128
#: Sets of more tokens are held in the matrix by 32 bits a token, others by 16.
NARROW = 2048
#: Queries that meet at one token, at most (by the token's count): more are dealt over several tasks.
SPLIT = 50_000
#: Common tokens told to the tasks, at most; a token is common from COMMON sightings on.
MAX_COMMON, COMMON = 200_000, 20
CHUNK_TOKENS = 2_000_000


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def overlong(n: int) -> int:
    return 1 + n // 50


def needed(n: int | Column, num: int, den: int) -> Column:
    """Rows of a group that a query of n tokens meets if it has a partner there, whose overlap is threshold * n at least."""
    least = F.ceil(n * num / den).cast("long")
    return F.least(least, 2 + F.floor(least / 50))


def narrow(u: np.ndarray) -> bytes:
    """The first bits of sorted hashes, sorted."""
    return (u >> np.uint64(48)).astype(np.uint16).tobytes() if len(u) <= NARROW else (u >> np.uint64(32)).astype(np.uint32).tobytes()


def common_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sorted hashes of shingles that many documents share, at most MAX_COMMON; and how many tasks those of more than SPLIT documents take.

    Each task counts documents in chunks and passes on what it sees twice or more in a chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, n = WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            many = c > 1
            return pa.RecordBatch.from_arrays([pa.array(t[many].view(np.int64)), pa.array(c[many])], names=["token", "n"])

        for b in batches:
            for text in b.column(0):
                held.append(shingle_hashes(text.as_py(), k, cache))
                n += len(held[-1])
                if n >= CHUNK_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
        held.clear()
        trim()

    seen = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    top = seen.orderBy(F.desc("n"), "token").limit(MAX_COMMON).toArrow()
    token, n = top["token"].to_numpy(), top["n"].to_numpy()
    many = n > SPLIT
    return np.sort(token.view(np.uint64)), [(int(t), int(-(-x // SPLIT))) for t, x in zip(token[many], n[many], strict=True)]


def prefixes(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """doc_id, n (set size), fp (of the set), g (likely group), probe (prefix tokens), n_index (how many of them index), bits (the whole set, narrow)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        cache, hot = WordHashes(), shared.value
        for r in rows:
            u = shingle_hashes(r["text"], k, cache)
            n = len(u)
            if not n:
                yield {"doc_id": r["doc_id"], "n": 0, "fp": None, "g": None, "probe": None, "n_index": 0, "bits": None}
                continue
            more = 1 + overlong(n)
            probe, index = n - ceil_div(num * n, den) + more, n - ceil_div(2 * num * n, num + den) + more
            if len(hot):
                at = np.searchsorted(hot, u)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == u
                p = np.concatenate([u[~is_hot], u[is_hot]])[:probe] if is_hot.any() else u[:probe]
            else:
                p = u[:probe]
            band = int(np.log(n) / np.log(den / num)) if num < den else n
            raw = u.tobytes()
            a, b = mix(len(raw), *_digest(raw)), mix(*_digest(raw[::-1]))
            yield {"doc_id": r["doc_id"], "n": n, "fp": a.to_bytes(8, "big") + b.to_bytes(8, "big"), "g": signed(mix(u[0], u[min(1, n - 1)], band)), "probe": p.view(np.int64), "n_index": index, "bits": narrow(u)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, fp binary, g long, probe array<long>, n_index int, bits binary", 1024)


def _digest(raw: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(raw)
    return d & (1 << 64) - 1, d >> 64


def links_in(rows: list[dict], k: int, num: int, den: int, cache: WordHashes) -> Iterator[dict]:
    """Opens one group block: rows of its members (role 1) and of queries (role 0); yields links that join something new."""
    sets = [(r["doc_id"], r["role"], shingle_hashes(r["text"], k, cache)) for r in rows]
    members = [(i, s) for i, role, s in sets if role == 1 and len(s)]
    if not members:
        return
    tokens = np.concatenate([s for _, s in members])
    owner = np.repeat(np.arange(len(members)), [len(s) for _, s in members])
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    union, start, count = np.unique(tokens[order], return_index=True, return_counts=True)
    sizes = np.array([len(s) for _, s in members])
    forest = Forest()
    one = len({i for i, _ in members}) == 1
    for q, role, s in sets:
        if role == 1 or not len(s):
            continue
        one = one or len({forest.root(i) for i, _ in members}) == 1
        if one and forest.root(q) == forest.root(members[0][0]):  # nothing new to join
            continue
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if den * len(at) < num * len(s):  # the bound on any member's overlap
            continue
        c = count[at]
        where = np.repeat(start[at] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        common = np.bincount(owner[where], minlength=len(members))
        for m in np.flatnonzero(den * common >= num * (sizes + len(s) - common)):
            if members[m][0] != q and forest.join(q, members[m][0]):
                yield {"a": q, "b": members[m][0]}


def union_of(bits: list[bytes | None], sizes: list[int]) -> tuple[np.ndarray, bool]:
    """The union of narrow sets, and whether it is of 32 bits: it is if all sets are, else by 16."""
    wide = all(n > NARROW for n in sizes)
    sets = [np.frombuffer(b, np.uint32 if n > NARROW else np.uint16) for b, n in zip(bits, sizes, strict=True)]
    return np.unique(np.concatenate([x if wide or n <= NARROW else (x >> 16).astype(np.uint16) for x, n in zip(sets, sizes, strict=True)])), wide


def met_in(union: np.ndarray, wide: bool, bits: bytes, n: int) -> int:
    """No fewer than the tokens that the set shares with any member of the union."""
    x = np.frombuffer(bits, np.uint32 if n > NARROW else np.uint16)
    if wide and n <= NARROW:
        union = np.unique((union >> 16).astype(np.uint16))
    elif not wide and n > NARROW:
        x = (x >> 16).astype(np.uint16)
    at = np.minimum(np.searchsorted(union, x), len(union) - 1)
    return int((union[at] == x).sum())


def by_gid(df: DataFrame, make, schema: str, *order: str) -> DataFrame:
    """make(rows) over the rows of each (gid, chunk), which one task has together."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        held, key, cache = [], None, WordHashes()
        for r in rows:
            if (r["gid"], r["chunk"]) != key:
                if held:
                    yield from make(held, cache)
                held, key = [], (r["gid"], r["chunk"])
            held.append(r)
        if held:
            yield from make(held, cache)

    return map_rows(df.repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", *order), run, schema)


def chunked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (q, gid, ...) with a chunk of about QUERIES for each, and (gid, chunks)."""
    load = materialize(pairs.groupBy("gid").agg(F.count("*").alias("in_gid")).withColumn("chunks", F.ceil(F.col("in_gid") / QUERIES).cast("int")), "load")
    dealt = lookup(pairs, load, "gid", "in_gid", F.col("q"))
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).drop("chunks"), load.select("gid", "chunks")


def qualified(cand: DataFrame, placed: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """(q, gid, chunk) of the pairs (q, gid) whose query has threshold * |query| of its tokens in the union of the block."""
    sets = table.filter("n > 0").select("doc_id", "n", "bits")
    asked, load = chunked(cand)
    members = placed.select("rep", "gid").distinct().join(load.select("gid"), "gid").join(sets, F.col("rep") == F.col("doc_id"))

    def unite(rows: list[dict], cache: WordHashes) -> Iterator[dict]:
        union, wide = union_of([r["bits"] for r in rows], [r["n"] for r in rows])
        yield {"gid": rows[0]["gid"], "wide": wide, "bits": union.tobytes()}

    matrix = materialize(by_gid(members.select("gid", F.lit(0).alias("chunk"), "n", "bits"), unite, "gid long, wide boolean, bits binary"), "matrix")
    rows = asked.join(sets, F.col("q") == F.col("doc_id")).select("gid", "chunk", F.lit(0).alias("role"), "q", "n", "bits")
    unions = matrix.join(load, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), F.lit(None).cast("long").alias("q"), F.col("wide").cast("long").alias("n"), "bits")

    def bound(rows: list[dict], cache: WordHashes) -> Iterator[dict]:
        if rows[0]["role"] != 1:
            return
        wide = bool(rows[0]["n"])
        union = np.frombuffer(rows[0]["bits"], np.uint32 if wide else np.uint16)
        for r in rows[1:]:
            if den * met_in(union, wide, r["bits"], r["n"]) >= num * r["n"]:
                yield {"q": r["q"], "gid": r["gid"], "chunk": r["chunk"]}

    return by_gid(rows.unionByName(unions), bound, "q long, gid long, chunk int", F.desc("role")).distinct()  # an id's texts ask each


def opened(pairs: DataFrame, placed: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that the pairs (q, gid, chunk) have."""
    asks = pairs.select(F.col("q").alias("doc_id"), "gid", "chunk", F.lit(0).alias("role"))
    members = placed.select("rep", "gid").distinct().join(pairs.select("gid", "chunk").distinct(), "gid").select(F.col("rep").alias("doc_id"), "gid", "chunk", F.lit(1).alias("role"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = asks.unionByName(members).join(texts, "doc_id")
    return materialize(by_gid(rows, lambda held, cache: links_in(held, k, num, den, cache), "a long, b long"), "links")


def in_blocks(met: DataFrame, *more: str) -> DataFrame:
    """(q, gid, more...) for the pairs (q, g, blocks, more...): every block of a large group."""
    dealt = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.select("q", F.xxhash64("g", F.col("block").cast("long")).alias("gid"), *more)


def links_between(met: DataFrame, large: DataFrame, placed: DataFrame, table: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, component_id) of the documents that the links among the pairs (q, g, og) join."""

    def open_all(pairs: DataFrame) -> DataFrame:
        asked = materialize(pairs.distinct(), "candidates")
        fit = materialize(qualified(asked, placed, table, num, den), "qualified")
        links = opened(fit, placed, docs, k, num, den)
        discard(asked, fit)
        return links

    # each block for its own members, and for one query of every other block that asks its group
    one = met.groupBy("og", "g").agg(F.min_by("q", F.struct(F.xxhash64("q"), "q")).alias("q")).select("q", "g")
    first = in_blocks(lookup(one, large, "g", "in_group", F.col("q"))).unionByName(met.filter("g = own").select("q", F.col("og").alias("gid")))
    comps = materialize(components(open_all(first)), "components")
    # then for all others, but never for a query in whose component all of the block's members are by now
    of = placed.select("rep", "g", "gid").distinct().join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component_id", "rep"))
    known = lambda key: of.groupBy(key).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    apart = (F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("cq"))
    asked = met.groupBy("g").agg(F.count("*").alias("asks")).join(known("g"), "g").join(large.select("g", "blocks"), "g", "left")
    left = met.join(comps.select(F.col("id").alias("q"), F.col("component_id")), "q", "left").select("q", "g", F.coalesce("component_id", "q").alias("cq"))
    left = lookup(left, asked, "g", "asks", F.col("q")).filter(apart).select("q", "g", "cq", "blocks")
    left = materialize(left, "left")
    if left.isEmpty():
        return comps
    more = open_all(in_blocks(left, "cq").join(known("gid"), "gid").filter(apart).select("q", "gid"))
    return materialize(components(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more)), "components")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * intersection >= num * union of their k-word sets."""
    if not 0 < num <= den:
        raise ValueError("the threshold is above 0 and at most 1")
    common, hot = common_tokens(docs, k)
    table = materialize(prefixes(docs, k, num, den, common), "prefixes")
    reps = table.filter("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("probe").alias("probe"), F.first("n_index").alias("n_index"))
    reps = materialize(reps, "classes")
    large = reps.groupBy("g").agg(F.count("*").alias("in_group")).filter(F.col("in_group") > BLOCK).withColumn("blocks", F.ceil(F.col("in_group") / BLOCK).cast("int"))
    large = materialize(large, "large")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    placed = lookup(reps, large, "g", "in_group", F.col("rep")).withColumn("gid", F.xxhash64("g", block))
    placed = materialize(placed.select("rep", "n", "g", "gid", "probe", "n_index"), "groups")
    matrix = placed.select(F.explode(F.slice("probe", F.lit(1), F.col("n_index"))).alias("token"), "g", "rep", "n").repartition("token", *["g"] * bool(hot))
    matrix = matrix.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    queries = placed.select(F.explode("probe").alias("token"), F.col("rep").alias("q"), F.col("n").alias("nq"), F.col("gid").alias("og"), F.col("g").alias("own"))
    on = ["token"]
    if hot:  # at most MAX_COMMON rows
        split = F.broadcast(placed.sparkSession.createDataFrame(hot, "token long, tasks int"))
        matrix = matrix.join(split, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
        queries = queries.join(split, "token", "left").withColumn("part", F.pmod(F.xxhash64("q"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
        on = ["token", "part"]
    fits = (F.col("least") <= F.col("nq")) & (F.col("most") * den >= F.col("nq") * num) & ((F.col("lo") != F.col("q")) | (F.col("hi") != F.col("q")))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    hits = queries.alias("l").join(matrix.hint("shuffle_hash").alias("r"), same & fits)
    met = hits.groupBy("q", "nq", "g").agg(F.count("*").alias("met"), F.first("og").alias("og"), F.first("own").alias("own"))
    met = materialize(met.filter(F.col("met") >= needed(F.col("nq"), num, den)).select("q", "g", "og", "own"), "met")
    comps = links_between(met, large, placed, table, docs, k, num, den)
    discard(large, placed, met)
    known = reps.select("fp", "rep", "copies").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.filter("copies > 1 or component_id is not null").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    out = lookup(table.select("doc_id", "n", "fp"), known, "fp", "copies", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
