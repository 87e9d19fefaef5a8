"""Exact metric range join of embeddings.

Equal vectors are one class. Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots come from
a bounded sample (SAMPLE_FLOATS components): the centres of its dense balls of radius r, and some of what no ball
covers. A vector within r of a centre is in the nearest centre's cell, any other in the cell of its nearest plain
pivot; cells are numbered, centres first. By the triangle inequality a vector w of cell q can be within r of a member
of cell p only if d(w,p) <= R_p + r (R_p = r for balls, no bound for others) and, between cells of one kind,
d(w,p)^2 - d(w,q)^2 <= 2 r d(p,q) (the bisector's bound). Each vector is copied to the cells before its own for which
that holds, and each cell joins its own vectors with all it holds and counts both ends. Members of a cell within r / 2
of its pivot link with each other for certain: they are linked by a star and counted without comparison, so a dense
group costs no square. The rest is compared in blocks of CHUNK_FLOATS components a side.

Pivots only set the cost. How many plain ones there are is chosen by the cost that the sample foretells: where vectors
are nearly orthogonal and no bound prunes, that is one cell, whose blocks are compared all with all.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different
lengths with each other. Null ids: links are counted for the row, component_id null. Rows that repeat an id are one node.
Vectors are scaled by powers of two, so that no finite component overflows. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Forest, components, lookup, materialize, read

#: Components of the sample that pivots come from; of a block's side. Sampled members that make a ball dense.
SAMPLE_FLOATS, CHUNK_FLOATS, DENSE = 1 << 19, 1 << 19, 3
LEAST_SAMPLE, LEAST_CHUNK = 64, 256
#: What placing a row costs, in compared pairs.
PLACE_COST = 20_000
#: float32 products of unit vectors are off by less than this; what is that near to c is computed in double.
MARGIN, SLACK = 1e-4, 1e-6


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows in double, times a power of two that brings their largest component to [0.5, 1)."""
    v = np.asarray(v, float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Cells:
    """Pivots of one length of vectors: `balls` centres of dense balls, then plain pivots."""

    def __init__(self, sample: np.ndarray, rows: int, r: float) -> None:
        self.r, u = r, unit(sample)
        least = 1 - r * r / 2
        near = np.concatenate([(u[lo : lo + 512] @ u.T >= least).sum(axis=1) for lo in range(0, len(u), 512)])
        free, centres = np.ones(len(u), bool), []
        for i in np.argsort(-near, kind="stable"):
            if near[i] < DENSE:
                break
            if free[i]:
                members = free & (u @ u[i] >= least)
                if members.sum() >= DENSE:
                    centres.append(u[members].mean(axis=0))
                    free &= u @ u[i] < least
        self.balls = len(centres)
        rest = u[free] if free.any() else u[:1]
        balls = unit(np.array(centres)) if centres else np.empty((0, u.shape[1]))
        self.pivots = np.concatenate([balls, rest[:1]])
        best, n = None, rows * len(rest) / len(u)
        for k in (1, 4, 16, 64, 256):
            if k > len(rest) // 4 or k > 1 and k > n // 64:
                break
            trial = object.__new__(Cells)
            trial.r, trial.balls, trial.pivots = r, 0, rest[:k]
            seen = rest[k:][:1024] if k < len(rest) else rest
            own, _, copy = trial.place(seen)
            held, foreign = np.bincount(own, minlength=k) / len(seen), copy.sum(axis=0) / len(seen)
            cost = n * n * float((held * (held / 2 + foreign)).sum()) + PLACE_COST * n * (1 + float(foreign.sum()))
            if best is None or cost < best:
                best, self.pivots = cost, np.concatenate([balls, rest[:k]])

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: own cell, distance to its pivot, and whether each cell gets a copy."""
        p, b, r = self.pivots, self.balls, self.r + SLACK
        d2 = np.maximum(0, 2 - 2 * (u @ p.T))
        own = b + d2[:, b:].argmin(axis=1)
        if b:
            ball = d2[:, :b].argmin(axis=1)
            own = np.where(d2[np.arange(len(u)), ball] <= self.r**2, ball, own)
        mine = d2[np.arange(len(u)), own][:, None]
        if not hasattr(self, "apart"):  # made by each process that places vectors
            self.apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        apart = self.apart[own]
        is_ball = np.arange(len(p)) < b
        copy = d2 - mine <= 2 * r * apart
        copy |= is_ball[None, :] != (own < b)[:, None]  # the bisector bounds cells of one kind only
        copy &= ~is_ball[None, :] | (np.sqrt(d2) <= self.r + r)
        copy &= np.arange(len(p))[None, :] < own[:, None]
        return own, np.sqrt(mine[:, 0]), copy


def lengths(v: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors in double and scaled) of the vectors of each length."""
    start, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    size = np.diff(start)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, scaled(flat[start[at][:, None] + np.arange(n)])


def join_block(a: tuple, b: tuple | None, c: float) -> tuple[list, list, list]:
    """Columns (id, link or None, copies linked) of a block: its sides are (ids, copies, vectors), or one side with itself.

    Links are those that join something new; both ends' linked copies are counted."""
    one = b is None
    b = a if one else b
    va, vb = scaled(a[2]), scaled(b[2])
    ua, ub = unit(va).astype(np.float32), unit(vb).astype(np.float32)
    got, forest = {}, Forest()
    out: tuple[list, list, list] = ([], [], [])
    total_a, total_b = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
    for lo in range(0, len(ua), 512):
        first = lo if one else 0
        i, j = np.nonzero(ua[lo : lo + 512] @ ub[first:].T >= c - MARGIN)
        i, j = i + lo, j + first
        if one:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 65536):
            x, y = i[s : s + 65536], j[s : s + 65536]
            near = cosines(va[x], vb[y]) >= c
            x, y = x[near], y[near]
            np.add.at(total_a, x, b[1][y])
            np.add.at(total_b, y, a[1][x])
            for p, q in zip(a[0][x].tolist(), b[0][y].tolist(), strict=True):
                if forest.join(p, q):
                    for col, value in zip(out, (p, q, 0), strict=True):
                        col.append(value)
    for ids, total in ((a[0], total_a), (b[0], total_b)):
        for k in np.flatnonzero(total):
            got[int(ids[k])] = got.get(int(ids[k]), 0) + int(total[k])
    for k, n in got.items():
        for col, value in zip(out, (k, None, n), strict=True):
            col.append(value)
    return out


def near_vectors(vectors: DataFrame, c: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for (vec_id, embedding): links are pairs of cosine >= c."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    fine = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.transform(e, lambda x: (x.cast("double") + F.lit(0.0)).cast(kind))).alias("v"))
    rows = rows.withColumn("fp", F.unhex(F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex(F.xxhash64(x)))), 256)))
    rows = materialize(rows.withColumn("fp", F.when(F.col("v").isNotNull(), F.col("fp"))), "vectors")
    reps = rows.filter("v is not null").groupBy("fp").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # a class of rows without ids gets an id of its own, below zero, that stands for no row
    reps = materialize(reps.withColumn("rep", F.coalesce("vec_id", F.xxhash64("fp").bitwiseOR(F.lit(-(1 << 63))))).select("rep", "vec_id", "fp", "copies", "v"), "classes")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    picked = reps.orderBy(F.xxhash64("fp"), "rep").limit(max(LEAST_SAMPLE, SAMPLE_FLOATS // (size.dim or 1))).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r.v), []).append(r.v)
    radius = float(np.sqrt(max(0.0, 2 - 2 * c)))
    shared = spark.sparkContext.broadcast({d: Cells(scaled(np.array(v)), size.n * len(v) // len(picked), radius) for d, v in by_dim.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            for dim, at, x in lengths(v):
                cells = shared.value.get(dim)
                for lo in range(0, len(at), 1024):
                    rows = at[lo : lo + 1024]
                    if cells is None:
                        own, dist, copy = np.zeros(len(rows), int), np.full(len(rows), 9.0), np.zeros((len(rows), 1), bool)
                    else:
                        own, dist, copy = cells.place(unit(x[lo : lo + 1024]))
                    i, cell = np.nonzero(copy)
                    take = np.concatenate([rows, rows[i]])
                    role = np.concatenate([dist <= radius / 2 - SLACK, np.full(len(i), 2)]).astype(np.int32)
                    cell = (dim << 32) + np.concatenate([own, cell])
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(role), b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), v.take(pa.array(take))], names=["cell", "role", "rep", "copies", "v"])

    # role: 0 own, 1 own and within r / 2 of the pivot, 2 copied from a later cell
    placed = materialize(reps.select("rep", "copies", "v").mapInArrow(place, f"cell long, role int, rep long, copies long, v array<{kind}>"), "cells")
    chunk = F.greatest(F.lit(LEAST_CHUNK), (F.lit(CHUNK_FLOATS) / F.shiftright("cell", 32)).cast("int"))
    load = placed.groupBy("cell").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("role") == k, 1)).alias(f"n{k}") for k in range(3)])
    load = materialize(load.select("cell", "n", *[F.ceil(F.col(f"n{k}") / chunk).cast("int").alias(f"b{k}") for k in range(3)]), "load")
    dealt = lookup(placed, load, "cell", "n", F.col("rep")).withColumn("k", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("role") == 0, F.col("b0")).when(F.col("role") == 1, F.col("b1")).otherwise(F.col("b2")))).cast("int"))

    # blocks (i, j): i chunks of own vectors or (below zero) copied ones, j chunks of own vectors or (below zero) inner ones
    def some(start: str, n: str, made: str) -> str:
        return f"transform(slice(sequence(0, {start} + {n}), {start} + 1, {n}), x -> {made})"

    def spot(side: str, i: str, j: str) -> str:
        return f"named_struct('side', {side}, 'i', int({i}), 'j', int({j}))"

    own = f"concat({some('0', 'k + 1', spot('1', 'x', 'k'))}, {some('0', 'b2', spot('1', '-1 - x', 'k'))}, {some('k + 1', 'b0 - 1 - k', spot('0', 'k', 'x'))}, {some('0', 'b1', spot('0', 'k', '-1 - x'))})"
    inner = f"concat({some('0', 'b0', spot('1', 'x', '-1 - k'))}, {some('0', 'b2', spot('1', '-1 - x', '-1 - k'))})"
    copied = f"concat({some('0', 'b0', spot('0', '-1 - k', 'x'))}, {some('0', 'b1', spot('0', '-1 - k', '-1 - x'))})"
    blocks = dealt.select("cell", F.explode(F.expr(f"case role when 0 then {own} when 1 then {inner} else {copied} end")).alias("at"), "rep", "copies", "v")
    blocks = blocks.select("cell", "at.i", "at.j", "at.side", "rep", "copies", "v").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            whole = [tuple(np.concatenate(part) for part in zip(*side, strict=True)) if side else None for side in sides]
            if whole[1] is None or whole[0] is None and not (key[1] == key[2] >= 0):
                return
            a, b = (whole[1], None) if whole[0] is None else whole
            got = join_block(a, b, c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b", "links"])

        for b in batches:
            cell, i, j, side, rep, copies = (b.column(k).to_numpy() for k in range(6))
            v = b.column(6)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                at = (int(cell[lo]), int(i[lo]), int(j[lo]))
                if at != key:
                    if key is not None:
                        yield from out()
                    key, sides = at, ([], [])
                x = v.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                sides[int(side[lo])].append((rep[lo:hi].copy(), copies[lo:hi].copy(), x.copy()))
        if key is not None:
            yield from out()

    got = materialize(blocks.mapInArrow(run, "a long, b long, links long"), "links")
    inside = placed.filter("role = 1").select("cell", "rep", "copies")
    star = inside.groupBy("cell").agg(F.min("rep").alias("hub"), F.sum("copies").alias("of_cell"), F.count("*").alias("n"))
    inside = lookup(inside, star, "cell", "n", F.col("rep"))
    sure = inside.select(F.col("rep").alias("a"), F.when(F.col("rep") != F.col("hub"), F.col("hub")).alias("b"), (F.col("of_cell") - F.col("copies")).alias("links"))
    got = got.unionByName(materialize(sure, "links"))
    return named(rows, reps, got)


def named(rows: DataFrame, reps: DataFrame, got: DataFrame) -> DataFrame:
    """The result's rows, of links (a, b or null, copies linked) between classes."""
    comps = components(got.filter("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    links = got.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per = reps.select("rep", "vec_id", "fp", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    # a component may have been named after a class without ids: name it after the smallest real id
    least = per.groupBy(F.coalesce("component_id", "rep").alias("cid")).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    per = lookup(per.withColumn("cid", F.coalesce("component_id", "rep")), least, "cid", "n", F.col("rep"))
    known = per.select("fp", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    out = lookup(rows.select("vec_id", "fp"), known, "fp", "copies", F.col("vec_id"))
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
