"""Exact vector search and hashed embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.model import LIVE, TimeSlice


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_seeds(vectors: DataFrame, query: list[float], k: int = 10, exact: bool = False) -> DataFrame:
    """(id, dist, score, chunk, snippet): nearest ids by their best chunk among the 4k nearest rows (all rows if exact), with
    that chunk's text, if vectors have one; score is 1 - dist."""
    if any(not math.isfinite(x) for x in query):
        raise ValueError("the query vector is not finite")
    text = F.col("text") if "text" in vectors.columns else F.lit(None).cast("string")
    if k <= 0 or not any(query):
        return vectors.select("id", F.lit(0.0).alias("dist"), F.lit(0.0).alias("score"), "chunk", text.alias("snippet")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select("id", "chunk", cosine_distance(F.col("emb"), q).alias("dist"), text.alias("snippet"))
    near = rows if exact else rows.orderBy("dist", "id", "chunk").limit(4 * k)
    best = near.groupBy("id").agg(F.min(F.struct("dist", "chunk", "snippet")).alias("m"))
    return best.select("id", "m.dist", (1 - F.col("m.dist")).alias("score"), "m.chunk", "m.snippet").orderBy("dist", "id").limit(k)


def past_vector_seeds(vectors: DataFrame, query: list[float], nodes: DataFrame, when: TimeSlice, k: int = 10) -> DataFrame:
    """The k nearest live nodes that also have a version in the slice, among the 4k nearest."""
    if when == LIVE:
        return vector_seeds(vectors, query, k)
    there = nodes.filter(when.predicate()).select("id").distinct()
    return vector_seeds(vectors, query, 4 * k).join(there, "id", "left_semi").orderBy("dist", "id").limit(k)


def hash_embed(text: Column, dim: int = 64) -> Column:
    """Counts of words by a 31-polynomial hash of their characters, modulo dim."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    code = lambda w: F.aggregate(F.split(w, ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(4294967296)))
    slots = F.transform(words, lambda w: F.pmod(code(w), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def embed_hash(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def chunk_text(text: str, size: int, overlap: int = 0) -> list[str]:
    """Windows of at most size characters that end at a paragraph, line or space in their last third if there is one."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size and overlap do not fit")
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in ("\n\n", "\n", " "):
                cut = text.rfind(mark, at + size - size // 3, end)
                if cut > at:
                    end = cut
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out
