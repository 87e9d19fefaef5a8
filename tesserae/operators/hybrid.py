"""Fusion of ranked lists, diversification, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae import model
from tesserae.model import LIVE, TimeSlice, persisted
from tesserae.operators.pattern import adjacency
from tesserae.operators.scan import LIMITS, Limits
from tesserae.operators.text import bm25
from tesserae.operators.traverse import by_rank, walk
from tesserae.operators.vector import cosine_distance, past_vector_seeds

#: Fixed value of reciprocal rank fusion.
RRF_K = 60


def rrf(*legs: DataFrame, k: int = 10) -> DataFrame:
    """(id, score, legs) of ranked lists (id, rank): the sum of 1/(60+rank) over lists, ties by id; legs are the lists' numbers."""
    parts = [leg.groupBy("id").agg(F.min("rank").alias("rank")).withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("leg")).alias("legs"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def ranked(top: DataFrame, *order) -> DataFrame:
    """Ranks from 1 of a list that is already cut to its best rows."""
    return top.select("id", F.row_number().over(W.orderBy(*order)).alias("rank"))


def mmr(candidates: list[tuple[str, float, list[float] | None]], k: int, lam: float = 0.5) -> list[str]:
    """Greedy choice by lam * relevance - (1 - lam) * largest cosine to what is chosen; the first maximum wins."""
    vecs = [None if v is None else np.asarray(v, float) for _, _, v in candidates]
    units = [None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v) for v in vecs]
    chosen: list[int] = []
    while len(chosen) < min(k, len(candidates)):
        best, at = -np.inf, -1
        for i, (_, rel, _) in enumerate(candidates):
            if i not in chosen:
                close = max([0.0, *(float(units[i] @ units[j]) for j in chosen if units[i] is not None and units[j] is not None)])
                value = lam * rel - (1 - lam) * close
                if value > best:
                    best, at = value, i
        chosen.append(at)
    return [candidates[i][0] for i in chosen]


def metrics(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, ndcg) of results (query, id, rank) against judged (query, id, gain)."""
    top = results.filter(F.col("rank") <= k).join(judged, ["query", "id"])
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(rank + 1.0)
    got = top.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("rank"))).alias("dcg"))
    ideal = judged.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("gain"), "id")))
    best = ideal.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, gain(F.col("r")))).alias("idcg"))
    zero = F.lit(0.0)
    out = best.join(got, "query", "left")
    return out.select("query", F.coalesce(F.col("hits") / F.col("n"), zero).alias("recall"), F.coalesce(1 / F.col("first"), zero).alias("mrr"), F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"))


class WrongModel(ValueError):
    pass


@dataclass(frozen=True)
class Corpus:
    """What retrieval reads: node and edge versions (nodes with body), vectors (id, chunk, text, emb), and their model."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    model: str | None = None

    def require(self, embedder: str | None) -> None:
        if self.model is None:
            raise WrongModel("nothing is embedded here")
        if embedder is not None and embedder != self.model:
            raise WrongModel(f"embedded with {self.model!r}, but asked with {embedder!r}")


def fts_seeds(corpus: Corpus, query: str, k: int, when: TimeSlice = LIVE) -> DataFrame:
    """(id, rank) of the k best nodes by words. All versions are indexed; those of the slice are kept after scoring."""
    scores = bm25(corpus.nodes.select("ver", "body"), query)
    held = corpus.nodes.filter(when.predicate()).select("ver", "id")
    best = scores.join(held, "ver").groupBy("id").agg(F.max(F.round("score", 9)).alias("score"))
    return ranked(best.orderBy(F.desc("score"), "id").limit(k), F.desc("score"), "id")


def seed_lists(corpus: Corpus, query: str, vector: list[float], k: int, when: TimeSlice = LIVE) -> tuple[DataFrame, DataFrame]:
    """Both legs of hybrid retrieval, 4k long: (id, rank, snippet) by vectors, (id, rank) by words."""
    near = past_vector_seeds(corpus.vectors, vector, corpus.nodes, when, 4 * k)
    near = near.withColumn("rank", F.row_number().over(W.orderBy("dist", "id")))  # no more than 4k rows
    return near.select("id", "rank", "snippet"), fts_seeds(corpus, query, 4 * k, when)


def fuse(near: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(id, score, via, snippet) of the k best seeds of both legs."""
    names = F.transform("legs", lambda i: F.when(i == 0, F.lit("vector")).otherwise(F.lit("fts")))
    fused = rrf(near.select("id", "rank"), words, k=k).select("id", "score", names.alias("via"))
    return fused.join(near.select("id", "snippet"), "id", "left").orderBy(F.desc("score"), "id")


def walked(corpus: Corpus, seeds: DataFrame, max_depth: int, direction: str, rels: tuple[str, ...], when: TimeSlice, limits: Limits | None = LIMITS) -> DataFrame:
    """(id, depth, seed, rank): what is reached from ranked seeds (id, rank) in the slice, in the order depth, rank, id; the
    row cap is applied by depth and id before that. Without limits all edges are passed and all rows are kept."""
    edges = corpus.edges.filter(when.predicate())
    adj = adjacency(edges.filter(F.col("rel").isin(*rels)) if rels else edges, direction)
    found = walk(seeds, adj, max_depth, limits.max_fanout if limits else None, corpus.nodes.filter(when.predicate()))
    return by_rank(found.orderBy("depth", "id").limit(limits.max_rows) if limits else found, seeds)


def retrieve(corpus: Corpus, vector: list[float], k: int = 10, max_depth: int = 2, direction: str = "both", rels: tuple[str, ...] = (), when: TimeSlice = LIVE, embedder: str | None = None, limits: Limits | None = LIMITS) -> DataFrame:
    """(id, depth, seed, rank): vector seeds and what a walk reaches from them."""
    corpus.require(embedder)
    seeds = past_vector_seeds(corpus.vectors, vector, corpus.nodes, when, k)
    return walked(corpus, ranked(seeds, "dist", "id"), max_depth, direction, rels, when, limits)


def hybrid_retrieve(corpus: Corpus, query: str, vector: list[float], k: int = 10, max_depth: int = 2, direction: str = "both", rels: tuple[str, ...] = (), when: TimeSlice = LIVE, embedder: str | None = None, rerank: Callable[[str, DataFrame], DataFrame] | None = None, mmr_k: int | None = None, lam: float = 0.5, limits: Limits | None = LIMITS) -> DataFrame:
    """(id, place): fused seeds, walked; then, if asked for, only what rerank(query, candidates) gives a score (id, score), by
    that score; then mmr_k of them by relevance and novelty (the score, or the cosine to the query)."""
    corpus.require(embedder)
    seeds = ranked(fuse(*seed_lists(corpus, query, vector, k, when), k), F.desc("score"), "id")
    found = persisted(walked(corpus, seeds, max_depth, direction, rels, when, limits))
    order = ["depth", "rank", "id"]
    if rerank is not None:
        scores = rerank(query, found)
        found = found.join(scores.select("id", "score"), "id")
        order = [F.desc("score"), *order]
    if limits:  # no more than the row cap
        placed = found.withColumn("place", F.row_number().over(W.orderBy(*order)))
    else:
        placed = model.ranked(found, order, "place").withColumn("place", (F.col("place") + 1).cast("int"))
    if mmr_k is None:
        return placed.select("id", "place")
    first = corpus.vectors.filter("chunk = 0").select("id", "emb")
    q = F.array(*[F.lit(float(x)) for x in vector])
    rel = F.col("score") if rerank is not None else F.coalesce(1 - cosine_distance(F.col("emb"), q), F.lit(0.0))
    rows = placed.join(first, "id", "left").select("id", "place", rel.alias("rel"), "emb").orderBy("place").collect()  # without limits as many as are reached
    chosen = mmr([(r.id, r.rel, r.emb) for r in rows], mmr_k, lam)
    return corpus.nodes.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(chosen)], "id string, place int")
