"""Stored vectors of live nodes: what is missing or stale, and bringing them up to date."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.model import LIVE
from tesserae.operators.vector import chunk_text, embed_hash

VECTORS = "id string, chunk int, text string, emb array<double>, embed_hash string"


def _wanted(inputs: DataFrame, model: str) -> DataFrame:
    """(id, text, hash) of live nodes with a text to embed; blank and null texts have no vector."""
    return inputs.select("id", "text").filter(F.trim("text") != "").withColumn("hash", embed_hash(model, F.col("text")))


def embedding_report(inputs: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row (live, embedded, unembedded, stale, vectors). inputs has (id, text) of each live node; nodes without
    a text are live, but neither unembedded nor stale."""
    held = vectors.groupBy("id").agg(F.max("embed_hash").alias("stored"), F.count("*").alias("n"))
    live = inputs.select("id", F.when(F.trim("text") != "", embed_hash(model, F.col("text"))).alias("hash"), F.lit(True).alias("live"))
    return live.join(held, "id", "full").agg(
        F.count("live").alias("live"),
        F.count("stored").alias("embedded"),
        F.count_if(F.col("hash").isNotNull() & F.col("stored").isNull()).alias("unembedded"),
        F.count_if(F.col("stored") != F.col("hash")).alias("stale"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"),
    )


def reembed(inputs: DataFrame, vectors: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], dim: int, size: int = 2_000, overlap: int = 0, batch: int = 64) -> DataFrame:
    """The vectors after every live node has been embedded: those of an unchanged text and model are kept, those of
    nodes no longer live go. embed gets at most batch texts a call; a vector of another width or with a component that
    is not finite fails the run."""
    wanted = _wanted(inputs, model)
    fresh = vectors.join(wanted.select("id", F.col("hash").alias("embed_hash")), ["id", "embed_hash"], "left_semi").select("id", "chunk", "text", "emb", "embed_hash")
    todo = wanted.join(fresh.select("id").distinct(), "id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pieces = [(i, n, piece, h) for i, text, h in zip(f.id, f.text, f.hash, strict=True) for n, piece in enumerate(chunk_text(text, size, overlap))]
            for lo in range(0, len(pieces), batch):
                part = pieces[lo : lo + batch]
                found = embed([p[2] for p in part])
                if len(found) != len(part) or any(len(v) != dim or not all(map(math.isfinite, v)) for v in found):
                    raise ValueError(f"the embedder must give one finite vector of width {dim} for each text")
                yield pd.DataFrame([(i, n, piece, list(map(float, v)), h) for (i, n, piece, h), v in zip(part, found, strict=True)], columns=["id", "chunk", "text", "emb", "embed_hash"])

    return fresh.unionByName(todo.mapInPandas(run, VECTORS))


@dataclass(frozen=True)
class Embedder:
    """An embedding function with its name and width. Texts are cut to max_chars and asked in batches."""

    model: str
    dim: int
    call: Callable[[list[str]], list[list[float]]]
    batch: int = 64
    max_chars: int = 8_000

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch):
            part = [t[: self.max_chars] for t in texts[lo : lo + self.batch]]
            got = self.call(part)
            if len(got) != len(part) or any(len(v) != self.dim or not all(map(math.isfinite, v)) for v in got):
                raise ValueError(f"{self.model} must give one finite vector of width {self.dim} for each text")
            out += [list(map(float, v)) for v in got]
        return out


def input_texts(nodes: DataFrame, policy: dict[str, Callable[[], Column]]) -> DataFrame:
    """(id, text) of live nodes: by type, the column that a policy makes of a node's row; the body for types without one.
    Blank texts are null: such nodes have no vector."""
    live = nodes.filter(LIVE.predicate())
    text = F.col("body")
    for type, make in policy.items():
        text = F.when(F.col("type") == type, make()).otherwise(text)
    return live.select("id", F.when(F.trim(text) != "", text).alias("text"))


class Recorded:
    """An embedder that keeps what another one said, and says it again without it: recordings are a JSON file of vectors by the
    hash of model and text."""

    def __init__(self, path: str, model: str, dim: int, live: Callable[[list[str]], list[list[float]]] | None = None) -> None:
        self.path, self.model, self.dim, self.live = path, model, dim, live
        self.known: dict[str, list[float]] = json.loads(Path(path).read_text()) if Path(path).exists() else {}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        keys = [hashlib.sha256(f"{self.model}\0{t}".encode()).hexdigest() for t in texts]
        new = [t for k, t in zip(keys, texts, strict=True) if k not in self.known]
        if new:
            if self.live is None:
                raise KeyError(f"no recording of {new[0]!r}")
            got = iter(self.live(new))
            self.known |= {k: next(got) for k in keys if k not in self.known}
            Path(self.path).write_text(json.dumps(self.known))
        return [self.known[k] for k in keys]
