"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all ordered thresholds. Grades: 0 not toxic, 1 toxic,
2 severe. Labels say toxic or not; of the toxic ones those are severe whose share of telling words (words at least
TELLING times as frequent in toxic as in other documents) is the median of them or more. Telling words are found in one
half of the documents and grade the other half, so that no document is graded by words it made telling itself; severity
beyond toxic or not is thus a reading of the words, which no label confirms. Features are the words of the
whole text, without case and outer punctuation, whose rates in the two classes differ by MIN_Z deviations or more, at most
FEATURES of them: their presence and their share. The fit is on at most FIT_DOCS labelled documents, chosen by a hash of the id, and
at most FIT_WORDS distinct words of each (those of the smallest hashes); every document is scored on its whole text.

Null or empty text has no features and gets the severity of an empty text. Rows that repeat an id are scored each; the
fit takes one of their texts.
Labels of documents that are absent or null are ignored; with one class only, or no labels, severity is the share of
toxic labels. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import map_rows, read

FIT_DOCS, FIT_WORDS = 12_000, 4_096
FEATURES, TELLING, MIN_DF, MIN_Z, STEPS = 2_000, 8.0, 3, 4.0, 400
EDGES = ".,;:!?\"'()[]{}«»¡¿…-_*#$%&|<>"


class Words(dict):
    """Hash of a word without case and outer punctuation, by the raw word; 0 for none."""

    def __missing__(self, raw: str) -> int:
        if len(self) > 400_000:
            self.clear()
        word = raw.strip(EDGES).lower()
        h = self[raw] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) if word else 0
        return h


def bag(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct word hashes, their counts, and the number of words."""
    raw = text.split() if text else []
    h, n = np.unique(np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw)), return_counts=True)
    if len(h) and h[0] == 0:
        h, n = h[1:], n[1:]
    return h, n, int(n.sum())


class Ordinal:
    """Weights over (presence, share) of the chosen words, and the ordered thresholds."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> None:
        self.words, self.weights = np.empty(0, np.uint64), np.zeros(0)
        share = float(toxic.mean()) if len(toxic) else 0.0
        # with nothing to tell the classes apart, expected severity is the share of toxic labels
        self.thresholds = np.array([-np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 30.0])
        if not 0 < share < 1:
            return
        h = np.concatenate([b[0] for b in bags])
        owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        u, inv = np.unique(h, return_inverse=True)
        df = np.bincount(inv)
        df1 = np.bincount(inv, weights=toxic[owner])
        n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
        rate1, rate0 = (df1 + 0.5) / (n1 + 1), (df - df1 + 0.5) / (n0 + 1)
        rate = df / len(toxic)
        z = np.abs(df1 / n1 - (df - df1) / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
        gain = np.where((df >= MIN_DF) & (z >= MIN_Z), np.abs(np.log(rate1 / rate0)) * z, 0)
        best = np.sort(np.argsort(-gain, kind="stable")[: min(FEATURES, int((gain > 0).sum()))])
        self.words = u[best]
        part = np.zeros(len(bags))
        for half in (0, 1):
            other = np.arange(len(bags)) % 2 != half
            n1, n0 = (toxic[other] == 1).sum(), (toxic[other] == 0).sum()
            there = other[owner]
            d, d1 = np.bincount(inv[there], minlength=len(u)), np.bincount(inv[there], weights=toxic[owner[there]], minlength=len(u))
            known = u[((d1 + 0.5) / (n1 + 1) >= TELLING * (d - d1 + 0.5) / (n0 + 1)) & (d >= MIN_DF)]
            for i in np.flatnonzero(~other & (toxic == 1)):
                part[i] = bags[i][1][np.isin(bags[i][0], known)].sum() / max(1, bags[i][2])
        grade = toxic.astype(int)
        grade[(toxic == 1) & (part >= np.median(part[toxic == 1])) & (part > 0)] = 2
        self.fit([self.features(*b) for b in bags], grade)

    def features(self, h: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.empty(0, int), np.empty(0)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        at = at[hit]
        return np.concatenate([at, at + len(self.words)]), np.concatenate([np.ones(len(at)), np.log1p(1000.0 * n[hit] / max(1, total)) / 3])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray) -> None:
        col, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        w = np.zeros(2 * len(self.words))
        # theta_0 and log(theta_1 - theta_0), from the grades' shares
        rate = np.clip([(grade == 0).mean(), (grade <= 1).mean()], 1e-3, 1 - 1e-3)
        t = np.log(rate / (1 - rate))
        p = np.concatenate([w, [t[0], np.log(max(t[1] - t[0], 0.1))]])
        m, v = np.zeros_like(p), np.zeros_like(p)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        for step in range(1, STEPS + 1):
            w, a, gap = p[:-2], p[-2], np.exp(p[-1])
            s = np.bincount(row, weights=val * w[col], minlength=len(rows))
            c0, c1 = sig(a - s), sig(a + gap - s)
            d0, d1 = c0 * (1 - c0), c1 * (1 - c1)
            prob = np.maximum(np.select([grade == 0, grade == 1], [c0, c1 - c0], 1 - c1), 1e-12)
            # derivatives of the log likelihood by the two thresholds
            g0 = np.select([grade == 0, grade == 1], [d0, -d0], 0) / prob
            g1 = np.select([grade == 1, grade == 2], [d1, -d1], 0) / prob
            n = len(rows)
            grad = np.concatenate([np.bincount(col, weights=val * (g0 + g1)[row], minlength=len(w)) / n + 1e-4 * w, [-(g0 + g1).mean(), -(g1 * gap).mean()]])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.thresholds = p[:-2], np.array([p[-2], p[-2] + np.exp(p[-1])])

    def above(self, h: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2)."""
        col, val = self.features(h, n, total)
        s = float((self.weights[col] * val).sum()) if len(col) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> Ordinal:
    spark = docs.sparkSession
    # a bounded sample, by a hash of the id
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            bags = [bag(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0][:FIT_WORDS].tobytes() for x in bags]), pa.array([x[1][:FIT_WORDS].tobytes() for x in bags]), pa.array([x[2] for x in bags], pa.int64())], names=["doc_id", "toxic", "h", "n", "total"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, h binary, n binary, total long")
    # no more than FIT_DOCS rows of FIT_WORDS words
    rows = sorted(rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "n", "total")).alias("bag")).collect(), key=lambda r: r.doc_id)
    bags = [(np.frombuffer(r.bag.h, np.uint64), np.frombuffer(r.bag.n, np.int64), r.bag.total) for r in rows]
    return Ordinal(bags, np.array([min(1, max(0, r.toxic)) for r in rows], float))


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        words = Words()
        for r in rows:
            p1, p2 = shared.value.above(*bag(r["text"], words))
            yield {"doc_id": r["doc_id"], "severity": float(p1 + p2), "grade": int(p1 >= 0.5) + int(p2 >= 0.5), "toxic": bool(p1 >= 0.5)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, severity double, grade int, toxic boolean")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
