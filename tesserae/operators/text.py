"""Full-text retrieval: tokens, inverted index, BM25."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.model import persisted

#: Fixed values of the ranking function.
K1, B = 1.2, 0.75


def tokens(body: Column) -> Column:
    """Lower-cased runs of letters and numbers, duplicates kept."""
    return F.filter(F.split(F.lower(body), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def build_index(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (ver, body): docs (ver, len), terms (ver, term, tf), dict (term, df), stats (num_docs, avgdl)."""
    toks = docs.select("ver", tokens(F.col("body")).alias("toks")).filter("size(toks) > 0")
    lens = toks.select("ver", F.size("toks").cast("long").alias("len"))
    terms = toks.select("ver", F.explode("toks").alias("term")).groupBy("ver", "term").agg(F.count("*").alias("tf"))
    dictionary = terms.groupBy("term").agg(F.count("*").alias("df"))
    stats = lens.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return {"docs": lens, "terms": terms, "dict": dictionary, "stats": stats}


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The query's words, and how often each stands there. Signs that a search language might read are no words."""
    one = spark.createDataFrame([(query,)], "q string")
    return {r.term: r.times for r in one.select(F.explode(tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times")).collect()}


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """(ver, score) of documents with a word of the query; a repeated word counts as often as it stands there.

    One pass over the texts keeps each document's length and its words that the query has; statistics and scores come
    from those, without a shuffle."""
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.select("ver", F.lit(0.0).alias("score")).limit(0)
    toks = docs.select("ver", tokens(F.col("body")).alias("toks")).filter("size(toks) > 0")
    found = F.filter("toks", lambda t: t.isin(*terms))
    rows = persisted(toks.select("ver", F.size("toks").cast("long").alias("len"), found.alias("hits")))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    s = rows.filter("size(hits) > 0").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, (t, times) in enumerate(terms.items()):
        tf = F.size("hits") - F.size(F.array_remove("hits", t))
        idf = F.log10((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return s.select("ver", score.alias("score"))


def fts_filter(docs: DataFrame, query: str) -> DataFrame:
    """Documents with any word of the query; no word, no document."""
    words = list(query_terms(docs.sparkSession, query))
    return docs.filter(F.arrays_overlap(tokens(F.col("body")), F.array(*[F.lit(w) for w in words]))) if words else docs.limit(0)


@dataclass
class TextIndex:
    """An index of node versions that is built again when the versions have changed: their count or highest ver."""

    signature: tuple[int, int | None] | None = None
    parts: dict[str, DataFrame] = field(default_factory=dict)

    def fresh(self, versions: DataFrame) -> dict[str, DataFrame]:
        now = versions.agg(F.count("*").alias("n"), F.max("ver").alias("ver")).first()
        if (now.n, now.ver) != self.signature:
            built = build_index(versions.select("ver", "body"))
            terms = persisted(built["terms"])
            docs = persisted(built["docs"])
            stats = docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
            self.parts = {"terms": terms, "docs": docs, "dict": terms.groupBy("term").agg(F.count("*").alias("df")), "stats": stats}
            self.signature = (now.n, now.ver)
        return self.parts

    def search(self, versions: DataFrame, query: str) -> DataFrame:
        """The same scores as bm25() has, from the index: only the query's terms are read."""
        parts, terms = self.fresh(versions), query_terms(versions.sparkSession, query)
        if not terms:
            return parts["docs"].select("ver", F.lit(0.0).alias("score")).limit(0)
        q = F.broadcast(versions.sparkSession.createDataFrame(list(terms.items()), "term string, times long"))  # the query's words
        hits = parts["terms"].filter(F.col("term").isin(*terms)).join(q, "term")
        df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each of them
        s = hits.join(df, "term").join(parts["docs"], "ver").crossJoin(F.broadcast(parts["stats"]))
        idf = F.log10((F.col("num_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        return s.groupBy("ver").agg(F.sum(part).alias("score"))
