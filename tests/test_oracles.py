"""Queries against their SQL on tables made to tell them apart."""

import pathlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tesserae import queries_more  # noqa: F401  registers its queries
from tesserae.queries import ORACLES, QUERIES


def differ(spark, d, name):
    """Rows only in the SQL's result, and only in the query's."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, str(d))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(want) == len(set(want)) and len(got) == len(set(got)) and want
    return set(want) - set(got), set(got) - set(want)


def corpus(d, docs, vectors):
    """docs: (doc_id, text, source); vectors: (vec_id, embedding)."""
    pq.write_table(pa.table({"doc_id": [x[0] for x in docs], "text": [x[1] for x in docs], "lang": ["en"] * len(docs), "source": [x[2] for x in docs], "n_chars": [len(x[1]) for x in docs]}), d / "documents.parquet")
    pq.write_table(pa.table({"vec_id": [x[0] for x in vectors], "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32()))}), d / "embeddings.parquet")


def test_hybrid_walk_orders_equal_scores_by_name(spark, tmp_path):
    # three ids of each leg; the third places of both legs have one score, and 5 seeds take one of them: d:10 before d:9
    docs = [(i, f"{'the ' * n}{'x ' * (20 - n)}", f"s{i}") for i, n in ((3, 9), (4, 7), (9, 5))] + [(i, "x", f"s{i}") for i in (0, 5, 10)]
    corpus(tmp_path, docs, [(0, [1.0, 0.0]), (5, [1.0, 0.1]), (10, [1.0, 0.2])])
    assert differ(spark, tmp_path, "hybrid_walk") == (set(), set())


def test_retrieval_passes_busy_nodes_and_keeps_all_rows(spark, tmp_path):
    # d:1 has an edge from each of 12,500 documents, more than the limits of fan-out and of rows that operators have by default
    docs = [(1, "the", "s")] + [(400 * i, "of x" if i % 2 else "thinking", "s") for i in range(12_500)]
    corpus(tmp_path, docs, [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (400, [1.0, 0.2]), (800, [1.0, 0.3])])
    for name in ("retrieve_walk", "hybrid_retrieve", "hybrid_reranked"):
        assert differ(spark, tmp_path, name) == (set(), set()), name
