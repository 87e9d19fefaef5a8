"""Corpus pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Rows that repeat an id are one document to the Jaccard stage and stay or go together. Null texts fail the
quality rules; rows with null ids pass the Jaccard stage, as they are linked with nothing. Each stage reads and writes
texts of any length. An empty table gives an empty result. Columns besides those of documents are kept until the last
stage, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import materialize, read
from tesserae.llm.jaccard import jaccard_components
from tesserae.llm.lines import dedup_lines
from tesserae.llm.mixing import mix
from tesserae.llm.quality import keep_good
from tesserae.llm.spm import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word sets (similarity 0.8 or more) join, the one with the smallest id stays."""
    found = jaccard_components(docs, 5, 80, 100)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing sources", mix_sources), ("SentencePiece", sentencepiece)]
#: Perplexity, edit distance and tokens are not for SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
