"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text (a blob). The ledger has a row for each blob and
rule version scanned, with what was found. A scan takes the blobs that the ledger lacks for the rules' version, scans
each once, appends to the ledger, and joins findings back to all paths. Findings are spans in code points.

Null text is the empty text. Rows that repeat an id are paths of their own. Other columns are ignored. A ledger that
does not exist yet is an empty one; a blob that was appended twice (a run that was lost in between) counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import lookup, materialize, read, shared_dir


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """pattern: as Java and RE2 both read it. group: of which at least `least` characters are asked (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),  # runs of 24 or more, which are whole runs as matches start leftmost
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]*"),
)
RULES, VERSION = BASE + MORE, "2"
LEDGER = "blob string, rule_version string, spans array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: str, rule: Rule, rank: int) -> str:
    """SQL for the spans of one rule: leftmost matches, placed by the lengths of what stands between them."""
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    item = f"struct(acc.at + length(parts[i]) as start, {rank} as rank, acc.at + length(parts[i]) + length(found[i]) as end, '{rule.kind}' as kind)"
    ok = f"length({'found' if not rule.group else 'groups'}[i]) >= {rule.least}"
    zero = "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>))"
    step = f"named_struct('at', acc.at + length(parts[i]) + length(found[i]), 'out', if({ok}, array_append(acc.out, {item}), acc.out))"
    fold = f"aggregate(sequence(0, size(found) - 1), {zero}, (acc, i) -> {step}).out"
    groups = f"transform(array(regexp_extract_all({text}, '{p}', {rule.group})), groups -> {fold})[0]" if rule.group else fold
    placed = f"transform(array(split({text}, '{p}', -1)), parts -> {groups})[0]"
    return f"transform(array(regexp_extract_all({text}, '{p}', 0)), found -> if(size(found) = 0, {zero}.out, {placed}))[0]"


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of (blob, text)."""
    parts = ", ".join(spans_of("text", r, i) for i, r in enumerate(rules))
    return blobs.select("blob", F.expr(f"sort_array(concat({parts}))").alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """doc_id, blob, spans for every row of versions; the ledger grows by the blobs it lacked."""
    spark = versions.sparkSession
    rows = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialize(rows.select("doc_id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("at"), F.count("*").alias("paths"))
    seen = read_ledger(spark, ledger).filter(F.col("rule_version") == version).select("blob")
    unseen = blobs.join(seen, "blob", "left_anti").select(F.col("blob").alias("b"), "at")
    fresh = rows.join(unseen, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("at"))).select("blob", "text")
    found = scan_texts(fresh, rules).select("blob", F.lit(version).alias("rule_version"), "spans")
    found = materialize(found, "found")
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).filter(F.col("rule_version") == version).filter("size(spans) > 0").dropDuplicates(["blob"]).select("blob", "spans")
    hits = lookup(paths, known.join(blobs, "blob").select("blob", "paths", "spans"), "blob", "paths", F.col("doc_id"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return hits.select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[of(r.kind) for r in BASE], F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))


def _oracle() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        keep = f"len(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, start, start + len(m[i]) AS stop FROM (
          SELECT doc_id, m, i, (list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))::BIGINT AS start
          FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_split_to_array(t, '{p}') AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
          )) WHERE {keep}""")
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
    g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS k, count(*) FILTER (WHERE rank = 2) AS h,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE = _oracle()
