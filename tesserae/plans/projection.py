"""The graph that the driver's tables project to, in SQL that both Spark and DuckDB read.

@t stands for table t, MS(x) for epoch milliseconds, JSONK(x) for the text of key k.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tesserae.model import FOREVER

ALWAYS = f"CAST(0 AS BIGINT) AS valid_from, CAST({FOREVER} AS BIGINT) AS valid_to"
BELIEVED = f"CAST(0 AS BIGINT) AS recorded_from, CAST({FOREVER} AS BIGINT) AS recorded_to"

PARTS = {
    "nodes": f"""
SELECT 'r:' || r_regionkey AS id, 'region' AS type, '{{"name":"' || r_name || '"}}' AS data, {ALWAYS}, {BELIEVED} FROM @region
UNION ALL SELECT 'n:' || n_nationkey, 'nation', '{{"name":"' || n_name || '"}}', {ALWAYS}, {BELIEVED} FROM @nation
UNION ALL SELECT 's:' || s_suppkey, 'supplier', '{{"name":"' || s_name || '"}}', {ALWAYS}, {BELIEVED} FROM @supplier
UNION ALL SELECT 'c:' || c_custkey, 'customer', '{{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}}', {ALWAYS}, {BELIEVED} FROM @customer
UNION ALL SELECT 'p:' || p_partkey, 'part', '{{"name":" ' || p_name || ' ","kind":"' || p_type || '"}}', {ALWAYS}, {BELIEVED} FROM @part
UNION ALL SELECT 'o:' || o_orderkey, 'order', '{{"status":"' || o_orderstatus || '"}}', MS(o_orderdate), CAST({FOREVER} AS BIGINT), {BELIEVED} FROM @orders""",
    "edges": f"""
SELECT 'e:placed:' || o_orderkey AS id, 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'placed' AS rel, CAST(1 AS DOUBLE) AS weight, MS(o_orderdate) AS valid_from, MS(o_orderdate) + 7776000000 AS valid_to, {BELIEVED} FROM @orders
UNION ALL SELECT 'e:contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'o:' || l_orderkey, 'p:' || l_partkey, 'contains', l_quantity, MS(l_shipdate), CAST({FOREVER} AS BIGINT), {BELIEVED} FROM @lineitem
UNION ALL SELECT DISTINCT 'e:by:' || l_partkey || ':' || l_suppkey, 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by', CAST(1 AS DOUBLE), {ALWAYS}, {BELIEVED} FROM @lineitem
UNION ALL SELECT 'e:cn:' || c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'in_nation', CAST(1 AS DOUBLE), {ALWAYS}, {BELIEVED} FROM @customer
UNION ALL SELECT 'e:sn:' || s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'in_nation', CAST(1 AS DOUBLE), {ALWAYS}, {BELIEVED} FROM @supplier
UNION ALL SELECT 'e:nr:' || n_nationkey, 'n:' || n_nationkey, 'r:' || n_regionkey, 'in_region', CAST(1 AS DOUBLE), {ALWAYS}, {BELIEVED} FROM @nation""",
    "versions": f"""
SELECT event_id AS ver, 'u:' || user_id AS id, 'user' AS type, '{{"event":"' || event_type || '","k":"' || coalesce(JSONK(props), '') || '"}}' AS data,
  MS(ts) AS valid_from, coalesce(lead(MS(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), {FOREVER}) AS valid_to,
  MS(ts) + (event_id % 7) * 3600000 AS recorded_from, CASE WHEN event_id % 5 = 0 THEN MS(ts) + (event_id % 7) * 3600000 + 86400000 ELSE {FOREVER} END AS recorded_to
FROM @events""",
    "links": f"""
SELECT * FROM (SELECT 'u:' || user_id AS src, lead('u:' || user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, CAST(1 + event_id % 9 AS DOUBLE) AS weight,
  MS(ts) AS valid_from, MS(ts) + 172800000 AS valid_to, {BELIEVED} FROM @events) WHERE dst IS NOT NULL AND src <> dst""",
    "docs": f"""
SELECT doc_id AS ver, 'd:' || doc_id AS id, lang AS type, text AS body, 'doc:' || source || '/' || doc_id AS uri, CAST(NULL AS STRING) AS content_hash, 'text/plain' AS content_type,
  '{{"source":"' || source || '","n":' || n_chars || '}}' AS data, doc_id % 50 * 1000 AS valid_from, CASE WHEN doc_id % 7 = 0 THEN 100000 + doc_id ELSE {FOREVER} END AS valid_to, {BELIEVED} FROM @documents""",
    "tables": f"""
SELECT c_custkey AS ver, 'c:' || c_custkey AS id, 'customer' AS type, CASE c_custkey % 6 WHEN 0 THEN '{{"name":5,"title":"  T' || c_custkey || ' ","image":7,"avatar":" https://x/' || c_custkey || '.png "}}'
  WHEN 1 THEN '{{"name":"","displayName":"D' || c_custkey || '","icon":"javascript:x"}}' WHEN 2 THEN '{{"slug":"s","heading":"H"}}' WHEN 3 THEN '{{"name":["a"],"photo":"HTTP://y/z"}}' WHEN 4 THEN '{{"id":"no","code":"no"}}'
  ELSE '{{"name":"' || c_name || '","derived":{{"wins":' || c_custkey % 17 || '}}}}' END AS data, {ALWAYS}, {BELIEVED} FROM @customer""",
    "outbox": """
SELECT event_id + 1 AS seq, event_type AS op, CASE WHEN event_id % 3 = 0 THEN 'edge' ELSE 'node' END AS entity, 'u:' || user_id AS id, event_type AS label,
  CASE WHEN event_id % 4 = 0 THEN 'close' ELSE 'insert' END AS shape, MS(ts) AS ts, CASE WHEN event_id % 6 = 0 THEN 'trigger' END AS source FROM @events""",
}


def _write(sql: str, dialect: str) -> str:
    ms, key = ("unix_millis(CAST({} AS TIMESTAMP))", "get_json_object({}, '$.k')") if dialect == "spark" else ("(epoch_us({}) // 1000)", "json_extract_string({}, '$.k')")
    sql = re.sub(r"MS\((\w+)\)", lambda m: ms.format(m[1]), sql)
    sql = re.sub(r"JSONK\((\w+)\)", lambda m: key.format(m[1]), sql)
    return re.sub(r"@(\w+)", "{\\1}" if dialect == "spark" else "\\1", sql)


def project(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    sql = PARTS[part]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"@(\w+)", sql))}
    # braces of JSON text are doubled, as the names of tables stand in braces
    text = _write(sql.replace("{", "{{").replace("}", "}}"), "spark")
    return spark.sql(text, **tables)


def oracle(body: str) -> str:
    """body with the projection's parts that it names as common table expressions before it."""
    named = [p for p in PARTS if re.search(rf"\b{p}\b", body)]
    ctes = ", ".join(f"{p} AS ({_write(PARTS[p], 'duckdb')})" for p in named)
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        rest = rest[5:]
        return f"WITH RECURSIVE {ctes + ', ' if ctes else ''}{rest}"
    return f"WITH RECURSIVE {ctes} {rest}" if ctes else rest
