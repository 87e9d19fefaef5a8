"""Listings, keyset pages, slices of the graph."""

from __future__ import annotations

import base64
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserae.model import LIVE, TimeSlice
from tesserae.operators.text import fts_filter

T = TypeVar("T")


@dataclass(frozen=True)
class Limits:
    max_rows: int = 10_000
    max_fanout: int = 1_000
    timeout_ms: float = float("inf")

    def __post_init__(self) -> None:
        for v in (self.max_rows, self.max_fanout):
            if isinstance(v, bool) or not isinstance(v, int) or v < 1:
                raise ValueError("row and fan-out limits are whole numbers above 0")
        if not self.timeout_ms > 0:
            raise ValueError("a time limit is above 0 (infinite: none)")


LIMITS = Limits()


class QueryTimeout(TimeoutError):
    pass


def with_timeout(spark: SparkSession, limits: Limits, run: Callable[[], T]) -> T:
    """run(), whose Spark jobs are cancelled when the limit has passed."""
    if limits.timeout_ms == float("inf"):
        return run()
    sc, group, late = spark.sparkContext, f"timed-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer = threading.Timer(limits.timeout_ms / 1000, stop)
    timer.start()
    try:
        return run()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"stopped after {limits.timeout_ms} ms") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def measured(df: DataFrame, name: str, sink: Callable[[str, str, float], None], limits: Limits = LIMITS) -> list:
    """The rows of df, with its time and row count told to sink(kind, name, value); `slow` past half the time limit."""
    seen, start = Observation(name), time.monotonic()
    rows = with_timeout(df.sparkSession, limits, lambda: df.observe(seen, F.count(F.lit(1)).alias("rows")).collect())
    ms = 1000 * (time.monotonic() - start)
    sink("histogram", f"{name}.ms", ms)
    sink("gauge", f"{name}.rows", seen.get["rows"])
    sink("counter", f"{name}.calls", 1)
    if ms > limits.timeout_ms / 2:
        sink("counter", f"{name}.slow", 1)
    return rows


def encode_cursor(keys: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps(keys).encode()).decode()


def decode_cursor(cursor: str) -> list[str]:
    try:
        keys = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(keys, list) or not all(isinstance(k, str) for k in keys):
        raise ValueError("invalid cursor")
    return keys


def after(keys: list[str], values: list[str]) -> Column:
    """Row-value comparison (keys) > (values), as an OR over columns, which reaches the scan."""
    out, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, values, strict=True):
        out, equal = out | (equal & (F.col(k) > v)), equal & (F.col(k) == v)
    return out


def page(df: DataFrame, keys: list[str], limit: int, cursor: str | None = None, limits: Limits = LIMITS) -> DataFrame:
    """The next rows by key, limit of them and no more than the row cap; TakeOrderedAndProject, no global sort."""
    if cursor:
        df = df.filter(after(keys, decode_cursor(cursor)))
    return df.orderBy(*keys).limit(min(limit, limits.max_rows))


def next_cursor(rows: list, keys: list[str], limit: int) -> str | None:
    """The cursor after a page that has been read; None if it was not full."""
    return encode_cursor([str(rows[-1][k]) for k in keys]) if len(rows) >= limit else None


def _listed(nodes: DataFrame, type: str | None, text: str | None, when: TimeSlice) -> DataFrame:
    rows = nodes.filter(when.predicate())
    rows = rows.filter(F.col("type") == type) if type else rows
    return rows if text is None else fts_filter(rows, text)


def list_nodes(nodes: DataFrame, type: str | None = None, when: TimeSlice = LIVE, limit: int = 100, cursor: str | None = None, text: str | None = None) -> DataFrame:
    """id, type, data of nodes by type and, if text is given, with any of its words in the body (no word: no node)."""
    return page(_listed(nodes, type, text, when), ["id"], limit, cursor).select("id", "type", "data")


def list_node_versions(nodes: DataFrame, type: str | None = None, when: TimeSlice = LIVE, limit: int = 100, cursor: str | None = None, text: str | None = None) -> DataFrame:
    """The same with every column and the revision."""
    return page(_listed(nodes, type, text, when), ["id"], limit, cursor).withColumn("revision", F.col("ver").cast("string"))


def list_edges(edges: DataFrame, rel: str | None = None, src: str | None = None, dst: str | None = None, when: TimeSlice = LIVE, limit: int = 100, cursor: str | None = None, source: str | None = None) -> DataFrame:
    rows = edges.filter(when.predicate())
    for c, v in (("rel", rel), ("src", src), ("dst", dst), ("source", source)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return page(rows, ["id"], limit, cursor)


def graph_slice(nodes: DataFrame, edges: DataFrame, max_rows: int, when: TimeSlice = LIVE) -> tuple[DataFrame, DataFrame]:
    """The first max_rows nodes, with `truncated` (the cap was met), and the edges with both ends among them."""
    some = nodes.filter(when.predicate()).orderBy("id").limit(max_rows)
    some = some.crossJoin(F.broadcast(some.agg((F.count("*") >= max_rows).alias("truncated"))))  # one row
    ids = some.select("id")
    inside = edges.filter(when.predicate()).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return some, inside


#: Keys that may hold a node's name and its picture, in order, and their greatest lengths.
LABEL_KEYS = ("name", "title", "label", "displayName", "display_name", "heading", "slug")
IMAGE_KEYS = ("image", "imageUrl", "image_url", "avatar", "avatarUrl", "avatar_url", "thumbnail", "icon", "photo")
LABEL_MAX, IMAGE_MAX = 80, 512


def string_at(data: Column, key: str) -> Column:
    """The trimmed text of a key if it holds a string (numbers, lists and objects do not count), else null."""
    v = F.try_variant_get(F.try_parse_json(data), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(F.try_parse_json(data), f"$.{key}", "string")))


def label(data: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    """First non-blank string among the keys, trimmed, at most LABEL_MAX characters."""
    return F.coalesce(*[F.nullif(F.substring(string_at(data, k), 1, LABEL_MAX), F.lit("")) for k in keys])


def image(data: Column, keys: tuple[str, ...] = IMAGE_KEYS) -> Column:
    """First string among the keys that is an http(s) address of at most IMAGE_MAX characters."""
    urls = [string_at(data, k) for k in keys]
    return F.coalesce(*[F.when(F.lower(u).rlike("^https?://") & (F.char_length(u) <= IMAGE_MAX), u) for u in urls])


def within_fanout(adjacency: DataFrame, max_fanout: int = 1_000) -> DataFrame:
    """Adjacency (a, b) of nodes that are expanded; filtered once, before any loop."""
    many = adjacency.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > max_fanout).select("a")
    return adjacency.join(many, "a", "left_anti")


def type_counts(nodes: DataFrame, when: TimeSlice = LIVE) -> DataFrame:
    return nodes.filter(when.predicate()).groupBy("type").agg(F.count("*").alias("n"))
