"""Change feed, outbox, triggers, dead letters."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTBOX = "seq long, op string, entity string, id string, label string, src string, dst string, shape string, ts long, source string"
DEAD = "id string, subscription string, trigger string, seq long, event string, error string, attempts int, created_at long"


def change_feed(versions: DataFrame, cursor: int, limit: int = 100) -> DataFrame:
    """Rows past the cursor in ver order."""
    return versions.filter(F.col("ver") > cursor).orderBy("ver").limit(limit)


def feed_page(nodes: DataFrame, edges: DataFrame, cursors: tuple[int | None, int | None], limit: int = 100) -> tuple[list, list, tuple[int | None, int | None]]:
    """The next rows of both streams, each with a cursor of its own; a cursor is None when its stream is drained."""
    pages, after = [], []
    for versions, cursor in zip((nodes, edges), cursors, strict=True):
        rows = change_feed(versions, cursor, limit).collect() if cursor is not None else []
        pages.append(rows)
        after.append(rows[-1].ver if len(rows) == limit else None)
    return pages[0], pages[1], (after[0], after[1])


def outbox_tail(outbox: DataFrame, cursor: int, entity: str | None = None, ops: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    rows = outbox.filter(F.col("seq") > cursor)
    rows = rows.filter(F.col("entity") == entity) if entity else rows
    rows = rows.filter(F.col("op").isin(*ops)) if ops else rows
    return rows.orderBy("seq").limit(limit)


def outbox_head(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("seq"))


def prune_outbox(outbox: DataFrame, below: int) -> DataFrame:
    """What stays: events from seq `below` on."""
    return outbox.filter(F.col("seq") >= below)


def matching(outbox: DataFrame, ops: tuple[str, ...] = (), entity: str | None = None, label: str | None = None, shape: str | None = None, source: str | None = None) -> DataFrame:
    """Events a subscription gets; without a source, those that no trigger made."""
    rows = outbox.filter(F.col("op").isin(*ops)) if ops else outbox
    for c, v in (("entity", entity), ("label", label), ("shape", shape)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return rows.filter(F.col("source") == source) if source else rows.filter(F.col("source").isNull())


def deliver(batch: DataFrame, action: Callable[[dict], None], dead: str, subscription: str, trigger: str, attempts: int, now: Callable[[], int]) -> None:
    """Calls action for every row, on the executors, row by row in seq order within a task; rows on which it failed
    `attempts` times in a row are appended to the dead letters. A lost task delivers its rows again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            failed = []
            for row in f.sort_values("seq").to_dict("records"):
                event = {k: None if pd.isna(v) else v for k, v in row.items()}
                for attempt in range(1, attempts + 1):
                    try:
                        action(event)
                        break
                    except Exception as e:  # noqa: BLE001  whatever an action raises is its failure
                        if attempt == attempts:
                            text = json.dumps(event, default=int)
                            key = hashlib.sha256(f"{subscription}:{event['seq']}".encode()).hexdigest()[:24]
                            failed.append((key, subscription, trigger, int(event["seq"]), text, f"{type(e).__name__}: {e}", attempts, now()))
            yield pd.DataFrame(failed, columns=["id", "subscription", "trigger", "seq", "event", "error", "attempts", "created_at"])

    batch.mapInPandas(run, DEAD).write.mode("append").parquet(dead)


def run_triggers(events: DataFrame, action: Callable[[dict], None], checkpoint: str, dead: str, subscription: str = "triggers", trigger: str = "action", attempts: int = 3, now: Callable[[], int] = lambda: 0, **match) -> None:
    """Delivers the matching events of a stream at least once. The checkpoint is the subscription's cursor; action should
    ignore a seq it has seen. It runs on executors, so it must be picklable and reach whatever it changes from there."""

    def batch(rows: DataFrame, _: int) -> None:
        deliver(matching(rows, **match), action, dead, subscription, trigger, attempts, now)

    events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dead_letters(letters: DataFrame, subscription: str | None = None, since: int | None = None, limit: int = 100) -> DataFrame:
    """Newest first. A letter written twice, as its task was lost in between, is one."""
    rows = letters.dropDuplicates(["id"])
    rows = rows.filter(F.col("subscription") == subscription) if subscription is not None else rows
    rows = rows.filter(F.col("created_at") >= since) if since is not None else rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def prune_dead_letters(letters: DataFrame, before: int) -> DataFrame:
    """What stays."""
    if isinstance(before, bool) or not isinstance(before, int):
        raise ValueError("an instant is a whole number of milliseconds")
    return letters.filter(F.col("created_at") >= before)


def webhook_request(event: dict, secret: str | None = None, headers: dict[str, str] | None = None) -> tuple[bytes, dict[str, str]]:
    """Body and headers of an event's delivery; the signature is HMAC-SHA256 over the body and cannot be displaced."""
    body = json.dumps(event, separators=(",", ":")).encode()
    out = {"content-type": "application/json", "x-event": str(event.get("op", "")), "x-seq": str(event.get("seq", "")), **(headers or {})}
    if secret is not None:
        out["x-signature"] = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return body, out


def webhook_action(send: Callable[[bytes, dict[str, str]], int], secret: str | None = None) -> Callable[[dict], None]:
    """An action that sends events by send(body, headers) -> status; a status outside 200 to 299 is a failure."""

    def action(event: dict) -> None:
        status = send(*webhook_request(event, secret))
        if not 200 <= status < 300:
            raise RuntimeError(f"the receiver responded {status}")

    return action


def to_embed(events: DataFrame, inputs: DataFrame) -> DataFrame:
    """(id, text) of live nodes that untagged inserts touched: what a lazy embedding trigger is to embed."""
    ids = matching(events, entity="node", shape="insert").select("id").distinct()
    return inputs.join(ids, "id", "left_semi")


def state_at_event(events: DataFrame, versions: DataFrame) -> DataFrame:
    """events with the data that held when they took place: for a close, just before it."""
    at = events.withColumn("_at", F.when(F.col("shape") == "close", F.col("ts") - 1).otherwise(F.col("ts")))
    believed = versions.filter(F.col("recorded_to") == 8640000000000000).select(F.col("id").alias("_id"), F.col("data").alias("state"), F.col("valid_from").alias("_vf"), F.col("valid_to").alias("_vt"))
    held = (F.col("id") == F.col("_id")) & (F.col("_vf") <= F.col("_at")) & (F.col("_vt") > F.col("_at"))
    return at.join(believed, held, "left").drop("_at", "_id", "_vf", "_vt")


def triggered_if(events: DataFrame, versions: DataFrame, judge: Callable[[list[str]], list[float]], least: float = 0.5) -> DataFrame:
    """Events whose state the judge, asked in batches, finds to meet the condition with probability `least` or more."""
    from tesserae.operators.judge import judge_filter

    return judge_filter(state_at_event(events, versions).filter("state is not null"), judge, "state", least)


def watch(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """A stream of files as they appear or change: key, content, modified; ingest it by foreachBatch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("modified"))


class Bus:
    """Listeners of events in the driver; what is published within `source` carries it."""

    def __init__(self) -> None:
        self._listeners: list[tuple[Callable[[dict], bool], Callable[[dict], None]]] = []
        self._source: str | None = None

    def subscribe(self, listener: Callable[[dict], None], where: Callable[[dict], bool] = lambda e: True) -> Callable[[], None]:
        entry = (where, listener)
        self._listeners.append(entry)
        return lambda: self._listeners.remove(entry) if entry in self._listeners else None

    def publish(self, event: dict) -> None:
        event = event if self._source is None else {**event, "source": self._source}
        for where, listener in list(self._listeners):
            if where(event):
                listener(event)

    def with_source(self, source: str, run: Callable[[], None]) -> None:
        before, self._source = self._source, source
        try:
            run()
        finally:
            self._source = before
