"""Ingestion of notes: discovery, parsing, links, tags, embeds, resolution, reconciliation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.write import fresh

#: Fixed values of the notes' syntax.
TYPED = re.compile(r"\[([A-Za-z][\w-]*):: (?:\[\[([^\]|]+)(?:\|[^\]]*)?\]\]|\[[^\]]*\]\(([^)]+)\))\]", re.ASCII)
WIKI = re.compile(r"\[\[([^\]]+)\]\]")
MARKDOWN = re.compile(r"\[[^\]]*\]\(([^)]+)\)")
LINKS = "array<struct<kind:string,target:string,rel:string,fragment:string>>"


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


def discover(spark: SparkSession, folder: str, include: tuple[str, ...] = (".md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(key, raw) of the files under a folder, any that Spark reads, by their endings; hidden files and folders and keys that
    match an excluded pattern are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    key = F.substring("path", F.instr("path", f"{base}/") + F.lit(len(base) + 1), F.char_length("path"))
    rows = files.select(key.alias("key"), F.decode("content", "UTF-8").alias("raw"))
    rows = rows.filter(F.lower("key").rlike("(" + "|".join(re.escape(e.lower()) for e in include) + ")$")).filter(~F.col("key").rlike(r"(^|/)\."))
    for pattern in exclude:
        rows = rows.filter(~F.col("key").rlike(pattern))
    return rows


def parse(files: DataFrame) -> DataFrame:
    """(key, raw, hash, body_hash, front, body) of (key, raw). front is a map of the lines `name: value` between two lines ---
    at the head of a note, lists `[a, b]` and `- a` lines as their items parted by newlines; a .yaml file is all front."""
    front = F.when(F.col("key").rlike(r"(?i)\.ya?ml$"), F.col("raw")).otherwise(F.regexp_extract("raw", r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", 1))
    body = F.when(F.col("key").rlike(r"(?i)\.ya?ml$"), F.lit("")).otherwise(F.regexp_replace("raw", r"(?s)\A---[ \t]*\r?\n.*?---[ \t]*(?:\r?\n|\z)", ""))
    joined = F.regexp_replace(front, r"\r?\n[ \t]*-[ \t]+", "\u0000")  # items of a list stand with their name
    lines = F.filter(F.split(joined, "\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w -]*:"))
    bare = lambda x: F.regexp_replace(F.trim(x), "^([\"'])(.*)\\1$", "$2")

    def entry(line: Column) -> Column:
        name, rest = F.regexp_extract(line, r"^([^:]*):", 1), F.trim(F.regexp_replace(line, r"(?s)^[^:]*:", ""))
        listed = F.when(rest.rlike(r"(?s)^\[.*\]$"), F.split(F.regexp_replace(rest, r"^\[|\]$", ""), ",")).when(F.instr(rest, "\u0000") > 0, F.split(F.regexp_replace(rest, "^\u0000", ""), "\u0000"))
        return F.struct(F.trim(name).alias("key"), F.when(listed.isNull(), bare(rest)).otherwise(F.array_join(F.transform(listed, bare), "\n")).alias("value"))

    # of a name given twice the last one counts
    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return files.select("key", "raw", F.sha2("raw", 256).alias("hash"), F.sha2(body, 256).alias("body_hash"), F.map_from_entries(last).alias("front"), body.alias("body"))


def _target(raw: str, path: bool) -> tuple[str, str | None]:
    base, _, fragment = raw.partition("#")
    base, fragment = base.strip(), fragment.strip()
    return (unquote(base, errors="strict"), unquote(fragment) or None) if path else (base, fragment or None)


def _external(raw: str) -> bool:
    return not raw or raw.startswith(("http://", "https://", "#"))


def links_of(body: str, embeds: bool = False) -> list[dict]:
    """Links of a body in their order: wikilinks, relative Markdown links, and fields [name:: link], whose name is the
    relation. External links and anchors are none. With embeds, those behind an exclamation mark, else the others."""
    found, spans = [], []
    if not embeds:
        for m in TYPED.finditer(body):
            if m.start() and body[m.start() - 1] == "!":
                continue
            raw = (m[2] or m[3]).strip()
            if m[2] is None and _external(raw):
                continue
            target, fragment = _target(raw, m[2] is None)
            if target:
                spans.append(m.span())
                found.append((m.start(), {"kind": "wiki" if m[2] else "path", "target": target, "rel": m[1], "fragment": fragment}))
    for kind, pattern in (("wiki", WIKI), ("path", MARKDOWN)):
        for m in pattern.finditer(body):
            if (m.start() > 0 and body[m.start() - 1] == "!") != embeds or any(a <= m.start() < b for a, b in spans):
                continue
            raw = m[1].split("|")[0].strip() if kind == "wiki" else m[1].strip()
            if kind == "path" and _external(raw):
                continue
            target, fragment = _target(raw, kind == "path")
            if target:
                found.append((m.start(), {"kind": kind, "target": target, "rel": None, "fragment": fragment}))
    return [x for _, x in sorted(found, key=lambda x: x[0])]


def _with_links(notes: DataFrame, embeds: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "links": [links_of(b or "", embeds) for b in f.body]})

    rows = notes.select("path", "body").mapInPandas(run, f"path string, links {LINKS}")
    return rows.select("path", F.posexplode("links").alias("place", "x")).select("path", "place", "x.*")


def extract_links(notes: DataFrame) -> DataFrame:
    """(path, place, kind, target, rel, fragment) of notes (path, body)."""
    return _with_links(notes, False)


def extract_embeds(notes: DataFrame) -> DataFrame:
    return _with_links(notes, True)


def note_links(notes: DataFrame) -> DataFrame:
    """(path, target, kind) of wikilinks and Markdown links outside code fences; external links and anchors are left out."""
    body = F.regexp_replace(F.regexp_replace("body", "(?s)```.*?```", ""), "`[^`\n]*`", "")
    wiki = F.transform(F.regexp_extract_all(body, F.lit(r"(?<!!)\[\[([^\]|#\n]+)[^\]\n]*\]\]"), F.lit(1)), lambda t: F.struct(F.trim(t).alias("target"), F.lit("wiki").alias("kind")))
    md = F.transform(F.regexp_extract_all(body, F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)#\s]+)[^)\n]*\)"), F.lit(1)), lambda t: F.struct(t.alias("target"), F.lit("markdown").alias("kind")))
    links = notes.select("path", F.explode(F.concat(wiki, md)).alias("x")).select("path", "x.*")
    return links.filter(~F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"))


def note_tags(notes: DataFrame) -> DataFrame:
    """(path, tag): #tags outside code, wikilinks and link targets, not purely numeric, each once without regard to case, in
    its first spelling."""
    body = F.col("body")
    for mask in ("(?s)```.*?```", "`[^`\n]*`", r"!?\[\[[^\]]*\]\]", r"\]\([^)]*\)"):
        body = F.regexp_replace(body, mask, " ")
    tags = notes.select("path", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?<![\w#/])#([\w/-]*[A-Za-z_/-][\w/-]*)"), F.lit(1))).alias("place", "tag"))
    return tags.groupBy("path", F.lower("tag").alias("k")).agg(F.min_by("tag", "place").alias("tag")).select("path", "tag")


def _folder(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, "^(.*/)?[^/]*$", 1), "/$", "")


def _joined(folder: Column, target: Column) -> Column:
    """target as seen from folder, with . and .. followed."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/")
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (path, target[, kind]) with to and state (found, missing, ambiguous). files: (path[, aliases: array]).

    A Markdown link (kind path or markdown) is a path from its file's folder. A wikilink with a slash is a path from the
    root, else from its folder, with or without ending; one without is a file's name, else an alias, and of several
    files the one in the same folder, if there is one. Names are compared without regard to case."""
    no_ext = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    names = lambda full: F.array_distinct(F.array(F.lower(full), F.lower(no_ext(full))))
    f = files.select("path", F.col("aliases") if "aliases" in files.columns else F.array().cast("array<string>").alias("aliases"))
    by_path = f.select(F.explode(names(F.col("path"))).alias("_name"), F.col("path").alias("_to"))
    by_base = f.select(F.explode(names(base(F.col("path")))).alias("_name"), F.col("path").alias("_to"), F.lit(0).alias("_order"))
    alias = f.select(F.explode(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))))).alias("_name"), F.col("path").alias("_to"), F.lit(1).alias("_order"))
    kind = F.col("kind") if "kind" in links.columns else F.lit("wiki")
    want = links.withColumn("_kind", F.when(kind.isin("path", "markdown"), "path").when(F.instr("target", "/") > 0, "rooted").otherwise("bare")).distinct()
    keys = [c for c in links.columns]
    exact = want.filter("_kind = 'path'").withColumn("_at", _joined(_folder(F.col("path")), F.col("target"))).join(f.select(F.col("path").alias("_to")), F.col("_at") == F.col("_to"), "left").withColumn("_order", F.lit(0)).drop("_at")
    rooted = want.filter("_kind = 'rooted'").withColumn("_try", F.explode(F.array(F.struct(F.lit(0).alias("_order"), F.lower(F.trim("target")).alias("_name")), F.struct(F.lit(1).alias("_order"), F.lower(_joined(_folder(F.col("path")), F.col("target"))).alias("_name"))))).select("*", "_try.*").drop("_try")
    rooted = rooted.join(by_path, "_name", "left").drop("_name")
    bare = want.filter("_kind = 'bare'").withColumn("_name", F.lower(F.trim("target"))).join(by_base.unionByName(alias), "_name", "left").drop("_name")
    cols = [*keys, "_kind", "_to", "_order"]
    tried = exact.select(*cols).unionByName(rooted.select(*cols)).unionByName(bare.select(*cols))
    first = F.min(F.when(F.col("_to").isNotNull(), F.col("_order"))).over(W.partitionBy(*keys))
    hits = tried.withColumn("_first", first).filter(F.col("_first").isNull() | ((F.col("_order") == F.col("_first")) & F.col("_to").isNotNull()))
    near = F.when((_folder(F.col("_to")) == _folder(F.col("path"))) & (F.col("_kind") == "bare"), F.col("_to"))
    got = hits.groupBy(*keys).agg(F.collect_set("_to").alias("_all"), F.collect_set(near).alias("_near"))
    to = F.when(F.size("_all") == 1, F.col("_all")[0]).when(F.size("_near") == 1, F.col("_near")[0])
    state = F.when(to.isNotNull(), "found").when(F.size("_all") > 1, "ambiguous").otherwise("missing")
    return got.select(*keys, to.alias("to"), state.alias("state"))


def stable_json(data: Column) -> Column:
    """A JSON text with the keys of every object sorted, so that equal data are equal texts."""
    return F.to_json(F.try_parse_json(data))


def reconcile(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(src, rel, dst, action): add, close, drift (other data) or keep, of edges (src, rel, dst, data)."""
    d, v = desired.withColumnRenamed("data", "want"), live.withColumnRenamed("data", "have")
    j = d.withColumn("_d", F.lit(1)).join(v.withColumn("_v", F.lit(1)), ["src", "rel", "dst"], "full_outer")
    same = F.col("want").eqNullSafe(F.col("have")) | F.coalesce(stable_json(F.col("want")) == stable_json(F.col("have")), F.lit(False))
    action = F.when(F.col("_v").isNull(), "add").when(F.col("_d").isNull(), "close").when(~same, "drift").otherwise("keep")
    return j.select("src", "rel", "dst", action.alias("action"))


def ingest_notes(files: DataFrame, nodes: DataFrame, source: str, type_of: Column, types: tuple[str, ...], now: int, link_rel: str = "links") -> dict[str, DataFrame]:
    """What one run over files (key, raw) does: `nodes` to add or update (id, type, data, body, uri, content_hash, action),
    `edges` desired (src, rel, dst, data, source), and `skipped` (key, stage, code, reason).

    A file's identity is `id:` of its front matter, else its key; of several files with one identity the first by key
    counts. type_of is a column over parse()'s rows. A file whose hash is that of its live node is unchanged."""
    p = parse(files).withColumn("type", type_of)
    ident = F.coalesce(F.concat(F.lit("id:"), F.try_element_at("front", F.lit("id"))), F.concat(F.lit("file:"), F.lit(f"{source}/"), F.col("key")))
    p = p.withColumn("id", ident).withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy("key")))
    known = F.coalesce(F.col("type").isin(*types), F.lit(False))
    skip = lambda rows, stage, code, reason: rows.select("key", F.lit(stage).alias("stage"), F.lit(code).alias("code"), reason.alias("reason"))
    skipped = skip(p.filter(~known), "type", "unknown-type", F.concat(F.lit("no type "), F.coalesce("type", F.lit("at all"))))
    skipped = skipped.unionByName(skip(p.filter(known & (F.col("_rn") > 1)), "node", "duplicate-id", F.concat(F.lit("another file is "), F.col("id"))))
    good = p.filter(known & (F.col("_rn") == 1))
    live = nodes.filter("valid_to = 8640000000000000 and recorded_to = 8640000000000000").select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"))
    j = good.join(live, F.col("id") == F.col("_id"), "left")
    action = F.when(F.col("_id").isNull(), "add").when(F.col("_hash").eqNullSafe(F.col("hash")), "unchanged").otherwise("update")
    rows = j.select("key", "id", "type", F.to_json("front").alias("data"), "body", F.concat(F.lit(f"ingest:{source}:"), F.col("key")).alias("uri"), F.col("hash").alias("content_hash"), action.alias("action"))
    paths = good.select(F.col("key").alias("path"), F.split(F.coalesce(F.try_element_at("front", F.lit("aliases")), F.lit("")), "\n").alias("aliases"))
    links = extract_links(good.select(F.col("key").alias("path"), "body")).withColumn("rel", F.coalesce("rel", F.lit(link_rel)))
    got = resolve_links(links.select("path", "target", "kind", "rel").distinct(), paths)
    ids = good.select("key", "id")
    edges = got.filter("state = 'found'").join(ids.select(F.col("key").alias("path"), F.col("id").alias("src")), "path").join(ids.select(F.col("key").alias("to"), F.col("id").alias("dst")), "to")
    edges = edges.select("src", "rel", "dst", F.lit("{}").alias("data"), F.lit(source).alias("source")).distinct()
    lost = got.filter("state <> 'found'").select(F.col("path").alias("key"), F.lit("link").alias("stage"), F.col("state").alias("code"), F.concat(F.lit("link to "), F.col("target")).alias("reason"))
    return {"nodes": rows, "edges": edges, "skipped": skipped.unionByName(lost)}


def vanished(nodes: DataFrame, source: str, keys: DataFrame) -> DataFrame:
    """Live nodes of a source whose file is no longer among the keys: what a pruning run retracts."""
    prefix = f"ingest:{source}:"
    live = nodes.filter("valid_to = 8640000000000000 and recorded_to = 8640000000000000").filter(F.col("uri").startswith(prefix))
    return live.withColumn("key", F.expr(f"substring(uri, {len(prefix) + 1})")).join(keys.select("key"), "key", "left_anti").select("id", "key")


def stub_nodes(lost: DataFrame, versions: DataFrame, source: str, type: str, now: int) -> DataFrame:
    """versions with a node for each missing target (target) that has none yet: links into what is not written."""
    ids = lost.select(F.concat(F.lit(f"stub:{source}:"), F.lower("target")).alias("id"), "target").groupBy("id").agg(F.min("target").alias("t"))
    new = ids.join(versions.select("id"), "id", "left_anti").select("id", F.lit(type).alias("type"), F.to_json(F.struct(F.col("t").alias("name"))).alias("data"))
    return versions.unionByName(fresh(new, versions, now))


def stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """Timetable CSV files of a folder (stop_times.txt): trip, stop, place in the trip, and seconds past midnight of leaving."""
    rows = spark.read.option("header", "true").csv(f"{folder.rstrip('/')}/stop_times.txt")
    part = lambda i: F.try_to_number(F.trim(F.get(F.split("departure_time", ":"), F.lit(i))), F.lit("99")).cast("int")
    return rows.select(F.col("trip_id").alias("trip"), F.col("stop_id").alias("stop"), F.col("stop_sequence").cast("int").alias("place"), (part(0) * 3600 + part(1) * 60 + part(2)).alias("departs"))


def connections(times: DataFrame) -> DataFrame:
    """(trip, src, dst, departs, arrives): each stop of a trip and the next one."""
    w = W.partitionBy("trip").orderBy("place")
    return times.select("trip", F.col("stop").alias("src"), F.lead("stop").over(w).alias("dst"), "departs", F.lead("departs").over(w).alias("arrives")).filter("dst is not null")
