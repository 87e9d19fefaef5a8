"""Quality rules with n-gram perplexity from a modified Kneser-Ney model.

The model is one of character ORDER-grams for each language. Spark counts the grams of every document; joins over all
counts make interpolated modified Kneser-Ney probabilities. They are cut by ranges of (language, hash of the gram) into
shards of about SHARD grams or fewer. A shard goes to the tasks as arrays sorted by hash, with a directory of the hashes'
first bits, so that a gram is found in a step or two; no process holds more than a shard and no gram is left out. Grams
are told apart by 64 bits. As every document is in the model, an occurrence is scored by the model without itself
(leaving one out): a gram seen once backs off as one never seen, so that gibberish is not known by heart.

A document has two scores, its negative log probability a word and a character (log perplexities): junk that adds signs
to words costs more a word, rows of menu items cost less, other text costs another amount a character. For each score,
each language has a lower and an upper band, median -/+ width robust deviations of the documents that pass the plain
rules; documents outside either are rejected. The mean of few items varies more, so deviations are taken in units of
sqrt(1 / steady + 1 / items), and are `least` at least (BANDS). A language's deviation is its own and that of all
languages (about their own medians), weighted by its documents and by MIN_DOCS, so that every language with a document
past the plain rules has bands.

Plain rules: fewer than 50 words, or more than half the words in 3-word windows that occur twice or more in the text.
Null or empty text: counts are 0 and it fails. Null language is a language of its own. Rows that repeat an id are judged
each by its own text. Texts of any length are taken in pieces. Characters 0 and 1 are one symbol to the model. Other
columns are kept by keep_good() and ignored by scored().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import discard, map_rows, materialize, read, trim

ORDER, SHARD, PIECE = 5, 4_000_000, 1 << 20
#: Characters that a task counts at once, and distinct grams it keeps before it passes them on.
CHUNK, KEPT = 2_000_000, 1_000_000
MIN_WORDS, MAX_REPEAT, MIN_DOCS = 50, 50, 30
#: By score: the items it is a mean of, width, steady, least.
BANDS = {"log_ppl": ("n_words", 4.0, 1000, 0.5), "char_ppl": ("n_chars", 10.0, 2000, 0.2)}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
FLOOR = 1e-9
#: Multipliers of the grams' hash.
STEP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of grams, given by their characters' codes."""
    h = columns[0].astype(np.uint64)
    for c in columns[1:]:
        h = h * STEP + c
    return (h ^ (h >> np.uint64(32))) * LAST


def windows(codes: np.ndarray) -> list[np.ndarray]:
    return [codes[i : len(codes) - ORDER + 1 + i] for i in range(ORDER)]


def parts(text: str) -> Iterator[np.ndarray]:
    """Codes of the text in pieces, each with the ORDER - 1 codes before it; before the start they are 0."""
    c = np.maximum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1)
    for lo in range(0, len(c), PIECE):
        before = c[lo - ORDER + 1 : lo] if lo else np.zeros(ORDER - 1, np.uint32)
        yield np.concatenate([before, c[lo : lo + PIECE]])


def distinct(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (a row of codes each), hashes and counts of pieces."""
    codes = np.concatenate(held)
    inside = np.ones(len(codes), bool)  # windows that run into the next piece are none
    for end in np.cumsum([len(x) for x in held]):
        inside[end - ORDER + 1 : end] = False
    inside = inside[: len(codes) - ORDER + 1]
    there = np.zeros(0x110000, bool)
    there[codes] = True
    used = np.flatnonzero(there).astype(np.uint32)
    bits = 64 // ORDER
    if len(used) <= 1 << bits:  # grams of the chunk's own alphabet fit a number and sort as such
        place = np.zeros(0x110000, np.uint16)
        place[used] = np.arange(len(used))
        key = np.zeros(len(inside), np.uint64)
        for c in windows(place[codes]):
            key <<= np.uint64(bits)
            key |= c
        key = key[inside]
        key.sort()  # in place: np.unique would sort a copy
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        grams = np.stack([used[(key >> np.uint64(bits * (ORDER - 1 - i))) & np.uint64((1 << bits) - 1)] for i in range(ORDER)], axis=1)
    else:
        at = np.flatnonzero(inside)
        _, first, n = np.unique(hashed(windows(codes))[at], return_index=True, return_counts=True)
        grams = np.stack([c[at[first]] for c in windows(codes)], axis=1)
    return grams, hashed(list(grams.T)), n


def merged(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, first, at = np.unique(np.concatenate([a[1], b[1]]), return_index=True, return_inverse=True)
    return np.concatenate([a[0], b[0]])[first], h, np.bincount(at, weights=np.concatenate([a[2], b[2]])).astype(np.int64)


def as_text(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams, np.uint32).view(f"<U{ORDER}")[:, 0].tolist()


def distinct_grams(held: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same with the grams' texts."""
    grams, h, n = distinct(held)
    return as_text(grams), h, n


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, h, n) over all documents; null language as ''. h: the gram's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        found: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, pieces in held.items():
                new = distinct(pieces)
                found[lang] = merged(found[lang], new) if lang in found else new
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (g, h, n) in found.items():
                for lo in range(0, len(h), 100_000):
                    some = as_text(g[lo : lo + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array(h[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000])], names=["lang", "gram", "h", "n"])
            found.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for piece in parts(text.as_py() or ""):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size >= CHUNK:
                        fold()
                        size = 0
                        if sum(len(x[1]) for x in found.values()) >= KEPT:
                            yield from out()
        fold()
        yield from out()
        trim()

    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "lang string, gram string, h long, n long").groupBy("lang", "gram").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def probabilities(docs: DataFrame) -> DataFrame:
    """(lang, gram, h, logp) of every gram of docs: the log probability of its last character, one occurrence left out."""
    levels = [materialize(count_grams(docs), "grams")]
    for _ in range(ORDER - 1):
        levels.insert(0, materialize(levels[0].groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").alias("n")), "grams"))
    lower = None
    for m, level in enumerate(levels, 1):
        n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        clip = lambda x, top, other: F.when((n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0), F.least(F.greatest(x, F.lit(0.1)), F.lit(top))).otherwise(other)
        d = level.groupBy("lang").agg(F.count("*").alias("v"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        d = d.select("lang", "v", clip(1 - 2 * y * n2 / n1, 0.95, 0.5).alias("d1"), clip(2 - 3 * y * n3 / n2, 1.9, 0.75).alias("d2"), clip(3 - 4 * y * n4 / n3, 2.9, 0.9).alias("d3"))
        cut = lambda n: F.when(n <= 0, F.lit(0.0)).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        kept = ["h"] if m == ORDER else []
        # one row a language
        row = level.join(F.broadcast(d), "lang").select("lang", "gram", "n", "v", cut(F.col("n")).alias("cut"), cut(F.col("n") - 1).alias("cut1"), F.substring("gram", 1, m - 1).alias("ctx"), *kept)
        row = row.join(row.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare")), ["lang", "ctx"])
        if lower is None:
            row = row.withColumn("below", 1 / (F.col("v") + 1)).withColumn("below1", F.col("below"))
        else:
            row = row.withColumn("suffix", F.substring("gram", 2, m)).join(lower, ["lang", "suffix"])
            row = row.withColumn("below1", F.when(F.col("n") == 1, F.col("below1")).otherwise(F.col("below")))
        n, total, spare = F.col("n"), F.col("total"), F.col("spare")
        p = (n - F.col("cut")) / total + spare / total * F.col("below")
        left = F.when(total > 1, (n - 1 - F.col("cut1") + (spare - F.col("cut") + F.col("cut1")) * F.col("below1")) / (total - 1)).otherwise(F.col("below1"))
        lower = row.select("lang", F.col("gram").alias("suffix"), p.alias("below"), left.alias("below1"), *kept)
    model = materialize(lower.select("lang", F.col("suffix").alias("gram"), "h", F.log(F.greatest("below1", F.lit(FLOOR))).cast("float").alias("logp")), "model")
    discard(*levels)
    return model


def sharded(model: DataFrame) -> tuple[DataFrame, list]:
    """The model with the shard of each gram, and (shard, low, high) of the languages in each shard."""
    model = model.select("lang", "h", "logp")
    parts = -(-2 * n // SHARD) if (n := model.count()) > SHARD else 1  # the bounds of ranges are estimates
    if parts > 1:
        model = materialize(model.repartitionByRange(parts, "lang", "h").withColumn("shard", F.spark_partition_id()), "model")
    else:
        model = model.withColumn("shard", F.lit(0))
    return model, model.groupBy("shard").agg(F.min("lang"), F.max("lang")).orderBy("shard").collect()


class Table:
    """Log probabilities by hash: sorted hashes, and where those of each first bits start."""

    def __init__(self, h: np.ndarray, logp: np.ndarray) -> None:
        order = np.argsort(h)
        bits = max(1, min(24, len(h).bit_length()))
        self.shift, self.h = np.uint64(64 - bits), np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.logp = np.append(logp[order], np.float32(0))
        self.start = np.searchsorted(h[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, q: np.ndarray) -> np.ndarray:
        """Of each hash the log probability, 0 if it is not here."""
        at = self.start[q >> self.shift]
        late = np.flatnonzero(self.h[at] < q)
        while len(late):
            at[late] += 1
            late = late[self.h[at[late]] < q[late]]
        return np.where(self.h[at] == q, self.logp[at], np.float32(0))


def tables(shard: DataFrame) -> dict[str, Table]:
    t = shard.select("lang", "h", "logp").toArrow()
    lang = t["lang"].combine_chunks().dictionary_encode()
    of, h, logp = lang.indices.to_numpy(), t["h"].to_numpy().view(np.uint64), t["logp"].to_numpy()
    return {name: Table(h[of == i], logp[of == i]) for i, name in enumerate(lang.dictionary.to_pylist())}


def log_sums(texts: list[str], langs: list[str], known: dict[str, Table]) -> np.ndarray:
    """Of each text the sum of the log probabilities of its grams that are among the known ones."""
    sums = np.zeros(len(texts))
    held: dict[str, list[tuple[int, np.ndarray]]] = {}
    size = dict.fromkeys(known, 0)

    def add(lang: str) -> None:
        some = held.pop(lang, [])
        size[lang] = 0
        if some:
            value = np.concatenate([[0.0], np.cumsum(known[lang].of(hashed(windows(np.concatenate([c for _, c in some])))), dtype=float)])
            ends = np.cumsum([len(c) for _, c in some])
            for (i, c), end in zip(some, ends.tolist(), strict=True):
                sums[i] += value[end - ORDER + 1] - value[end - len(c)]

    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        if lang in known:
            for piece in parts(text):
                held.setdefault(lang, []).append((i, piece))
                size[lang] += len(piece)
                if size[lang] >= PIECE // 2:
                    add(lang)
    for lang in list(held):
        add(lang)
    return sums


def counts(text: str) -> dict:
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines, seen = 0, set()
    if b"\n" in b:
        for line in b.split(b"\n"):
            if line.strip():
                lines += line in seen
                seen.add(line)
    repeat = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        v = len(ids)
        pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
        _, at, n = np.unique(pair[:-1] * v + w[2:], return_inverse=True, return_counts=True)
        often = n[at] > 1
        if often.any():
            covered = np.zeros(len(w), bool)
            for i in range(3):
                covered[i : len(w) - 2 + i] |= often
            repeat = int(covered.sum())
    return {"n_words": len(words), "word_chars": len(text) - sum(map(b.count, (SPACE[i : i + 1] for i in range(6)))), "n_symbols": sum(map(b.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), "n_dup_lines": lines, "n_repeat_words": repeat}


def batched(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Rows together, up to PIECE characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["text"] or "") + 64
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), the plain counts, base_failed, log_ppl (a word), kept."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    model, shards = sharded(probabilities(docs))
    shared = context.broadcast(tables(model.filter(F.col("shard") == shards[0].shard)) if shards else {})

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for some in batched(rows):
            sums = log_sums([r["text"] or "" for r in some], [r["lang"] for r in some], shared.value)
            for r, s in zip(some, sums.tolist(), strict=True):
                x = counts(r["text"] or "")
                failed = x["n_words"] < MIN_WORDS or 100 * x["n_repeat_words"] > MAX_REPEAT * x["n_words"]
                yield {"doc_id": r["doc_id"], "same": r["same"], "lang": r["lang"], **x, "base_failed": failed, "log_sum": s, "n_chars": len(r["text"] or "")}

    table = materialize(map_rows(slim, run, "doc_id long, same long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_sum double, n_chars long"), "scores")
    shared.destroy()
    if len(shards) > 1:
        table = with_rest(table, slim, model, shards[1:])
    for score, (items, *_) in BANDS.items():
        table = table.withColumn(score, F.when(F.col("n_words") > 0, -F.col("log_sum") / F.col(items)))
    good = table.filter("not base_failed and log_ppl is not null")
    mids = good.groupBy("lang").agg(*[F.percentile_approx(s, 0.5, 10_000).alias(f"mid_{s}") for s in BANDS], F.count("*").alias("n"))
    off = {s: F.abs(F.col(s) - F.col(f"mid_{s}")) / F.sqrt(1 / F.lit(steady) + 1 / F.col(items)) for s, (items, _, steady, _) in BANDS.items()}
    apart = good.join(F.broadcast(mids), "lang").select("lang", "n", *[f"mid_{s}" for s in BANDS], *[off[s].alias(s) for s in BANDS])
    median = lambda t, name: t.agg(*[F.percentile_approx(s, 0.5, 10_000).alias(f"{name}_{s}") for s in BANDS])
    dev = median(apart.groupBy("lang", "n", *[f"mid_{s}" for s in BANDS]), "dev").crossJoin(F.broadcast(median(apart, "pool")))  # one row
    most = {s: width * F.greatest(1.4826 * (F.col("n") * F.col(f"dev_{s}") + MIN_DOCS * F.col(f"pool_{s}")) / (F.col("n") + MIN_DOCS), F.lit(least)) for s, (_, width, _, least) in BANDS.items()}
    bands = dev.select("lang", *[f"mid_{s}" for s in BANDS], *[most[s].alias(f"most_{s}") for s in BANDS])
    inside = F.lit(True)
    for s in BANDS:
        inside = inside & F.coalesce(off[s] <= F.col(f"most_{s}"), F.lit(True))
    return table.join(F.broadcast(bands), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside).drop("log_sum", *[f"{k}_{s}" for s in BANDS for k in ("mid", "most")])


def with_rest(table: DataFrame, slim: DataFrame, model: DataFrame, shards: list) -> DataFrame:
    """table with the sums of the other shards added, one pass over the documents of its languages for each shard."""
    keys, sums = ["doc_id", "same", "lang"], None
    for shard, low, high in shards:
        shared = slim.sparkSession.sparkContext.broadcast(tables(model.filter(F.col("shard") == shard)))

        def run(rows: Iterator[dict], shared=shared) -> Iterator[dict]:
            for some in batched(rows):
                sums = log_sums([r["text"] or "" for r in some], [r["lang"] for r in some], shared.value)
                for r, s in zip(some, sums.tolist(), strict=True):
                    yield {"doc_id": r["doc_id"], "same": r["same"], "lang": r["lang"], "more": s}

        # rows that repeat an id and a text have one sum
        part = map_rows(slim.filter(F.col("lang").between(low, high)), run, "doc_id long, same long, lang string, more double").groupBy(*keys).agg(F.max("more").alias("more"))
        part = materialize(part, "scores")
        shared.destroy()
        sums = part if sums is None else sums.unionByName(part)
    more = sums.groupBy(*keys).agg(F.sum("more").alias("_more")).select(*[F.col(c).alias(f"_{c}") for c in keys], "_more")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("same") == F.col("_same")) & (F.col("lang") == F.col("_lang"))
    joined = table.join(more, same, "left").withColumn("log_sum", F.col("log_sum") + F.coalesce("_more", F.lit(0.0)))
    return materialize(joined.select(*table.columns), "scores")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    good = scored(docs).filter("kept").select("doc_id", "same", "lang").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(good["doc_id"]) & (F.xxhash64(docs["text"]) == good["same"])
    return docs.join(good, same & (F.coalesce(docs["lang"].cast("string"), F.lit("")) == good["lang"]), "left_semi")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")
