"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of ``window`` consecutive words (an item of fewer words is one
window). A window is the set of its word shingles with their places; a document contains the
window only if it contains all of them, so for containment of 1 the necessary prefix is one
shingle: the rarest one. The documents are cut into words once; of their shingles those that some
window has are written, with their places and words. Rarity is a shingle's count there; a window
of which some shingle occurs in no document is gone at once. The join runs on the rarest shingle
alone. The places give the positional bound (where the window must start) and the length bound (it
must end inside the document), and the words of all other shingles are then compared at the places
where they must stand, so the result is exact.

The windows' shingles go to the executors in blocks of at most ``MAX_WINDOWS`` windows, so that what is
broadcast has a fixed bound (about 60 MB); more windows take more passes, not more memory.

Null text has no words. Items without words have no windows. Repeated items and windows count
once. A null item_id marks words as hit but is no item in ``n_items`` or ``items_sha256``. Texts of any
length are read whole. Each row of documents gives one row, repeated ids and rows included; an empty
table gives none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import materialize

WINDOW = 10
SHINGLE = 3
MAX_WINDOWS = 100_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = "".join(chr(c) for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A))


def words(text: Column) -> Column:
    """Words of the text: A-Z lower-cased, runs of digits, a-z and whatever is not ASCII."""
    plain = F.translate(text, _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")


def _shingles(ws: Column, n: Column) -> Column:
    """Digests of the k-word shingles by their place. Shorter texts have one for each of their
    words or word pairs, so that short windows are found too."""
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _pairs(ws: Column, n: Column) -> Column:
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, ws) and their items (wid, item_id)."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cut = cut.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window))).alias("ws"))
    own = materialize(cut.distinct().withColumn("wid", F.sha2(F.array_join("ws", " "), 256)), "windows")
    return own.groupBy("wid").agg(F.first("ws").alias("ws")), own.select("wid", "item_id")


def _keys(ws: Column, n: Column, lengths: set[int]) -> Column:
    """All digests by which windows of these word counts can be found, each with its place."""
    parts = []
    if any(x >= SHINGLE for x in lengths):
        parts.append(_shingles(ws, n))
    if 2 in lengths:
        parts.append(_pairs(ws, n))
    if 1 in lengths:
        parts.append(F.transform(ws, lambda w: F.xxhash64(w)))
    return parts


KEY = ["doc_id", "text_hash"]


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row (doc_id, text_hash, n_words) for each document row; the places (doc_id, text_hash, wid,
    start, len) where windows occur, start from 0, rows that are repeated once; and (wid, item_id)."""
    wins, members = item_windows(items, window)
    wins = materialize(wins.withColumn("n", F.size("ws")), "distinct-windows")
    lengths = {r[0] for r in wins.select("n").distinct().collect()}  # at most `window` numbers
    width = F.least("n", F.lit(SHINGLE))
    kind = F.when(F.col("n") >= SHINGLE, _shingles(F.col("ws"), F.col("n"))).when(F.col("n") == 2, _pairs(F.col("ws"), F.col("n"))).otherwise(F.transform("ws", lambda w: F.xxhash64(w)))
    shingles = wins.select("wid", F.col("n").alias("len"), width.alias("k"), "ws", F.posexplode(kind).alias("off", "h"))
    shingles = shingles.select("wid", "len", "k", "off", "h", F.array_join(F.slice("ws", F.col("off") + 1, F.col("k")), " ").alias("said"))
    blocks = max(1, math.ceil(wins.count() / MAX_WINDOWS))

    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    parts = _keys(F.col("ws"), F.col("n"), lengths)
    hashes = F.array().cast("array<bigint>") if not parts else parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))
    # where each kind of digest begins in the flattened array, and which kind a place of it is
    at, first, wide = F.lit(0), F.lit(0), F.lit(0)
    for k in (SHINGLE, 2, 1):
        if (k == SHINGLE and any(x >= SHINGLE for x in lengths)) or (k < SHINGLE and k in lengths):
            first, wide = F.when(F.col("at") > at, at).otherwise(first), F.when(F.col("at") > at, k).otherwise(wide)
            at = at + F.greatest(F.col("n") - k + 1, F.lit(0))
    flat = base.select(*KEY, "n", "ws", F.concat(F.array(F.lit(None).cast("bigint")), hashes).alias("hs"))
    # the outer form: the other's inferred filter on the array would be pushed below the words and cut
    # them again for every shingle
    probe = flat.select(*KEY, "n", "ws", F.posexplode_outer("hs").alias("at", "h"))
    found = []
    for b in range(blocks):
        own = shingles.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b).select("h").distinct().withColumn("known", F.lit(True))
        hit = probe.join(F.broadcast(own), "h", "left").where(F.col("known") | (F.col("at") == 0) if b == 0 else F.col("known"))
        place = F.col("at") - 1 - first
        hit = hit.select(*KEY, "n", F.col("at") == 0, place.alias("place"), wide.alias("k"), "h", F.when(F.col("at") > 0, F.array_join(F.slice("ws", F.greatest(place, F.lit(0)) + 1, wide), " ")).alias("said"))
        found.append(materialize(hit.toDF(*KEY, "n", "header", "place", "k", "h", "said"), "shingles"))
    rows = found[0].where("header").select(*KEY, F.col("n").cast("long").alias("n_words"))
    met = found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    # windows share shingles across blocks, and rows may be repeated
    met = met.where("NOT header").select(*KEY, "n", "place", "k", "h", "said")
    met = met.distinct() if blocks > 1 else met
    counts = met.groupBy("h").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, "h", "left").groupBy("wid").agg(F.first("len").alias("len"), F.count("*").alias("parts"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("p"))
    prefix = ranked.where("p.df > 0").select("wid", "len", "parts", F.col("p.h").alias("h"), F.col("p.off").alias("off"))
    start = F.col("place") - F.col("off")
    near = met.join(prefix, "h").select(*KEY, "n", "wid", "len", "parts", start.alias("start")).where("start >= 0 AND start + len <= n").distinct()
    # where each shingle of the window must stand, against what stands there
    due = near.join(shingles.select("wid", "k", "off", "said"), "wid").select(*KEY, "wid", "start", "len", "parts", (F.col("start") + F.col("off")).alias("place"), "k", "said")
    here = met.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("place").alias("p"), F.col("k").alias("w"), F.col("said").alias("s")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("place") == F.col("p")) & (F.col("k") == F.col("w")) & (F.col("said") == F.col("s"))
    whole = due.join(here, same).groupBy(*KEY, "wid", "start", "len", "parts").agg(F.count("*").alias("met")).where("met = parts")
    return rows, whole.select(*KEY, "wid", "start", "len"), members


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated and item_ids of every
    row."""
    rows, seen, members = occurrences(docs, items, window)
    seen = materialize(seen, "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["start"] + s["len"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["start"] + s["len"]).alias("end"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))
    hit = seen.groupBy(*KEY).agg(spans.alias("spans")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), n_hit.alias("n_hit"))
    named = seen.select(*KEY, "wid").distinct().join(members.where("item_id IS NOT NULL"), "wid").select(*KEY, "item_id").distinct()
    named = named.groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "item_ids")
    on = lambda side: F.col("doc_id").eqNullSafe(side["d"]) & (F.col("text_hash") == side["t"])
    out = rows.join(hit, on(hit), "left").select(*KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))
    out = out.join(named, on(named), "left").select(*KEY, "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    ids = F.col("item_ids")
    return out.select(*KEY, "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose text no window of any item occurs."""
    hit = contamination(docs, items, window).where("contaminated").select(F.struct("doc_id", "text_hash").alias("__key")).distinct()
    rows = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return rows.join(hit.withColumnRenamed("__key", "__hit"), F.col("__key").eqNullSafe(F.col("__hit")), "left_anti").drop("__key")
