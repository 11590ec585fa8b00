"""Importance resampling of documents with hashed n-gram models.

Two bag-of-n-grams models over ``BUCKETS`` hashed unigrams and bigrams are counted: the target
(documents labelled as of good quality and not toxic) and the raw corpus (all documents). A
document's log weight is the sum over its n-grams of log(target / raw), with add-one smoothing.
Adding standard Gumbel noise, drawn from a hash of the doc_id and text, and keeping the largest
keys draws without replacement in proportion to the weights. The count kept is a share of the
rows, and the cut is found exactly by counting digits of the keys, without a global sort.

Counts cover all documents and all words; only the two tables of ``BUCKETS`` counts come to the
driver. Null text has no n-grams and log weight 0. Labels with a null doc_id, quality or toxic
say nothing; a document with contradictory labels is no target. Repeated rows count and are drawn
as rows of their own; rows alike in all respects are told apart by a number. Without any target the weights are all
0, so that the draw is uniform. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bound_batches, materialize

BUCKETS = 10_000
SHARE = 0.5
SEED = 42
#: So many labelled ids are broadcast at most (about 100 MB, with 100 bytes each as the check tool
#: measures them); more are joined by shuffling.
MAX_BROADCAST = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_UP, _DOWN = np.ones(_CHUNK + 1, np.uint64), np.ones(_CHUNK + 1, np.uint64)
np.multiply.accumulate(np.full(_CHUNK, _BASE), out=_UP[1:])
np.multiply.accumulate(np.full(_CHUNK, _BACK), out=_DOWN[1:])
#: A-Z lower-cased; ASCII letters, digits and all bytes above 127 make words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[raw]
    edge = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.zeros(len(starts), np.uint64)
    folded = _FOLD[raw].astype(np.uint64) + np.uint64(1)
    lo = 0
    while lo < len(starts):  # stretches over which the powers reach
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + _CHUNK, "right")))
        if ends[lo] - first > _CHUNK:  # a single word longer than that: hash it by its pieces
            h = np.uint64(0)
            for i in range(first, ends[lo], _CHUNK):
                part = folded[i : min(i + _CHUNK, ends[lo])]
                h = _mix(np.array([h ^ (part * _UP[: len(part)]).sum(dtype=np.uint64)]))[0]
            words[lo] = h
        else:
            part = folded[first : ends[hi - 1]] * _UP[: ends[hi - 1] - first]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
            s, e = starts[lo:hi] - first, ends[lo:hi] - first
            words[lo:hi] = (total[e] - total[s]) * _DOWN[s]
        lo = hi
    one = _mix(words)
    two = _mix(one[:-1] * np.uint64(3) + one[1:])
    return (np.concatenate((one, two)) % np.uint64(buckets)).astype(np.int64)


def count_models(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the raw corpus and of the target rows (column ``target``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, target in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = np.bincount(ngram_buckets(text.as_py(), buckets), minlength=buckets)
                counts[0] += own
                if target:
                    counts[1] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])

    rows = docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def mark_targets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``target`` of all rows of ``docs``. Up to ``MAX_BROADCAST`` good ids, counted
    first, go to the texts; beyond that the texts are shuffled once to meet them."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")) == 1).alias("__good"))
    good = materialize(good.where("__good"), "targets")
    good = F.broadcast(good) if good.count() <= MAX_BROADCAST else good
    rows = docs.select("doc_id", "text").join(good, "doc_id", "left")
    return rows.select("text", F.coalesce("__good", F.lit(False)).alias("target"))


def cut_value(keys: DataFrame, k: int, digits: int = 12) -> tuple[int, int]:
    """The k-th largest of the integer column ``key`` (0 to 2**60 - 1), found digit by digit from
    the counts of ``2**digits`` values, and how many rows of exactly that key are among the k."""
    low, left = 0, k
    for shift in range(60 - digits, -1, -digits):
        here = keys.where((F.col("key") >= low) & (F.col("key") < low + (1 << (shift + digits))))
        counts = dict(here.groupBy(F.shiftright(F.col("key") - low, shift).alias("d")).count().collect())
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                low += d << shift
                break
            left -= counts[d]
    return low, left


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, quality (0 to 1: the mean ratio an n-gram, as a probability), gumbel_key
    and selected for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    marked = mark_targets(docs, labels)
    ratio = log_ratio(*count_models(marked, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, quality = np.zeros(b.num_rows), np.full(b.num_rows, 0.5)
            for i, t in enumerate(b.column(2)):
                own = shared.value[ngram_buckets(t.as_py(), buckets)]
                if len(own):
                    weight[i], quality[i] = own.sum(), 1 / (1 + np.exp(-own.mean()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weight), pa.array(quality)], ["doc_id", "draw", "log_weight", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), "text").mapInArrow(run, f"doc_id {kind}, draw long, log_weight double, quality double")
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    # an order-preserving whole number below 2**60 for the cut
    squashed = F.atan(F.col("gumbel_key") / 64) / 3.2 + 0.5
    scored = materialize(scored.withColumn("key", F.floor(squashed * float(1 << 59)).cast("long")).withColumn("row", F.monotonically_increasing_id()), "scored")
    n = scored.count()
    k = int(n * share)
    if not k:
        return scored.select("doc_id", "log_weight", "quality", "gumbel_key", F.lit(False).alias("selected"))
    low, left = cut_value(scored.select("key"), k)
    ties = scored.where(F.col("key") == low)
    chosen = F.col("key") > low
    if ties.count() > left:
        # rows of one key, alike in text and id: their row numbers decide, cut in the same way
        last, _ = cut_value(ties.select(F.pmod(F.xxhash64("row"), F.lit(1 << 60)).alias("key")), left)
        chosen |= (F.col("key") == low) & (F.pmod(F.xxhash64("row"), F.lit(1 << 60)) >= last)
    else:
        chosen = F.col("key") >= low
    return scored.select("doc_id", "log_weight", "quality", "gumbel_key", chosen.alias("selected"))
