"""Near copies by SimHash and BK-trees: texts whose word shingles have a Jaccard similarity of
``SIMILARITY`` or more.

Sets at that similarity differ in some ten of 64 fingerprint bits, far too many for shards of equal
bits. So shards are least hashes here: of ``BANDS`` times ``ROWS`` hash orders each gives the set's
first shingle, and a shard is what the orders of one band give. Two sets of similarity 0.8 share none
with a probability of 0.0002; sets that share no more than a passage hardly meet. In a shard the
fingerprints are searched within ``RADIUS`` bits, which a pair at 0.8 exceeds with a probability of
0.001, and every link is tested on the sets of shingle digests. So a link is always right, and next to
none is missed.

A large group of near copies shares its shards. It is not compared pair by pair: first each shard
has a tree of one root only, the set whose fingerprint is nearest to the majority of all bits in the
shard, which is nearest to what the copies were made from; what it links leaves the search, and a
root is taken from the rest, ``ROUNDS`` times. All that is then still apart from its shard's largest
group is searched in the shard's trees, against everything there. Pairs below 0.8 are many where
copies differ much, and they never leave their task: a first search names the sets that have a
candidate at all, one whose sketch of ``CELLS`` bytes (the first shingle of each cell of one more hash
order) agrees as at 0.8, to within ``DEVIATIONS`` standard deviations; a second search has these sets
at hand and compares them. Equal sets count once.

Sets of shingle digests are made once more for the texts that meet others, and written; texts are not
moved again.

Null text counts as empty; empty texts are equal. Texts of any length are read whole. Repeated rows
and copies leave one row, an empty table none; other columns come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bound_batches, discard, materialize, tidy
from siteaudit.llm.simhash import TREE, BKTree, Search, components, in_trees, one_each, shingle_hashes, vote

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 16, 4
RADIUS = 18
ROUNDS = 2
CELLS, DEVIATIONS = 256, 3.5
#: Pairs of one set that are tested in one place.
SALT = 1024
_TOGETHER = 256
_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_FOLD = np.random.default_rng(6).integers(1, 1 << 63, ROWS + 1, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), k))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The shards of a set: in each band the first shingle of each of its hash orders."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = _mixed((own ^ _ORDERS[:, :1]) * _ORDERS[:, 1:]).min(1).reshape(BANDS, ROWS)
    return _mixed((least * _FOLD[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _FOLD[ROWS])


def sketch(own: np.ndarray) -> bytes:
    """A byte (1 to 255) of the first shingle of each cell, 0 for empty cells."""
    out = np.zeros(CELLS, np.uint8)
    h = np.sort(_mixed(own * _FOLD[0]))
    cell = (h >> np.uint64(56)).astype(np.int64) * CELLS >> 8
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out[cell[first]] = h[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def overlaps(own: bytes, others: list[bytes]) -> np.ndarray:
    """How many digests each of the other sets shares with this one; sets are sorted digests."""
    mine, sizes = np.frombuffer(own, np.uint64), np.fromiter((len(o) // 8 for o in others), np.int64, len(others))
    if not len(mine) or not sizes.all():
        return np.zeros(len(others), np.int64)
    flat = np.frombuffer(b"".join(others), np.uint64)
    found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    return np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)


def similar_ones(own: bytes, others: list[bytes], least: float = SIMILARITY) -> np.ndarray:
    """Which of the other sets are similar to this one; empty sets are similar to each other."""
    shared, sizes = overlaps(own, others), np.fromiter((len(o) // 8 for o in others), np.int64, len(others))
    return np.where(sizes + len(own) == 0, True, shared >= least * (sizes + len(own) // 8 - shared) - 1e-9)


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether sketches (rows of bytes) agree as those of similar sets do."""
    used = ((a | b) != 0).sum(1)
    return ((a == b) & (a != 0)).sum(1) >= least * used - DEVIATIONS * np.sqrt(least * (1 - least) * used) - 1


def with_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, key (of the set), n (its size), fp, sketch and shards of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k) for t in b.column(2)]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            fps = np.array([vote(s) for s in sets], np.uint64)
            firsts = [band_keys(s).view(np.int64) for s in sets]
            at = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps.view(np.int64)), pa.array([sketch(s) for s in sets], pa.binary()), lists], ["doc_id", "text_hash", "key", "n", "fp", "sketch", "shards"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, key long, n long, fp long, sketch binary, shards array<long>")


def _sized(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9


def by_roots(apart: DataFrame, largest: DataFrame | None, radius: int, least: float) -> DataFrame:
    """Pairs (a, b): each shard's root and what it has within the radius, of what is not in the shard's
    largest component."""
    free = apart if largest is None else apart.join(largest, "shard").where("root <> most").drop("most")
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("all"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middles = free.groupBy("shard").agg(F.count("*").alias("all"), *bits).select("shard", middle.alias("middle"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    roots = free.join(middles, "shard").groupBy("shard").agg(F.min_by(F.struct("key", "n", "fp", "root"), F.struct(far, "key")).alias("r"))
    near = (F.col("root") != F.col("r.root")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("r.fp"))) <= radius) & _sized(F.col("n"), F.col("r.n"), least)
    return free.join(roots, "shard").where(near).select(F.col("r.key").alias("a"), F.col("key").alias("b")).distinct()


def outside(apart: DataFrame, largest: DataFrame) -> DataFrame:
    return apart.join(largest, "shard").where("root <> most").select(apart.columns)


def with_candidates(apart: DataFrame, largest: DataFrame, radius: int, least: float, tree: int = TREE) -> DataFrame:
    """Keys of (shard, key, fp, n, root, sketch) that have a candidate: within the radius, in another
    component, and with a sketch that agrees. Each tree names a key once a batch of queries at most."""

    def start(members: list[np.ndarray]) -> Search:
        (key, fp, n, root, bins), tried = members, BKTree(members[1].view(np.uint64))
        bins, named = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, CELLS), np.zeros(len(key), bool)

        def search(asked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, len(asked[0]), _TOGETHER):
                own = [c[lo : lo + _TOGETHER] for c in asked]
                mine, hit = np.frombuffer(b"".join(own[4]), np.uint8).reshape(-1, CELLS), np.zeros(len(own[0]), bool)
                q, v = _fitting(own, n, root, *tried.within(own[1].view(np.uint64), radius), least)
                fresh = named.copy()
                for at in range(0, len(q), 1 << 15):
                    some = slice(at, at + (1 << 15))
                    good = may_be_similar(mine[q[some]], bins[v[some]], least)
                    hit[q[some][good]] = True
                    fresh[v[some][good]] = True
                found = np.concatenate((own[0][hit], key[fresh & ~named]))
                named[:] = fresh
                yield found, found

        return search

    return in_trees(apart, outside(apart, largest), start, tree).select(F.col("u").alias("key")).distinct()


def by_trees(apart: DataFrame, largest: DataFrame, radius: int, least: float, tree: int = TREE) -> DataFrame:
    """Similar pairs (u, v) of (shard, key, fp, n, root, digests), one outside its shard's largest component."""

    def start(members: list[np.ndarray]) -> Search:
        (key, fp, n, root, sets), tried = members, BKTree(members[1].view(np.uint64))

        def search(asked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, len(asked[0]), _TOGETHER):
                own = [c[lo : lo + _TOGETHER] for c in asked]
                q, v = _fitting(own, n, root, *tried.within(own[1].view(np.uint64), radius), least)
                order = np.argsort(q, kind="stable")
                q, v = q[order], v[order]
                bounds = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
                us, vs = [key[:0]], [key[:0]]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    if a < b:
                        good = v[a:b][similar_ones(own[4][q[a]], sets[v[a:b]].tolist(), least)]
                        us.append(np.full(len(good), own[0][q[a]]))
                        vs.append(key[good])
                yield np.concatenate(us), np.concatenate(vs)

        return search

    return in_trees(apart, outside(apart, largest), start, tree).distinct()


def _fitting(own: list[np.ndarray], n: np.ndarray, root: np.ndarray, q: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (query, member) those in different components whose sizes allow the similarity."""
    small, large = np.minimum(own[2][q], n[v]), np.maximum(own[2][q], n[v])
    fits = (own[3][q] != root[v]) & (small >= least * large - 1e-9)
    return q[fits], v[fits]


def digests(texts: DataFrame, k: int) -> DataFrame:
    """key and digests (the set, in order) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], ["key", "digests"])

    return texts.select("key", "text").mapInArrow(tidy(run), "key long, digests binary")


def tested(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar. A set with many partners is sent to several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
            keep = [similar_ones(b.column(2)[x].as_py(), b.column(3)[x:y].to_pylist(), least) for x, y in zip(bounds, bounds[1:], strict=False) if x < y]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(np.concatenate([np.empty(0, bool), *keep])))

    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("long").alias("places"))
    salted = pairs.join(places, "a").select("a", "b", F.pmod(F.xxhash64("b"), "places").alias("place"))
    left = sets.join(places, sets.key == places.a).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.col("digests").alias("s"))
    right = sets.select(F.col("key").alias("b"), F.col("digests").alias("t"))
    return salted.join(right, "b").join(left, ["a", "place"]).select("a", "b", "s", "t").mapInArrow(tidy(run), "u long, v long")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, k: int = SHINGLE, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """The rows of ``docs`` with one row of each group that links of similar texts hold together:
    the one with the smallest doc_id (of several such rows the one whose text hashes lowest, once)."""
    bound_batches(docs.sparkSession)
    marked = materialize(with_sets(docs, k), "sets")
    rank = lambda c: F.struct(F.col(f"{c}doc_id").isNull(), f"{c}doc_id", f"{c}text_hash")
    own = materialize(marked.groupBy("key").agg(F.min_by(F.struct("doc_id", "text_hash"), rank("")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("shards").alias("shards")), "distinct")
    rows = own.select(F.explode("shards").alias("shard"), "key", "fp", "n")
    met = rows.groupBy("shard").agg(F.count("*").alias("met")).where("met > 1").select("shard")
    rows = materialize(rows.join(met, "shard"), "shared")
    wanted = own.join(rows.select("key").distinct(), "key", "left_semi").select("key", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h"))
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    # repeated rows give a set twice, which gives links twice
    sets = materialize(digests(texts, k), "digests")
    edges = roots = largest = None
    for turn in range(ROUNDS + 1):
        if roots is None:
            apart = rows.withColumn("root", F.col("key"))
        else:
            known = rows.join(roots, rows.key == roots.node, "left").select("shard", "key", "fp", "n", F.coalesce("root", "key").alias("root"))
            mixed = known.groupBy("shard").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shard")
            apart = materialize(known.join(mixed, "shard"), "apart")
            sizes = apart.groupBy("shard", "root").count()
            largest = sizes.groupBy("shard").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
        if turn < ROUNDS:
            pairs = materialize(by_roots(apart, largest, radius, least), "pairs")
            found = materialize(tested(pairs, sets, least), "links")
            discard(pairs)
        else:
            sketches = marked.join(apart.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("sketch").alias("sketch"))
            named = materialize(with_candidates(apart.join(sketches, "key").select("shard", "key", "fp", "n", "root", "sketch"), largest, radius, least, tree), "candidates")
            some = apart.join(named, "key").join(sets, "key").select("shard", "key", "fp", "n", "root", "digests")
            found = materialize(by_trees(some, largest, radius, least, tree), "links")
        edges = found if edges is None else edges.union(found)
        if roots is not None:
            discard(apart)
        roots = materialize(components(edges), "roots")
    rooted = own.join(roots, own.key == roots.node, "left").select("first", F.coalesce("root", "key").alias("root"))
    kept = rooted.groupBy("root").agg(F.min_by("first", rank("first.")).alias("__key")).select("__key")
    return one_each(docs, kept, marked)
