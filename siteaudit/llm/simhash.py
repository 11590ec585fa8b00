"""SimHash near-duplicates found with BK-trees.

Fingerprints are dealt to shards so that linked ones meet in one: with radius three they agree in
one of four blocks of 16 bits, and a shard is the leading bits of one block, as many as leave about
``TREE`` fingerprints in a shard on average (beyond 2^16 shards a block, the bits of two of five
blocks). So shards, not pairs, grow with the corpus. A shard is one BK-tree: children are keyed by
their integer Hamming distance to the parent, and a search follows only edges within ``radius`` of
the distance to the node at hand. A shard of more than ``TREE`` fingerprints becomes several trees,
and each of its queries goes to all of them, so a hot shard is spread over tasks and no task holds
more than one tree. Trees go to their queries by a shuffle: all of them together are all
fingerprints, which have no bound for a broadcast and must not pass the driver. A task hands on a
spanning forest of the links that it found, which keeps every component; components are closed by
alternating large-star and small-star steps over written tables.

Null text counts as empty: no words, fingerprint zero, linked like any other. Texts of any length
are read whole. A null doc_id never becomes a component's id unless all ids of the component are
null. Repeated rows give repeated results, an empty table none; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bound_batches, discard, materialize, tidy

RADIUS = 3
SHINGLE = 3
SEED = 42
#: (shift, width) of the bit blocks of which one agrees, and of those of which two agree.
ONE_OF = ((0, 16), (16, 16), (32, 16), (48, 16))
TWO_OF = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one tree at most.
TREE = 4096
#: Queries that descend together.
_TOGETHER = 512

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every k-word shingle of the text, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - k + 1)


def vote(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(h):
        return 0
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    return vote(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), k))


class BKTree:
    """Burkhard-Keller tree over 64-bit fingerprints; the metric is Hamming distance. The first value
    is the root; edges lie in one sorted list of (parent, distance), so that many queries descend
    together."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.asarray(values, np.uint64)
        rest = np.arange(1, len(self.values))
        at, keys, children = np.zeros(len(rest), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rest):
            # the first value at each distance of a node becomes its child, the others go down to it
            edge = at * 65 + np.bitwise_count(self.values[rest] ^ self.values[at])
            edge, first, own = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(rest[first])
            left = np.ones(len(rest), bool)
            left[first] = False
            at, rest = rest[first][own][left], rest[left]
        order = np.argsort(keys := np.concatenate(keys))
        self.keys, self.children = keys[order], np.concatenate(children)[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the value) of all pairs within the radius."""
        queries = np.asarray(queries, np.uint64)
        asked, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(asked) and len(self.values):
            d = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            found.append((asked[d <= radius], node[d <= radius]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            asked = np.repeat(asked, n)
            node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if not found:
            return asked[:0], node[:0]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _roots(parent: np.ndarray) -> np.ndarray:
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return parent


class Linker:
    """Links that keep the components of all pairs within the radius: of the values that one query
    reaches, those that are known to hang together are named once."""

    def __init__(self, values: np.ndarray, radius: int = RADIUS) -> None:
        self.tree, self.radius, self.parent = BKTree(values), radius, np.arange(len(values))

    def links(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) pairs, some hundred queries at a time."""
        values = self.tree.values
        for lo in range(0, len(queries), _TOGETHER):
            own = queries[lo : lo + _TOGETHER]
            q, v = self.tree.within(own, self.radius)
            pairs = np.unique(q * len(values) + self.parent[v])
            q, v = pairs // len(values), pairs % len(values)
            other = own[q] != values[v]
            yield own[q][other], values[v][other]
            # what one query reaches hangs together from now on
            joint = np.flatnonzero(q[1:] == q[:-1])
            while len(joint):
                a, b = self.parent[v[joint]], self.parent[v[joint + 1]]
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
                self.parent = _roots(self.parent)
                joint = joint[self.parent[v[joint]] != self.parent[v[joint + 1]]]


def with_fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, fp long")


def shards(fp: Column, count: int, tree: int = TREE) -> Column:
    """The shards of a fingerprint among ``count`` ones."""

    def lead(at: int, width: int, take: int) -> Column:
        return F.shiftrightunsigned(fp, at + width - take).bitwiseAND(F.lit((1 << take) - 1)) if take else F.lit(0).cast("long")

    bits = max(0, ceil(log2(max(1, count) / tree)))
    if bits <= 16:
        keys = [lead(at, width, min(bits, width)) for at, width in ONE_OF]
    else:
        half = min(12, (bits + 1) // 2)
        keys = [F.shiftleft(lead(*a, half), 13).bitwiseOR(lead(*b, half)) for a, b in combinations(TWO_OF, 2)]
    return F.array(*[F.lit(t << 32).cast("long").bitwiseOR(k) for t, k in enumerate(keys)])


Search = Callable[[list[np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray]]]


def in_trees(members: DataFrame, queries: DataFrame, start: Callable[[list[np.ndarray]], Search], tree: int = TREE) -> DataFrame:
    """(u, v) of each tree: ``start`` takes its members (whole columns) and gives the search, which takes
    its queries (columns, a batch at a time). Both tables have the columns shard, key and others; members of one
    shard are dealt to trees of about ``tree`` by their key, and queries go to each of its trees."""
    names = [c for c in members.columns if c != "shard"]
    parts = members.groupBy("shard").agg(F.ceil(F.count("*") / tree).cast("long").alias("parts"))
    own = members.join(parts, "shard").select("shard", F.pmod(F.xxhash64("key"), "parts").alias("part"), F.lit(0).alias("asks"), *names)
    asked = queries.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), *names)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def one(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal now, held, ready
            where, asks = (int(columns[0][0]), int(columns[1][0])), columns[2]
            if where != now:
                now, held, ready = where, [], None
            m = int(np.searchsorted(asks, 1))
            if m:
                held.append([c[:m] for c in columns[3:]])
            if m < len(asks) and held:
                ready = ready or start([np.concatenate(c) for c in zip(*held, strict=True)])
                for u, v in ready([c[m:] for c in columns[3:]]):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            bounds = [0, *cuts.tolist(), b.num_rows]
            out = [o for x, y in zip(bounds, bounds[1:], strict=False) if x < y for o in one([c[x:y] for c in columns]) if o.num_rows]
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return own.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks").mapInArrow(trees, "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE, count: int | None = None) -> DataFrame:
    """A spanning forest (u, v), v < u, of the links between the distinct values of ``fp``; the shards
    are made for ``count`` of them."""
    if radius > 3:
        raise ValueError("the shards cover a radius of three bits at most")

    def start(members: list[np.ndarray]) -> Search:
        shard = Linker(members[0].view(np.uint64), radius)

        def search(asked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for u, v in shard.links(asked[0].view(np.uint64)):
                yield u.view(np.int64), v.view(np.int64)

        return search

    rows = fps.select(F.explode(shards(F.col("fp"), fps.count() if count is None else count, tree)).alias("shard"), F.col("fp").alias("key"))
    found = in_trees(rows, rows, start, tree)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): alternating large-star and small-star
    steps, each written, until nothing changes. The root is the smallest node."""
    before, now = None, materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        if before is not None:
            discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = tuple(state)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, fp, component_id (the smallest doc_id that can
    be reached over links) and first_hash (the text_hash of that row)."""
    marked = materialize(with_fingerprints(docs, k), "fingerprints")
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    own = materialize(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(own.select("fp"), radius))
    rooted = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min_by("first", F.struct(F.col("first.doc_id").isNull(), "first.doc_id", "first.text_hash")).alias("best"))
    known = rooted.select("fp", "root").join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("first_hash"))
    return marked.join(known, "fp")


def simhash_components(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    found = near_duplicates(docs, radius, k)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_each(docs: DataFrame, kept: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose struct ``__key`` of doc_id and text_hash is in ``kept``, each once.
    ``marked`` has doc_id and text_hash of all rows; only repeated rows are told apart by a shuffle."""
    again = materialize(marked.groupBy(F.struct("doc_id", "text_hash").alias("__key")).agg(F.count("*").alias("__rows")).where("__rows > 1"), "repeated")
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    if again.isEmpty():
        return keyed.join(kept, "__key", "left_semi").select(docs.columns)
    once = keyed.join(kept.join(again, "__key", "left_anti"), "__key", "left_semi")
    twice = keyed.join(kept.join(again, "__key", "left_semi"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(twice).select(docs.columns)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest doc_id
    (of several such rows the one whose text hashes lowest, once)."""
    found = materialize(near_duplicates(docs, radius, k), "components")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    kept = kept.select(F.struct("doc_id", "text_hash").alias("__key")).distinct()
    return one_each(docs, kept, found)
