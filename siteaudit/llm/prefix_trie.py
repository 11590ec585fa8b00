"""The trie of conversation prefixes, as succinct level-order tries.

Turns become two digest lanes and a word count; texts are read once and not shuffled. A conversation
shares its opening with another one (``opening``), so its turns are rebuilt from both. A prefix's key is
the sum, modulo 2^61 in each of two lanes, of its turns' digests mixed with their places; running sums
go over range partitions and their totals (``running``), so that a conversation of any length is no
single task. One aggregation with map-side combine makes a row of each distinct prefix.

Prefixes with more than ``LIGHT`` rows below them are the heavy upper levels. Below them whole subtrees are
dealt to shards of about ``SHARD`` nodes. In a shard numpy numbers the nodes in level order, builds the
LOUDS bits (a one for each child, then a zero) and the array of labels, and sums saved tokens and leaves
upwards level by level with ``add.at``. Heavy levels merge separately: each node counts for its smallest
member, whose own path holds all the node's ancestors, so what a member brings to its heavy ancestors is a
running sum along its path, and one aggregation by prefix adds the members up.

Rows of one turn number are taken in order of their digests; null turns come first. Null role and text
are empty; repeated rows are turns of their own. Rows without a conv_id are no conversation and are left
out. ``c % n`` has the sign of c. A table without conversations has no nodes. Other columns, whatever
their names, are ignored. The digests of the members that end in a node are hashed in order, in pieces of
``CHUNK`` ids: SHA-256 is sequential, so the text of one node's ids passes one task, a piece at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.common import discard, materialize, tidy

LIGHT, SHARD, CHUNK = 16_384, 65_536, 4_096
MOD = 1 << 61
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Louds:
    """A trie in level order. Node 0 is the top; ``labels`` has a row for each node."""

    bits: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, parent: np.ndarray, labels: np.ndarray) -> Louds:
        """From the parents' numbers of nodes 1, 2, ... in level order."""
        n = len(parent) + 1
        ends = 1 + np.cumsum(np.bincount(parent, minlength=n)) + np.arange(1, n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[1] = False
        bits[ends] = False
        return cls(bits, labels)

    @classmethod
    def unpacked(cls, bits: bytes, labels: bytes) -> Louds:
        rows = np.frombuffer(labels, "<i8").reshape(-1, 2)
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * len(rows) + 1).astype(bool), rows)

    def packed(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits).tobytes(), self.labels.astype("<i8").tobytes()

    def parents(self) -> np.ndarray:
        """Number of each node's parent: the zeros before its one, less one. The top's is -1."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def children(self, node: int) -> range:
        zeros = np.flatnonzero(~self.bits)
        first = int(zeros[node]) - node
        return range(first, first + int(zeros[node + 1] - zeros[node] - 1))

    def walk(self, path: Sequence[tuple[int, int]]) -> list[int]:
        """The nodes on ``path`` from below the top, as far as it goes."""
        found, at = [], 0
        for label in path:
            under = self.children(at)
            hit = [c for c in under if tuple(self.labels[c].tolist()) == tuple(label)]
            if not hit:
                break
            at = hit[0]
            found.append(at)
        return found


def level_order(level: np.ndarray, key: np.ndarray, above: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Rows in level order under one top (levels from 1; siblings by label), the number of each one's parent
    and the numbers of each level. ``key`` and ``above`` are two lanes: a row's own and its parent's."""
    n = len(level)
    ids = np.unique(np.concatenate((key, above)), axis=0, return_inverse=True)[1].reshape(-1)
    row_of = np.full(2 * n, -1, np.int64)
    row_of[ids[:n]] = np.arange(n)
    up = row_of[ids[n:]]
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(1, (level.max() if n else 0) + 2))
    number, order, parent, slices = np.zeros(n, np.int64), [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = by_level[a:b]
        parents = np.zeros(len(rows), np.int64) if not slices else number[up[rows]]
        sort = np.lexsort((key[rows, 1], key[rows, 0], label[rows, 1], label[rows, 0], parents))
        number[rows[sort]] = np.arange(a, b) + 1
        order.append(rows[sort])
        parent.append(parents[sort])
        slices.append(slice(int(a) + 1, int(b) + 1))
    none = [np.empty(0, np.int64)]
    return np.concatenate(order or none), np.concatenate(parent or none), slices


def roll_up(louds: Louds, slices: list[slice], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row a node, the top's first) over each node's subtree."""
    out, parent = values.copy(), louds.parents()
    for s in reversed(slices):
        np.add.at(out, parent[s], out[s])
    return out


def running(rows: DataFrame, group: str, order: list[Column], add: list[str], name: str) -> DataFrame:
    """The rows, written, with ``nth`` (from 1 in each group of the long column ``group``) and ``run_c``, the
    running sum modulo 2^61 of each column c of ``add``. A group may go over any number of partitions: one
    row of totals for each partition where a group goes on reaches the driver."""
    sums = [f"run_{c}" for c in add]
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("part"))
    schema = T.StructType([*sorted_rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ["nth", *sums])])
    names, mask = schema.names, np.uint64(MOD - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, np.zeros(1 + len(add), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(names.index(group)).to_numpy(zero_copy_only=False)
            values = np.column_stack([np.ones(len(g), np.uint64), *(b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.uint64) for c in add)])
            total = np.cumsum(values, axis=0, dtype=np.uint64)
            new = np.concatenate(([g[0] != last], g[1:] != g[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            before = np.where((start > 0)[:, None], total[start - 1], np.uint64(0))
            out = total - before + np.where((start < 0)[:, None], had, np.uint64(0))
            last, had = g[-1], out[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array((out[:, i] & mask).astype(np.int64)) for i in range(out.shape[1]))], names)

    local = materialize(sorted_rows.mapInArrow(tidy(run), schema), name)
    edges = local.groupBy("part").agg(F.min(group).alias("a"), F.max(group).alias("b")).orderBy("part").collect()
    going = sorted({x["b"] for x, y in zip(edges, edges[1:], strict=False) if x["b"] == y["a"]})
    if not going:
        return _same(local.drop("part"), local)
    spark = rows.sparkSession
    among = F.broadcast(spark.createDataFrame([(g,) for g in going], f"{group} long"))
    ends = local.join(among, group, "left_semi").groupBy(group, "part").agg(F.max_by(F.struct("nth", *sums), "nth").alias("t")).orderBy(group, "part").collect()
    carry, before = [], (None, [])
    for r in ends:
        had = before[1] if before[0] == r[group] else [0] * (1 + len(add))
        carry.append((r["part"], r[group], *had))
        before = (r[group], [(x + y) % MOD for x, y in zip(had, r["t"], strict=True)])
    more = spark.createDataFrame(carry, T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in [group, *(f"more_{c}" for c in ["nth", *sums])])]))
    out = local.join(F.broadcast(more), ["part", group], "left")
    out = out.withColumns({c: F.pmod(F.col(c) + F.coalesce(f"more_{c}", F.lit(0)), F.lit(MOD)) for c in ["nth", *sums]})
    return _same(out.select([c for c in names if c != "part"]), local)


def _same(view: DataFrame, table: DataFrame) -> DataFrame:
    """``view``, which reads the written ``table`` and goes with it."""
    view._written = table._written
    return view


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), two digest lanes and the words of every turn, written."""
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = c.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), digest.alias("digest"), words(text).alias("words"))
    lane = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = rows.select("conv_id", "turn", lane(1).alias("l1"), lane(16).alias("l2"), "words")
    out = running(rows, "conv_id", [F.col("turn"), F.col("l1"), F.col("l2")], [], "turns")
    return _same(out.withColumn("pos", F.col("nth") - 1).drop("turn", "nth"), out)


def opening(every: int = 20, most: int = 4) -> tuple[Column, Column]:
    """Whose opening a conversation takes, and how many turns of it."""
    c = F.col("conv_id")
    return c - c % every, F.crc32(c.cast("string")) % most


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, l1, l2, words, length) of all rebuilt conversations, and conv_id and length of each."""
    base, take = opening(every, most)
    convs = materialize(own.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", (F.col("n") + 1).alias("n"), base.alias("base"), take.alias("take")), "conversations")
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    other = F.col("base") != F.col("conv_id")
    plan = convs.join(of, "base", "left").select(
        "conv_id", "base", F.when(other, F.col("take")).otherwise(0).alias("skip"), F.when(other, F.least("take", F.coalesce("base_n", F.lit(0)))).otherwise(0).alias("taken"), "n"
    )
    plan = materialize(plan.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("skip"))), "rebuilding")
    discard(convs)
    lanes = ["l1", "l2", "words", "length"]
    kept = own.join(plan.drop("base", "n"), "conv_id").where("pos >= skip").select("conv_id", (F.col("pos") - F.col("skip") + F.col("taken")).alias("pos"), *lanes)
    heads = own.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = plan.where("taken > 0").select("conv_id", "base", "taken", "length").join(heads, "base").where("pos < taken").select("conv_id", "pos", *lanes)
    return kept.unionByName(taken), plan.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """The rebuilt turns, written, with the key of the prefix that ends there (k1, k2), its parent's (p1, p2)
    and that of its first turn (first)."""
    mixed = lambda c: F.shiftrightunsigned(F.xxhash64(c, "pos"), 3)
    rows = rows.select("*", mixed("l1").alias("g1"), mixed("l2").alias("g2")).withColumn("f", F.when(F.col("pos") == 0, F.col("g1")).otherwise(0))
    out = running(rows, "conv_id", [F.col("pos")], ["g1", "g2", "f"], "prefixes")
    above = lambda k, g: F.pmod(F.col(k) - F.col(g), F.lit(MOD))
    keys = [F.col("run_g1").alias("k1"), F.col("run_g2").alias("k2"), above("run_g1", "g1").alias("p1"), above("run_g2", "g2").alias("p2"), F.col("run_f").alias("first")]
    return _same(out.select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "words", "l1", "l2", *keys), out)


def nodes(paths: DataFrame) -> DataFrame:
    """One row a distinct prefix, written. ``below`` counts the turns of members from here on."""
    ends = F.col("depth") == F.col("length")
    return materialize(
        paths.groupBy("depth", "k1", "k2").agg(
            *(F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "l1", "l2", "words", "first")),
            F.count("*").alias("n_convs"),
            F.count_if(ends).alias("n_ends"),
            F.min(F.when(ends, F.col("conv_id"))).alias("first_end"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
        ).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_convs") == F.col("n_ends")).cast("long")),
        "nodes",
    )


KEY = ["depth", "k1", "k2"]


def dealt(tree: DataFrame, paths: DataFrame, light: int = LIGHT, shard: int = SHARD) -> tuple[DataFrame, DataFrame | None]:
    """Light nodes with their shard and their level in it, and the paths' rows at heavy nodes (None if there
    are none)."""
    heavy = tree.where(F.col("below") > light)
    shards = max(1, math.ceil(tree.count() / shard))
    if heavy.isEmpty():
        return tree.withColumns({"level": F.col("depth"), "shard": F.pmod(F.xxhash64("first"), F.lit(shards))}), None
    upper = materialize(paths.select("conv_id", *KEY).join(heavy.select(*KEY), KEY, "left_semi"), "upper")
    cut = upper.groupBy("conv_id").agg(F.max("depth").alias("cut"))
    tops = paths.join(cut, "conv_id").where(F.col("depth") == F.col("cut") + 1).select("conv_id", "cut", F.col("k1").alias("top"))
    below = tree.where(F.col("below") <= light).join(tops, "conv_id", "left")
    below = below.withColumns({"level": F.col("depth") - F.coalesce("cut", F.lit(0)), "shard": F.pmod(F.xxhash64(F.coalesce("top", "first")), F.lit(shards))})
    return materialize(below.drop("cut", "top"), "light"), upper


def _shard_trie(t: pa.Table) -> tuple[Louds, list[slice], np.ndarray]:
    col = lambda *cs: np.column_stack([t.column(c).to_numpy() for c in cs])
    order, parent, slices = level_order(t.column("level").to_numpy(), col("k1", "k2"), col("p1", "p2"), label := col("l1", "l2"))
    return Louds.of(parent, np.concatenate((np.zeros((1, 2), np.int64), label[order]))), slices, order


def tries(light: DataFrame) -> DataFrame:
    """shard, its number of nodes, LOUDS bits and labels of the light nodes' tries (read them with
    ``Louds.unpacked``; node 0 stands for what is above)."""

    def build(t: pa.Table) -> pa.Table:
        bits, labels = (louds := _shard_trie(t)[0]).packed()
        return pa.table({"shard": t.column("shard")[:1], "n_nodes": pa.array([len(louds.labels) - 1], pa.int64()), "bits": pa.array([bits], pa.binary()), "labels": pa.array([labels], pa.binary())})

    return light.groupBy("shard").applyInArrow(build, "shard long, n_nodes long, bits binary, labels binary")


OUT = "conv_id long, depth long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, first_end long"


def shard_rollups(light: DataFrame) -> DataFrame:
    """The light nodes with children, leaves and saved tokens of their subtrees. The parent of a shard's upmost
    nodes is left open."""

    def sums(t: pa.Table) -> pa.Table:
        louds, slices, order = _shard_trie(t)
        own = np.column_stack([t.column(c).to_numpy()[order] for c in ("leaf", "saved")])
        total = roll_up(louds, slices, np.concatenate((np.zeros((1, 2), np.int64), own)))[1:]
        conv, parent = t.column("conv_id").to_numpy()[order], louds.parents()[1:]
        known = parent > 0
        t = t.take(pa.array(order))
        return pa.table(
            {
                **{c: t.column(c) for c in ("conv_id", "depth", "p1", "p2")},
                "parent_conv_id": pa.array(np.where(known, conv[parent - 1], 0), pa.int64(), mask=~known),
                "n_convs": t.column("n_convs"),
                "n_children": pa.array(louds.degrees()[1:]),
                "n_leaves": pa.array(total[:, 0]),
                "saved_tokens": pa.array(total[:, 1]),
                **{c: t.column(c) for c in ("n_ends", "first_end")},
            }
        )

    return light.groupBy("shard").applyInArrow(sums, OUT)


def heavy_rollups(tree: DataFrame, upper: DataFrame, light: int = LIGHT) -> DataFrame:
    """The heavy nodes with the same columns; parents are left open. A member brings what is its own below a
    heavy node: all of its light nodes, and its heavy ones from there on."""
    heavy = tree.where(F.col("below") > light)
    base = tree.where(F.col("below") <= light).groupBy("conv_id").agg(F.sum("saved").alias("base_saved"), F.sum("leaf").alias("base_leaf"))
    own = heavy.select("conv_id", "depth", F.col("saved").alias("s"), F.col("leaf").alias("f"))
    none = F.lit(0).cast("long")
    rows = upper.join(own, ["conv_id", "depth"], "left").select("conv_id", *KEY, F.coalesce("s", none).alias("s"), F.coalesce("f", none).alias("f"))
    summed = running(rows, "conv_id", [F.desc("depth")], ["s", "f"], "upper-sums").join(base, "conv_id", "left")
    brought = summed.groupBy(*KEY).agg(F.sum(F.col("run_s") + F.coalesce("base_saved", none)).alias("saved_tokens"), F.sum(F.col("run_f") + F.coalesce("base_leaf", none)).alias("n_leaves"))
    children = tree.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    out = heavy.join(brought, KEY).join(children, KEY, "left")
    return out.select("conv_id", "depth", "p1", "p2", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens", "n_ends", "first_end")


def digests(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``first_end`` and the SHA-256 of the comma-joined conv_ids, ascending, of each group of ``members``."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            at = [(s, min(s + chunk, e)) for a, e in zip(cuts, cuts[1:], strict=False) for s in range(a, e, chunk)]
            rows = [(int(of[s]), ids[s], ",".join(map(str, ids[s:e]))) for s, e in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["first_end", "at", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        names = ["first_end", "ends_sha256"]
        for b in batches:
            done = []
            for of, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if of != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = of, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in ((0, pa.int64()), (1, pa.string()))], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], names)

    pieces = members.repartitionByRange("first_end", "conv_id").sortWithinPartitions("first_end", "conv_id").mapInArrow(joined, "first_end long, at long, ids string")
    return pieces.repartition("first_end").sortWithinPartitions("first_end", "at").mapInArrow(tidy(hashed), "first_end long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, every: int = 20, most: int = 4, light: int = LIGHT, shard: int = SHARD) -> DataFrame:
    """One row for every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256."""
    own = turns(conversations)
    rows, convs = rebuilt(own, every, most)
    paths = prefixes(rows)
    discard(own)
    tree = nodes(paths)
    below, upper = dealt(tree, paths, light, shard)
    all_rows = shard_rollups(below)
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.count_if(F.col("length") == 0).alias("ends"), F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("first_end")).first()
    if upper is not None:
        hrows = heavy_rollups(tree, upper, light)
        parents = tree.where(F.col("below") > light).select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("heavy_conv_id"))
        all_rows = all_rows.unionByName(hrows).join(parents, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "heavy_conv_id"))
    all_rows = all_rows.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv"]).cast("long")).otherwise(F.col("parent_conv_id"))).drop("p1", "p2", "heavy_conv_id")
    sums = tree.agg(F.count_if(F.col("depth") == 1), F.sum("leaf"), F.sum("saved")).first()
    first = [(top["conv"], 0, None, top["n"], sums[0], sums[1] or 1, sums[2] or 0, top["ends"], top["first_end"])] if top["n"] else []
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "first_end"]
    root = conversations.sparkSession.createDataFrame(first, ", ".join(f"{c} long" for c in columns))
    several = tree.where("n_ends > 1").select(*KEY, "first_end")
    members = paths.where("depth = length").join(several, KEY).select("first_end", "conv_id").unionByName(convs.where("length = 0").select(F.lit(top["first_end"]).cast("long").alias("first_end"), "conv_id"))
    known = materialize(digests(members), "ends")
    discard(paths)
    out = all_rows.select(*columns).unionByName(root).join(known, "first_end", "left")
    ends = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    return out.select(*columns[:-2], ends.alias("ends_sha256"))
