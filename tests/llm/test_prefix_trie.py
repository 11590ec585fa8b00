"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import prefix_trie as P
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths_of(rows) -> dict[int, list]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        base, h = c - c % 20 if c >= 0 else c + (-c) % 20, zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def plain(rows) -> set[tuple]:
    convs = paths_of(rows)
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[: d - 1])].add(tuple(path[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        value = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not kids[node]
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df) -> list[tuple]:
    assert df.columns == COLUMNS
    return [tuple(r) for r in df.collect()]


def agrees(df, rows) -> None:
    found = got(df)
    assert len(found) == len(set(found)) and set(found) == plain(rows)


def made(seed: int, n: int, shapes: int = 6) -> list[tuple]:
    rng, rows = random.Random(seed), []
    says = [f"word {i} and  more {'x ' * i}" for i in range(shapes)] + ["", None]
    for c in rng.sample(range(-40, 10 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "assistant", None]), rng.choice(says[: 1 + t * 2])))
    return rows


@pytest.mark.parametrize(("light", "shard"), [(16_384, 65_536), (16_384, 20), (30, 20), (3, 5), (0, 1)])
def test_trees_of_any_cut(spark, light, shard):
    rows = made(light + shard, 150)
    agrees(P.prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), light=light, shard=shard), rows)


def test_conversations_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    agrees(P.prefix_nodes(table), rows)
    agrees(P.prefix_nodes(table, light=8, shard=10), rows)


def test_copies_hot_openings_and_a_long_conversation(spark):
    rows = [(c, t, "system", "same") for c in range(300) for t in range(3)] + [(c, 3, "user", f"own {c % 7}") for c in range(0, 300, 3)]
    rows += [(5000, t, "user", f"turn {t}") for t in range(150)] + [(5001, t, "user", f"turn {t}") for t in range(140)]
    table = spark.createDataFrame(rows, SCHEMA)
    for light in (16_384, 100):
        agrees(P.prefix_nodes(table, light=light), rows)


def test_odd_rows(spark):
    rows = [(20, None, None, None), (20, 1, "", ""), (21, 7, "user", "a\x0bb"), (21, -1, "user", "\x1c \x85"), (22, 1, "x", "y"), (41, 0, "user", "z" * 100_000), (7, 1, "a", "b"), (7, 2, "a", "b")]
    table = spark.createDataFrame([*rows, (None, 1, "a", "b")], SCHEMA).withColumns({"k1": F.lit("x"), "part": F.lit(1), "depth": F.lit(None)})
    agrees(P.prefix_nodes(table), rows)
    assert got(P.prefix_nodes(table.limit(0))) == []
    # turns that all go: 1 to 3 of its own, and no conversation to take an opening from
    alone = [(c, 0, "user", "only") for c in range(61, 80)]
    agrees(P.prefix_nodes(spark.createDataFrame(alone, SCHEMA)), alone)
    twice = [(40, 1, "user", "a"), (40, 1, "user", "a"), (40, 1, "user", "a")]
    agrees(P.prefix_nodes(spark.createDataFrame(twice, SCHEMA)), twice)


def test_running_sums_go_over_partitions(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("CAST(id DIV 700 AS BIGINT) AS g", "id AS n", f"{P.MOD - 3} + id % 2 AS v")
    parted = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = P.running(rows, "g", [F.desc("n")], ["v"], "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parted)
    total = defaultdict(int)
    for i, r in enumerate(sorted(out, key=lambda r: (r["g"], -r["n"]))):
        total[r["g"]] += r["v"]
        assert r["run_v"] == total[r["g"]] % P.MOD and r["nth"] == (i + 1 if r["g"] == 0 else i - 699)


def test_louds_finds_prefixes(spark):
    rows = made(9, 80)
    paths = P.prefixes(P.rebuilt(P.turns(spark.createDataFrame(rows, SCHEMA)))[0])
    tree = P.nodes(paths)
    light, upper = P.dealt(tree, paths, shard=40)
    assert upper is None
    tries = {r["shard"]: P.Louds.unpacked(bytes(r["bits"]), bytes(r["labels"])) for r in P.tries(light).collect()}
    assert len(tries) > 1 and sum(len(t.labels) - 1 for t in tries.values()) == tree.count()
    where = {r["first"]: r["shard"] for r in light.select("first", "shard").collect()}
    convs = defaultdict(list)
    for r in paths.orderBy("conv_id", "depth").collect():
        convs[r["conv_id"]].append(r)
    for path in convs.values():
        trie, labels = tries[where[path[0]["first"]]], [(r["l1"], r["l2"]) for r in path]
        assert len(trie.walk(labels)) == len(path) and len(trie.walk([*labels[:1], (1, 1)])) == 1
    for t in tries.values():
        assert (t.degrees().sum() == len(t.labels) - 1) and (np.diff(t.parents()) >= 0).all()
        assert all(t.parents()[c] == i for i in range(len(t.labels)) for c in t.children(i))
