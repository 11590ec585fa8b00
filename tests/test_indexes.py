"""Places in a sorted table, and search through trigrams, against plain versions."""

import random
import re

from pyspark.sql import functions as F

from siteaudit.operators import body_index, ordinal
from tests.conftest import SF


def test_pages_at_any_place(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 13).alias("v"), F.lit("x").alias("part_of"))
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    index = ordinal.build(rows, order, str(tmp_path), 6)
    plain = [(r.id, r.v) for r in rows.orderBy(*order).collect()]
    assert index.total == 5000 and len(index.starts) > 3
    for offset, size in ((0, 10), (1234, 200), (4990, 200), (5000, 10), (0, 5000), (index.starts[1][1] - 1, 2), (index.starts[2][1], 1), (-5, 8), (9, 0)):
        got = index.page(offset, size).collect()
        want = list(enumerate(plain))[max(0, offset) : max(0, offset + size)]
        assert [(r.ordinal, (r.id, r.v)) for r in got] == want, offset
    assert ordinal.load(spark, str(tmp_path)).find(F.col("id") == 3000).first().ordinal == plain.index((3000, 3000 % 13))
    empty = ordinal.build(rows.limit(0), order, str(tmp_path / "none"))
    assert empty.total == 0 and empty.page(0, 5).collect() == []


def test_a_page_reads_its_partition_alone(spark, tmp_path):
    index = ordinal.build(spark.range(200_000).select("id", (F.col("id") * 7919 % 200_003).alias("v")), [F.col("v")], str(tmp_path), 20)
    read = index.page(120_000, 50)
    assert read.count() == 50
    scan = next(line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert len(re.findall(r"\(?part#\d+ = \d+", scan.partition("PartitionFilters")[2].partition("PushedFilters")[0])) == 1


def test_required_trigrams():
    text = lambda g: chr(g >> 14) + chr(g >> 7 & 127) + chr(g & 127)
    of = lambda n, r=False: {text(g) for g in body_index.required(n, r)}
    assert of("Abcd") == {"abc", "bcd"} and of("ab") == set() and of("aé b") == set() and of("\u017f\u212a\u0130") == {"ski"} and of("a?b?c") == set()
    assert body_index.literals("abc+d?ef{2,3}g") == ["abc", "e", "g"] and body_index.literals("a|b") == [] and body_index.literals("x(ab|c)*yz[^]a]w") == ["x", "yz", "w"]
    assert body_index.literals(r"a\.b\d+cde") == ["a.b", "cde"] and body_index.literals("(?i)abc") == [] and body_index.literals(r"\x41bc") == [] and body_index.literals("ab*") == ["a"] and body_index.literals("((a)b)?cd$") == ["cd"]


def test_search_agrees_with_a_full_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "ſtraße", "\u212aelvin", "naïve", "x.y", "İstanbul", "a?b", "日本語", "the", "THE", "cat", "dog"]
    rows = [(i, " ".join(rng.choice(words[: 4 + i % 11]) for _ in range(rng.randrange(30)))) for i in range(400)] + [(400, None), (None, "alpha"), (401, ""), (402, "rare needle here"), (402, "rare needle twice")]
    bodies = spark.createDataFrame(rows, "id long, text string")
    index = body_index.build(bodies, str(tmp_path))
    asked = [("alpha", False), ("Straße", False), ("STRASSE", False), ("kelvin", False), ("ist", False), ("x.y", True), ("x.y", False), ("ca", False), ("日本語", False), ("rare needle", False), ("nothing at all", False), ("gam+a the", True), ("(cat|dog) alpha", True), ("cat|dog", True), ("(", True), ("", False), ("be(ta)? gamma", True), ("a?b", False), (r"\bthe\b", True), ("the{0}zzz", True), ("c[aeiou]t dog", True)]
    for needle, is_regex in asked:
        got = sorted((r.id, r.matches) for r in index.search(needle, is_regex).collect())
        found = body_index.pattern(needle, is_regex)
        want = sorted((i, n) for i, t in rows if i is not None and t is not None and found and (n := len(list(found.finditer(t)))))
        assert got == want, needle
    assert index.candidates("rare needle").count() == 1 and index.candidates("nothing at all").count() == 0 and index.candidates("ca") is None and index.candidates("alpha") is None


def test_ids_far_apart(spark, tmp_path, monkeypatch):
    ids = [5, 2**31 - 1, 2**31, 2**40 + 3, -(2**33), 5]
    held = body_index.lists([(body_index.grams("abcd"), i) for i in ids]).to_pylist()
    assert {(r["gram"], r["first"] + o) for r in held for o in r["offsets"]} == {(int(g), i) for g in body_index.grams("abcd") for i in ids} and sum(len(r["offsets"]) for r in held) == 10
    index = body_index.build(spark.createDataFrame([(i, "abcd") for i in ids[:5]] + [(i, "none") for i in range(100, 120)], "id long, text string"), str(tmp_path))
    assert sorted(r.id for r in index.candidates("bcd").collect()) == sorted(ids[:5])


def test_bodies_of_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    index = body_index.build(pages, str(tmp_path), "page_id", "html")
    want = {r.page_id: len(re.findall("track\\(7\\)", r.html)) for r in pages.collect()}
    assert {r.id: r.matches for r in index.search("TRACK(7)").collect()} == {k: v for k, v in want.items() if v}
    assert index.candidates("track(7)").count() < pages.count() / 2
