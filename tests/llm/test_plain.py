"""Plain versions of operators and of the whole pipeline, row by row and pair by pair."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siteaudit.llm import bench_join, bwt_dedup, langid, packing, resampling, sharding, simhash
from tests.llm.test_llm import brute_removal, odd_documents
from tests.llm.test_packing import plain_pack

# ---- op2


def plain_ring(ids, shards, replicas):
    """Shard of each row: its arc's owner while there is room, then clockwise from arc to arc."""
    points, owners = sharding.ring(shards, replicas)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = []
    for n, i in enumerate(ids):
        pos = signed(xxhash.xxh64_intdigest(str(i).encode(), 42))
        arc = next((a for a, p in enumerate(points.tolist()) if p >= pos), 0)
        rows.append((arc, 0 if arc == 0 and pos > points[-1] else 1, pos, i, n))
    rows.sort()
    room, shard, over = sharding.capacities(len(rows), shards), {}, []
    for arc, _, _, _, n in rows:
        s = int(owners[arc])
        if room[s]:
            room[s], shard[n] = room[s] - 1, s
        else:
            over.append((arc, n))
    waiting = []
    for turn in range(2):
        for arc, s in enumerate(owners.tolist()):
            waiting += [n for a, n in over if a == arc and not turn]
            while waiting and room[s]:
                room[s], shard[waiting.pop(0)] = room[s] - 1, s
    return [shard[n] for n in range(len(ids))]


def test_ring_equals_plain_version(spark):
    random.seed(6)
    ids = random.sample(range(10**9), 700)
    got = {r.doc_id: r.shard for r in sharding.assign_shards(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), 9, 16).collect()}
    assert [got[i] for i in ids] == plain_ring(ids, 9, 16)
    more = plain_ring(ids, 10, 16)
    stay = plain_ring(ids[:-7], 9, 16)
    assert sum(a != b for a, b in zip(plain_ring(ids, 9, 16), more, strict=True)) < 0.45 * len(ids)
    assert sum(got[i] != s for i, s in zip(ids[:-7], stay, strict=True)) < 0.1 * len(ids)


# ---- op9


def test_resampling_equals_plain_version(spark):
    random.seed(8)
    texts = [" ".join(random.choice("good fine text of the house and bad junk zz qq".split()) for _ in range(random.randint(1, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 5 == 0) for i in range(0, 120, 2)], "doc_id long, q boolean, t boolean").select("doc_id", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic"))
    got = {r.doc_id: r for r in resampling.resample(docs, labels).collect()}
    drawn = {r.doc_id: (r.text, r.draw) for r in docs.withColumn("draw", F.xxhash64(F.lit(resampling.SEED), "doc_id", "text")).collect()}
    target = {i for i in range(0, 120, 2) if i % 3 == 0 and i % 5}
    raw, good = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for i, (t, _) in drawn.items():
        for b in resampling.ngram_buckets(t).tolist():
            raw[b] += 1
            good[b] += i in target
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    keys = {}
    for i, (t, draw) in drawn.items():
        weight = ratio[resampling.ngram_buckets(t)].sum()
        u = ((draw % (1 << 64) >> 11) + 0.5) / (1 << 53)
        keys[i] = weight - np.log(-np.log(u))
        assert got[i].log_weight == pytest.approx(weight) and got[i].gumbel_key == pytest.approx(keys[i])
    best = sorted(keys, key=keys.get)[-int(len(keys) * resampling.SHARE) :]
    assert {i for i, r in got.items() if r.selected} == set(best)


# ---- long texts


def test_long_texts(spark):
    """A million words: alike in all its parts for op1, with its passage at the very end for op4."""
    long = "the cat and the dog were here " * 150_000
    train = [(i, "the cat and the dog were in the house here", "en") for i in range(40)] + [(50 + i, "und der hund war nicht in dem schönen haus", "de") for i in range(40)]
    docs = spark.createDataFrame([*train, (999, long + " one two three four five six seven eight nine ten eleven", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs).where("doc_id = 999").collect()} == {999: "en"}
    items = spark.createDataFrame([("q", "two three four five six seven eight nine ten eleven")], "item_id string, text string")
    (r,) = bench_join.contamination(docs.where("doc_id = 999"), items).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (7 * 150_000 + 11, 10, 1)
    (r,) = simhash.simhash_components(docs.where("doc_id = 999")).collect()
    assert r.fingerprint == f"{simhash.fingerprint(long + ' one two three four five six seven eight nine ten eleven'):016x}"


# ---- pipeline


def plain_groups(rows):
    """Of each group that links of a Jaccard similarity of 0.8 hold together the first row."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (r["text"] or "").lower().split()) else frozenset() for r in rows]
    root = list(range(len(rows)))

    def at(i):
        return i if root[i] == i else at(root[i])

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared):
                root[at(i)] = at(j)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(at(i), []).append(r)
    return [min(g, key=lambda r: r["doc_id"]) for g in first.values()]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_removed(rows):
    """Texts without the 50-byte strings of earlier documents; what is left of a cut character goes."""
    first, out = {}, []
    for r in rows:
        b = (r["text"] or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], r["doc_id"]), r["doc_id"])
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < r["doc_id"]:
                gone[j : j + 50] = b"\1" * 50
        left = "".join(b[m.start() : m.end()].decode("utf-8", "ignore") for m in re.finditer(rb"\0+", bytes(gone)))
        out.append(r | {"text": None if r["text"] is None else left})
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, exact and near copies on both sides of 0.8, shared passages, a leak, junk, nulls, repeated rows."""
    random.seed(12)
    folder = str(tmp_path_factory.mktemp("planted"))
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 300 AND lang IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    words = sorted({w for t in real for w in t.split()})
    word = lambda: random.choice(words)
    texts = list(real)
    for changed in (1, 2, 3, 4, 5, 6, 7):
        base = [word() for _ in range(120)]
        copy = list(base)
        for i in random.sample(range(120), changed):
            copy[i] = word()
        texts += [" ".join(base), " ".join(copy)]
    passage, item = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(14))
    texts += [f"{' '.join(word() for _ in range(50))} {passage} {' '.join(word() for _ in range(50))}" for _ in range(4)]
    texts += [f"{' '.join(word() for _ in range(40))} {item.upper()} {' '.join(word() for _ in range(40))}", real[0], real[0], "12 !!", None, "", real[1]]
    ids = random.sample(range(10_000), len(texts))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[3])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("a", item), ("b", "words that are nowhere else at all in any of these texts"), ("c", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_plain_version(spark, planted):
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    got = [r.asDict() for r in corpus_pipeline.run(spark, planted).collect()]
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    # the model is learned: what it decides is taken from the operator; everything after is plain
    known = [r.asDict() for r in langid.drop_unknown(docs).collect()]
    assert {r["doc_id"] for r in docs.where("length(text) > 100").collect()} <= {r["doc_id"] for r in known} and len(known) < docs.count()
    kept = plain_removed(plain_groups(known))
    window = {tuple(w[i : i + 10]) for t in [r.text for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()] for w in [plain_words(t)] for i in range(len(w) - 9)}
    kept = [r for r in kept if not any(tuple(w[i : i + 10]) in window for w in [plain_words(r["text"])] for i in range(len(w) - 9))]
    slow, want, lengths = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), []
    for r in kept:
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, (s, n) in enumerate(packing.cuts(len(ids))):
            want[r["doc_id"], p, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
            lengths.append(n)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
    assert len(by) == sum(n == 2048 for n in lengths) + len(plain_pack([n for n in lengths if n < 2048], 2048, False)[0])


def test_stages_take_odd_rows(spark, planted):
    """Nulls in any column, empty texts, repeated rows, clashing names and empty tables through every stage."""
    import corpus_pipeline

    odd = odd_documents(spark).withColumns({"key": F.lit(1), "fp": F.lit("f"), "root": F.lit(None).cast("string"), "shard": F.lit(2), "count": F.lit(3), "sequence_id": F.lit(4), "ws": F.lit("w")})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, planted).collect()
            if name != "packed":
                assert stage(spark, docs, planted).columns == docs.columns, name
                assert len(rows) <= docs.count()
            assert bool(rows) == bool(docs.count()), name
    near = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, odd, planted).collect()}
    assert (7, "ünï cødé — ÄÖÜ words") in near and len([1 for _, t in near if not (t or "").strip()]) == 1 and (8, None) not in near
    left = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in corpus_pipeline.repeated_passages(spark, odd, planted).collect())
    assert left == Counter((i, h) for (i, _, _, _, h), n in brute_removal([(r.doc_id, r.text) for r in odd.collect()]).items() for _ in range(n))


def test_merge_of_many_shards_is_that_of_two():
    """Interleaves of small and large shards, and places too many for one word, give the same windows."""
    rng = np.random.default_rng(3)
    words = rng.integers(97, 123, (40, 30), np.uint8)
    texts = [np.concatenate(words[rng.integers(0, 40, 3)]) for _ in range(600)]
    raw, size, docs = np.concatenate(texts), np.full(600, 90), rng.integers(0, 200, 600)
    plain: dict[bytes, int] = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(41):
            w = t[i : i + 50].tobytes()
            plain[w] = min(d, plain.get(w, d))
    wanted = [plain[t[i : i + 50].tobytes()] for t in texts for i in range(41)]
    for shard_bytes, bits in ((1 << 15, 24), (1 << 10, 24), (1 << 15, 4)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bwt_dedup, "_PLACE_BITS", bits)
            assert bwt_dedup.repeated_windows(raw, size, docs, shard_bytes)[0].tolist() == wanted
