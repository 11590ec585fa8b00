"""The operators against plain versions of themselves, on small inputs with all the odd cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siteaudit.llm import bench_join, bwt_dedup, extraction, langid, near_copies, packing, resampling, sharding, simhash, url_filter, vector_search
from siteaudit.llm.queries import QUERIES
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, grp int"


def odd_documents(spark, extra=()):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names the operators use."""
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "123 !!"), (5, "short"), (None, "a text without an id that is long enough to be repeated elsewhere"), (6, "x" * 5000), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "ünï cødé — ÄÖÜ words"), (8, "a text without an id that is long enough to be repeated elsewhere"), (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), *extra]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None, "r", "h", 1) for i, t in texts], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- op1


def test_crf_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    got, _ = langid.forward_backward(emit, move)
    from itertools import product

    for s in range(2):
        total = np.zeros((4, 3))
        for path in product(range(3), repeat=4):
            w = np.exp(sum(emit[s, i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                total[i, k] += w
        assert np.allclose(got[s], total / total.sum(1, keepdims=True))
    table = rng.normal(size=(10, 3))
    ids = [np.array([1, 2, 3, 9, 0, 4, 4, 4, 5]), np.array([7, 7]), np.array([0])]
    want = [langid.forward_backward(table[i][None], move)[0][0].sum(0) for i in ids]
    assert np.allclose(langid.marginal_sums(table, move, ids), want)


def test_language_query_on_held_out(spark):
    rows = QUERIES["op1_crf_language"](spark, SF).select("doc_id", "held_out", "lang_pred", "score").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_odd_rows(spark):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_documents(spark)).collect()]
    assert len(got) == 11 and {r[0] for r in got if r[1] == "und"} == {2, 3, 4} and all(s == 0 for _, lang, s in got if lang == "und")
    assert langid.predict(empty(spark)).count() == 0
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(unlabelled).collect()} == {"und"} and langid.drop_unknown(unlabelled).count() == 11
    assert langid.drop_unknown(odd_documents(spark)).count() == 8


def test_code_switching_labels():
    spans = [("en", "the cat and the dog were here".split())] * 20 + [("de", "und der hund war nicht schön".split())] * 20
    model = langid.train(spans)
    got = [lang for _, _, lang, _ in model.label("the cat and the dog und der hund war nicht")]
    assert got[:4] == ["en"] * 4 and got[-4:] == ["de"] * 4


# ---- op2


@pytest.mark.parametrize("make", [odd_documents, lambda s: s.createDataFrame([(7, "same")] * 300 + [(i, "t") for i in range(50)], "doc_id long, text string")])
def test_sharding_is_balanced(spark, make):
    docs = make(spark)
    rows = sharding.assign_shards(docs, shards=7).collect()
    assert len(rows) == docs.count()
    loads = Counter(r.shard for r in rows)
    counts = [loads.get(s, 0) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_sharding_plan_moves_little():
    counts, owners = [5, 0, 9, 1], [0, 1, 0, 1]
    placed = sharding.plan(counts, owners, [8, 7])
    assert sum(hi - lo for _, lo, hi, _, _ in placed) == 15 and (0, 0, 5, 0, 0) in placed
    assert sum(hi - lo for a, lo, hi, s, _ in placed if owners[a] != s) == 6
    assert not sharding.plan([0], [0], [0])


def test_sharding_empty(spark):
    assert sharding.assign_shards(empty(spark)).count() == 0


# ---- op3


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/x", "http://example.org/en/12?x#y", "https://x.com/de/", "https://x.com/fr/?/de/", "com/de/", None, "", "x://org", "http://org/", "http://notexample.org/en/1", "http://a.b.c.d.com/de/#/", "http://é.com/de/é", "ftp://example.org/es/", "a://b://c.com/de/", "http://com?/de/", "http://x.com#/de/", "http://.com/de/", "http://" + "a." * 3000 + "com/de/1"]
    urls += [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in url_filter.judge_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[r.page_id], url_filter.RULES), urls[r.page_id]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 7)
    (tmp_path / "f").write_bytes(url_filter.pack_rules([("block", "a.com/"), ("allow", "b.com/x")]))
    array = url_filter.DigestArray(str(tmp_path / "f"))
    assert array.probe([b"a.com/", b"b.com/x", b"c.com/"]).tolist() == [[array.string(0), array.string(1)].index(b"a.com/"), [array.string(0), array.string(1)].index(b"b.com/x"), -1]
    with pytest.raises(ValueError):
        url_filter.pack_rules([("block", "a/"), ("allow", "a/")])


# ---- op4


def brute_contamination(docs, items, window=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        ws, hit, named = cut(text), set(), set()
        for item, t in items:
            iw = cut(t)
            for i in range(max(1, len(iw) - window + 1) if iw else 0):
                w = iw[i : i + window]
                for j in range(len(ws) - len(w) + 1):
                    if ws[j : j + len(w)] == w:
                        hit.update(range(j, j + len(w)))
                        named.add(str(item))
        ids = sorted(named)
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 6
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([14, 12, 10, 10, 5, 2, 1, 3])] + [(8, None), (9, "!!"), (3, say(11)), (11, "the"), (12, "Ünï Cø")]
    items += [(10, items[0][1])]
    docs = [(i, say(random.randint(0, 60))) for i in range(40)] + [(100, items[0][1].upper() + ", " + items[1][1]), (101, None), (102, ""), (102, ""), (103, "w1"), (104, "the the"), (105, "ünï cø x"), (105, "Ünï-cø")]
    got = bench_join.contamination(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, wid int"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.drop("item_ids", "text_hash").collect()) == brute_contamination(docs, items)


def test_contamination_in_blocks_and_empty(spark, monkeypatch):
    docs, items = [(1, "a b c d e f g h i j k l"), (2, "x")], [(1, "b c d e f g h i j k"), (2, "c d e f g h i j k l"), (3, "x")]
    monkeypatch.setattr(bench_join, "MAX_WINDOWS", 1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = bench_join.contamination(d, i).drop("item_ids", "text_hash").collect()
    assert Counter(map(tuple, got)) == brute_contamination(docs, items)
    assert bench_join.contamination(d.limit(0), i).count() == 0
    assert [r.n_hit for r in bench_join.contamination(d, i.limit(0)).collect()] == [0, 0]
    assert [r.doc_id for r in bench_join.drop_contaminated(d, i.where("item_id = 3")).collect()] == [1]


# ---- op5


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b"), (-3, "a <|endoftext|> b"), (-4, "é" * 3000), (-5, "  \n\n\t x  ")], "doc_id long, text string"))
    ids = [(r.doc_id, [*slow.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    want = Counter((d, p, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for d, x in ids for p, (s, n) in enumerate(packing.cuts(len(x))))
    rows = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for own in _by(rows, "sequence_id").values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * total / 2048 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


def _by(rows, name):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out


def test_sum_of_squares_rule():
    bins, offsets = packing.pack(np.array([6, 6, 3, 4, 4]), 10)
    # two gaps of 4 are open: filling one lowers the sum most, and fills the bin
    assert bins.tolist()[:2] == [0, 1] and sorted(bins[3:].tolist()) == [0, 1] and offsets.tolist()[3:] == [6, 6]
    assert packing.cuts(2048) == [(0, 2048)] and packing.cuts(4097) == [(0, 1), (1, 2048), (2049, 2048)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]


# ---- op6


def brute_removal(docs, n=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for j in range(len(b) - n + 1 if i is not None else 0):
            w = b[j : j + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1 if i is not None else 0):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_merged_transforms_equal_brute_force():
    random.seed(1)
    for _ in range(200):
        n, letters = random.choice([5, 10, 20, 50]), random.choice([b"a", b"ab", b"abc\xf4"])
        texts = [bytes(random.choice(letters) for _ in range(random.randint(n, n + 34))) for _ in range(random.randint(1, 12))]
        texts += random.choices(texts, k=random.randint(0, 6))
        docs = np.array([random.randint(0, 9) for _ in texts])
        raw, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        found, text = bwt_dedup.repeated_windows(raw, size, docs, random.choice([10, 60, 1000]), n)
        least = {}
        for t, d in zip(texts, docs.tolist(), strict=True):
            for j in range(len(t) - n + 1):
                least[t[j : j + n]] = min(least.get(t[j : j + n], 99), d)
        assert list(zip(found.tolist(), text.tolist(), strict=True)) == [(least[t[j : j + n]], i) for i, t in enumerate(texts) for j in range(len(t) - n + 1)]


def test_transform_is_the_suffix_order():
    random.seed(7)
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(5, 30))) for _ in range(20)]
    before, left, rank = bwt_dedup.shard_transform(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    begin = np.cumsum([0, *(len(t) + bwt_dedup.ENDS for t in texts)])
    suffixes = sorted(((t[j:], i), i, j) for i, t in enumerate(texts) for j in range(len(t) + 1))
    for r, (_, i, j) in enumerate(suffixes):
        assert rank[begin[i] + j] == r
        symbols = texts[i][j - 5 : j] if j >= 5 else b""
        assert int(before[r]) == int.from_bytes(bytes(c + 1 for c in symbols), "big")
        assert left[r] == (rank[begin[i] + j - 5] if j >= 5 else -1)


def test_removal(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdé ") for _ in range(random.randint(1, 400)))
    shared = [word() + "x" * 60 for _ in range(4)]
    docs = [(i, "".join(random.choice([word(), random.choice(shared)]) for _ in range(4))) for i in range(30)]
    docs += [(40, "y" * 3000), (41, "y" * 3000), (42, "ab" * 2000), (43, "ba" * 2000), (44, None), (45, ""), (3, docs[3][1]), (3, shared[0]), (None, shared[1]), (46, shared[1]), (47, "z" * 49), (48, "z" * 49), (49, "z" * 50), (50, "z" * 50), (-5, shared[2])]
    frame = spark.createDataFrame([(*d, 5, "g") for d in docs], "doc_id long, text string, grp int, kind string")
    for size, hot in ((1 << 22, 1 << 14), (4000, 1 << 14), (4000, 3)):  # one group, several, minimizers in parts
        got = bwt_dedup.substring_spans(frame, size, hot=hot).collect()
        assert Counter(map(tuple, got)) == brute_removal(docs), (size, hot)
    assert bwt_dedup.removal(frame.limit(0)).count() == 0


def test_nothing_goes_without_the_merge(monkeypatch):
    text = np.frombuffer(b"q" * 60 * 2, np.uint8)
    rows = [(0, 0, bwt_dedup._squeeze(np.array([0, 60], "<i4").tobytes()), bwt_dedup._squeeze(text.tobytes()), np.array([60, 60], "<u2").tobytes(), np.array([1, 2], "<i8").tobytes())]
    assert [r[0] for r in bwt_dedup.split_merge(rows)] == [1]
    monkeypatch.setattr(bwt_dedup, "merge_transforms", lambda *a: (np.empty(0, np.int32), np.empty(0, np.int32)))
    assert bwt_dedup.split_merge(rows) == []


def test_a_hot_minimizer_is_merged_in_parts():
    """Of copies that fill a part one is left for the second merge, and it is the first document's."""
    text = bytes(range(60, 120))
    size, n = np.full(500, 60), 500
    row = (7, -5, bwt_dedup._squeeze(np.diff(np.arange(n) * 60, prepend=0).astype("<i4").tobytes()), bwt_dedup._squeeze(text * n), size.astype("<u2").tobytes(), np.arange(3, n + 3).astype("<i8").tobytes())
    out = bwt_dedup.split_merge([row])
    assert [(r[0], r[1]) for r in out] == [(1, 7), (0, -5)]
    assert np.frombuffer(out[1][7], np.int64).tolist() == [3] and bwt_dedup._loosen(out[1][5]) == text


def test_halves_of_characters_do_not_meet(spark):
    run = "q" * 60
    docs = spark.createDataFrame([(1, "ß" + run + "ñ"), (5, "aџ" + run + "éz"), (6, None), (7, "w " * 300_000)], "doc_id long, text string")
    for left in ({r.doc_id: r.text for r in bwt_dedup.without_repeats(docs).collect()}, {5: bwt_dedup._whole_characters("aџxéz".encode(), np.array([0, 0, 1, 1, 1, 0, 0], bool))}):
        assert left[5] == "az"


def test_removal_keeps_columns(spark):
    docs = odd_documents(spark, [(20, "é" + "q" * 80), (21, "zé" + "q" * 80), (22, None)])
    got = {(r.doc_id, r.text, r.n_chars, r.grp) for r in bwt_dedup.without_repeats(docs).collect()}
    assert bwt_dedup.without_repeats(docs).columns == docs.columns
    assert (22, None, 0, 1) in got and (21, "z", 1, 1) in got and (20, "é" + "q" * 80, 81, 1) in got


# ---- op7


def test_search_recall_and_order(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = vector_search.search(rows, rows.where("vec_id % 20 = 0")).collect()
    local = rows.toPandas()
    ids, x = local.vec_id.to_numpy(), np.stack(local.embedding.to_numpy()).astype(np.float64)
    hits = 0
    for q, own in _by(got, "query_id").items():
        own = sorted(own, key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        score = x @ x[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({r.vec_id for r in own} & set(ids[best].tolist()))
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-9 for r in own) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits >= 0.95 * len(got)


def test_recall_without_structure():
    """Vectors of no structure at all are the hardest to quantise."""
    x = np.random.default_rng(5).normal(size=(vector_search.SLICE, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = vector_search.fit(x[:4096])
    codes, norms = vector_search.encode(x, books)
    ids = np.arange(len(x))
    at, found, _ = vector_search.best_of(x[:40], ids[:40], x, ids, codes, norms, books, 20, vector_search.SHORTLIST)
    score = x[:40] @ x.T
    score[np.arange(40), np.arange(40)] = -np.inf
    best = np.argsort(-score, 1)[:, :20]
    assert sum(len(set(found[at == i].tolist()) & set(best[i].tolist())) for i in range(40)) >= 0.9 * 800


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (20, [0.0, 2.0]), (40, None), (0, [1.0, 0.0]), (9, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, norm int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.search(frame, frame.where("vec_id % 20 = 0"), k=3).where("query_id = 20").collect()]
    assert [g[2] for g in sorted(got, key=lambda g: g[1])] == [0, 0, 1] and all(g[3] == 0 for g in got)
    assert vector_search.search(frame.limit(0), frame.limit(0)).count() == 0


def test_search_many_copies(spark):
    """More copies in one slice than the shortlist holds, in no order of their ids, and rows that are nearer than the copies."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    copies = rng.choice(np.arange(1, 2000), 900, replace=False)
    x[copies] = x[copies[0]]
    ids = rng.permutation(2000)
    books = vector_search.fit(x)
    codes, norms = vector_search.encode(x, books)
    asked = np.array([copies[0], copies[1], 0])
    at, found, score = vector_search.best_of(x[asked], ids[asked], x, ids, codes, norms, books, 20, vector_search.SHORTLIST)
    for i, r in enumerate(asked):
        exact = (x * x[r]).sum(1)
        want = [j for j in np.lexsort((ids, -exact)) if j != r][:20]
        assert found[at == i].tolist() == ids[want].tolist() and np.allclose(score[at == i], exact[want])
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = vector_search.search(frame, frame.where(F.col("vec_id") == int(ids[copies[0]]))).collect()
    exact = (x * x[copies[0]]).sum(1)
    want = [int(ids[j]) for j in np.lexsort((ids, -exact)) if j != copies[0]][:20]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == want


def test_table_scores_are_exact_for_the_decoded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    books = vector_search.fit(x, 3, 16)
    codes, norms = vector_search.encode(x, books)
    decoded = sum(books[j][codes[:, j]] for j in range(3))
    assert np.allclose(vector_search.table_scores(x[:5], codes, norms, books), x[:5] @ decoded.T, atol=1e-4) and np.allclose(norms, (decoded**2).sum(1), atol=1e-3)
    wide, _ = vector_search.encode(x, books, 8)
    error = lambda c: ((x - sum(books[j][c[:, j]] for j in range(3))) ** 2).sum()
    assert error(wide) <= error(vector_search.encode(x, books, 1)[0])


# ---- op8


def test_fingerprint_equals_plain_version():
    for text in ("A b\tc  d", "a b", "", None, "x\x0by z é É\u00a0w", "a a a a"):
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_trees_lose_no_link(monkeypatch):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(60)]
    values = [b ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 4))) for b in base for _ in range(5)]
    values = np.array(values, np.uint64)
    for radius in (3, 20):
        q, v = simhash.BKTree(values).within(values[:50], radius)
        assert Counter(zip(q.tolist(), v.tolist(), strict=True)) == Counter((i, j) for i in range(50) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= radius)
    values = np.unique(values)
    parent = {v: v for v in values.tolist()}
    up = lambda x: x if parent[x] == x else up(parent[x])
    monkeypatch.setattr(simhash, "_TOGETHER", 7)
    for us, vs in simhash.Linker(values).links(values):
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            parent[up(u)] = up(v)
    assert _groups({v: up(v) for v in values.tolist()}) == _groups(_closed(values.tolist()))


@pytest.mark.parametrize("tree, count", [(4096, None), (64, None), (5, 20), (4096, 4096 << 16), (4096, 4096 << 20), (4096, 4096 << 30)])
def test_links_of_all_plans(spark, tree, count):
    """One tree for all, shards of some bits of one block, trees split within a shard, and two blocks."""
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 4))) for b in base for _ in range(6)})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = simhash.links(fps, tree=tree, count=count)
    parent = {v: v for v in values}
    up = lambda x: x if parent[x] == x else up(parent[x])
    for r in got.collect():
        parent[up(r.u % (1 << 64))] = up(r.v % (1 << 64))
    assert _groups({v: up(v) for v in values}) == _groups(_closed(values))


def _closed(values):
    out = {}
    for v in values:
        if v in out:
            continue
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += [w for w in values if (w ^ x).bit_count() <= 3]
    return out


def _groups(of):
    out = {}
    for v, r in of.items():
        out.setdefault(r, set()).add(v)
    return {frozenset(x) for x in out.values()}


def test_near_duplicates(spark):
    docs = odd_documents(spark, [(30 + i, " ".join(f"w{j if j != i * 7 else 900 + i}" for j in range(150))) for i in range(8)])
    rows = simhash.simhash_components(docs).collect()
    own = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    root = _closed(sorted({f for _, f in own}))
    least = {g: min((i for i, f in own if root[f] == g and i is not None), default=None) for g in set(root.values())}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter((i, f"{f:016x}", least[root[f]]) for i, f in own)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter(least.values()) and simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    got = simhash.components(spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)} and len(got) == 43


# ---- op9


def test_ngram_buckets_equal_plain_version(monkeypatch):
    a, b = resampling.ngram_buckets("Ab cd. AB cd"), resampling.ngram_buckets("ab CD ab,cd")
    assert a.tolist() == b.tolist() and len(a) == 7 and a[0] == a[2] and a[4] == a[6]
    long = "word " * 300_000
    got = resampling.ngram_buckets(long)
    assert len(got) == 599_999 and len(set(got.tolist())) == 2
    assert len(resampling.ngram_buckets("q" * 3_000_000)) == 1 and len(resampling.ngram_buckets(None)) == 0


def test_resampling(spark):
    docs = odd_documents(spark, [(100 + i, "good words here today" if i % 2 else "bad stuff nothing else") for i in range(40)])
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (1, None, 0), (5, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = resampling.resample(docs, labels).collect()
    chosen = [r for r in rows if r.selected]
    assert len(rows) == 51 and len(chosen) == 25
    assert min(r.gumbel_key for r in chosen) >= max(r.gumbel_key for r in rows if not r.selected)
    good = [r for r in rows if r.doc_id and r.doc_id >= 100 and r.doc_id % 2]
    bad = [r for r in rows if r.doc_id and r.doc_id >= 100 and not r.doc_id % 2]
    assert min(r.log_weight for r in good) > max(r.log_weight for r in bad) and min(r.quality for r in good) > max(r.quality for r in bad)
    again = {(r.doc_id, r.gumbel_key) for r in resampling.resample(docs, labels).collect()}
    assert again == {(r.doc_id, r.gumbel_key) for r in rows}
    assert resampling.resample(empty(spark), labels).count() == 0
    alike = spark.createDataFrame([(1, "a")] * 9, "doc_id long, text string")
    assert sum(r.selected for r in resampling.resample(alike, labels.limit(0)).collect()) == 4


# ---- op10


def test_extraction():
    body = "The quick fox and the dog were in the garden of the house, and it was all that they had to see for this day. " * 3
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home and more of the things to see</a></nav><div class="cookie-notice">{body}</div><article><h1>Head &amp; line</h1><p>{body}<br>Second
    line</p><p>Ok.</p><form><input>Sign up for the news</form><script>var a="<p>x</p>"</script><p>Tail</p></article><aside>{body}</aside><section class="comments"><p>{body}</p></section><footer>{body}</footer></body>"""
    one = " ".join(body.split())
    assert extraction.extract(page) == f"Head & line\n{one} Second line\nOk.\nTail"
    assert extraction.extract(None) == "" and extraction.extract("") == "" and extraction.extract("<nav>x</nav>") == ""
    assert extraction.extract(f"<p>{body}<div class=menu>{body}</div><p>{body}") == f"{one}\n{one}"
    assert extraction.extract("<article><p>One.<p>Two.</article>") == "One.\nTwo."


def test_page_query(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article>a &lt; b</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract_pages(pages).collect()) == [(0, "a < b", 5), (1, "", 0), (1, "", 0)]
    rows = QUERIES["op10_block_rules"](spark, SF).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) and "<" not in r.text[:1] for r in rows)


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = bench_join.materialize(stage(spark, now, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= now.count()
        now = after
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in now.collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_near_copies_equal_brute_force(spark):
    """Planted copies on both sides of 0.8, a large group of near copies, and odd rows, against all pairs."""
    import corpus_pipeline

    random.seed(11)
    word = lambda: f"w{random.randrange(4000)}"
    texts = []
    for changed in [1, 2, 3, 4, 5, 6, 7, 8] * 4:  # of 150 words: similarities of 0.97 down to about 0.6
        base = [word() for _ in range(150)]
        copy = list(base)
        for i in random.sample(range(150), changed):
            copy[i] = word()
        texts += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        copy[random.randrange(120)] = word()
        texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(30))
    texts += [f"{line} {' '.join(word() for _ in range(60))}" for _ in range(20)]
    texts += [None, "", " ", "one two", "One  two", "a b c d e", texts[0], texts[0]]
    ids = random.sample(range(1000), len(texts) - 2) + [None, 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, grp int")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))
    at, between = lambda i: i if root[i] == i else at(root[i]), 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * shared >= 8 * (len(sets[i]) + len(sets[j]) - shared):
                between += 10 * shared < 9 * (len(sets[i]) + len(sets[j]) - shared)
                root[at(i)] = at(j)
    assert between > 10
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(at(i), []).append(x)
    want = sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == want
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
