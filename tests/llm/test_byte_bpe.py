"""Byte-level BPE against the tiktoken library, character offsets and split characters."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row

from siteaudit.llm import byte_bpe as B

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", " ", "\n", "  a  b   ", "I'll we've don't 'S", "tab\t\tend \n\n x", "a  b\x85c\x1cd", "日本語のテキスト 漢字", "😀👩‍👩‍👧‍👦 ok", "<|endoftext|> <|endoftext|>",
    "\x00\x01\x7f", "naïve é Ⅳ ½ ١٢٣", "a" * 3000, "=-" * 2000, " " * 500 + "x", "\n" * 700, "zwj‍﻿", "�", "x1y2 3.14,15",
]


def _fuzz(n: int) -> list[str]:
    rng = random.Random(5)
    kinds = ["abcdeorst", " \n\t\r 　", "0123456789١٢", ".,;'!?-_\"“”", "éßждλ", "日本語漢字", "😀🎉", "'s't're've'm'll'd"]
    return ["".join(rng.choice(rng.choice(kinds)) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_model_agrees_with_tiktoken():
    tokenizer = B._loaded(B.model(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for text in ODD + _fuzz(3000):
        ids, _ = B._encoded(tokenizer, text, B.LONG, False)
        assert ids.tolist() == PLAIN.encode_ordinary(text), text
        assert B._encoded(tokenizer, text, 5, False)[0].tolist() == ids.tolist(), text


def test_parts_are_the_text():
    for text in ODD + _fuzz(300):
        assert "".join(B.parts(text, 7)) == text


def test_offsets_and_split_characters():
    serialised = B.model(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tokenizer, known = B._loaded(serialised), B._token_bytes(serialised)
    for text in ODD + _fuzz(500):
        ids, spans = B._encoded(tokenizer, text, 6, True)
        at, where = 0, [i for i, c in enumerate(text) for _ in c.encode()]
        for i, (start, end) in zip(ids.tolist(), spans.tolist(), strict=True):
            size = len(known[i])
            assert (start, end) == (where[at], where[at + size - 1] + 1), text
            at += size
        assert at == len(where)
        assert "".join(B.token_texts(ids.tolist(), serialised)) == text
    split = B._encoded(tokenizer, "語", B.LONG, False)[0].tolist()
    assert len(split) > 1 and B.token_texts(split, serialised) == [""] * (len(split) - 1) + ["語"]
    assert B.token_texts(split[:1], serialised) == ["�"]


def test_rows_of_any_kind(spark):
    texts = [None, *ODD, "word " * 200_000 + "日本語 " * 1000, ODD[3], ODD[3]]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, key="k", ids=1, decoded=2) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids int, decoded int")
    got = {r["doc_id"]: r for r in B.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = np.array(PLAIN.encode_ordinary(t or "") if not (t and len(t) > 10**6) else [x for p in B.parts(t) for x in PLAIN.encode_ordinary(p)], "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.round_trip(docs.limit(0)).collect() == []
    full = B.encode(docs, offsets=True).where("doc_id = 8").first()
    assert [t for t in full["ids"]] == PLAIN.encode_ordinary(texts[8]) and full["ends"][-1] == len(texts[8])


def test_decode_of_other_ids(spark):
    rows = spark.createDataFrame([(1, [15339, 995]), (2, None), (3, []), (4, [60000]), (5, PLAIN.encode_ordinary("漢")[:1])], "n int, ids array<int>")
    out = {r["n"]: r for r in B.decode(rows).withColumn("text", B.as_text("decoded")).collect()}
    assert bytes(out[1]["decoded"]) == PLAIN.decode_bytes([15339, 995])
    assert out[2]["decoded"] is None and out[4]["text"] is None and out[3]["text"] == "" and out[5]["text"] == "�"
    with pytest.raises(ValueError, match="already"):
        B.decode(rows, to="n")


def test_merges_lead_to_every_token():
    assert B.last_merge(b"ab", {b"a": 0, b"b": 1, b"ab": 2}) == (b"a", b"b")
    with pytest.raises(ValueError, match="no merges"):
        B.last_merge(b"abc", {b"a": 0, b"b": 1, b"c": 2, b"abc": 3})
