"""Packing: texts that other encoders refuse, and the rule against a plain packer."""

import random
import zlib

import numpy as np
import pytest

from siteaudit.llm import packing


def plain_pack(lengths, capacity, weigh_opening):
    """Gaps after each choice, every sum counted out in full."""
    gaps, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]

        def total(after):
            return sum(sum(g == h for g in after) ** 2 for h in set(after) if h)

        choices = []
        for gap in sorted({g for g in gaps if g >= n}):
            b = len(gaps) - 1 - gaps[::-1].index(gap)
            choices.append((total([g - n if j == b else g for j, g in enumerate(gaps)]), 0, gap - n, b))
        if weigh_opening or not choices:
            choices.append((total([*gaps, capacity - n]), 1, capacity - n, len(gaps)))
        _, opened, gap, b = min(choices)
        if opened:
            gaps.append(capacity)
        where[i] = capacity - gaps[b]
        gaps[b] = gap
    return sorted(gaps), where


@pytest.mark.parametrize("weigh_opening", [False, True])
def test_rule_equals_plain_packer(weigh_opening):
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.choice([7, 10, 24])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        bins, offsets = packing.pack(np.array(lengths, np.int64), capacity, weigh_opening)
        gaps, where = plain_pack(lengths, capacity, weigh_opening)
        full = np.bincount(bins, weights=lengths) if lengths else np.empty(0)
        assert sorted((capacity - full).tolist()) == gaps
        assert offsets.tolist() == [where[i] for i in range(len(lengths))]


def test_opening_as_a_choice_needs_more_bins():
    lengths = np.random.default_rng(1).integers(1, 2048, 4000)
    few, more = (packing.pack(lengths, weigh_opening=w)[0].max() + 1 for w in (False, True))
    assert few <= more and few <= 1.01 * lengths.sum() / 2048 + 1


def test_long_runs_pack_and_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * 1_000_000 for c in " \na"] + ["\t \r\n" * 250_000, "x" + " " * 900_000 + "y", "<|endoftext|>" + " " * 800_000]
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(texts)], "doc_id long, text string, length int, row string")
    rows = packing.pack_documents(docs).collect()
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cuts(len(ids))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in packing.cuts(len(ids))]


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, None, None, None)], "doc_id long, text string, sequence_id long, bucket string")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.piece, r.offset) for r in rows) == [(0, 0, 6), (1, 0, 0), (1, 0, 3)]
    assert len({r.sequence_id for r in rows}) == 1
