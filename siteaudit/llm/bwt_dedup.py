"""Exact substring removal with merged Burrows-Wheeler transforms.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document with a smaller
doc_id. Strings that can repeat are first brought together: every window of ``LENGTH`` bytes has a
minimizer (its ``GRAM``-byte gram of smallest hash), equal windows have equal minimizers, and a
stretch of neighbouring windows with one minimizer is a segment of at most ``LENGTH + SPREAD - 1``
bytes. Segments whose minimizer occurs in one document only cannot repeat and stay behind. All
others go to buckets by their minimizers, each occurrence as a text of its own with its document:
nothing is known to repeat before the buckets are merged.

In a bucket the segments are dealt to shards. Each shard's suffixes are sorted once for its own
transform: the ``STEP`` symbols before each suffix, and the LF mapping, which says where in the
shard's order the suffix so much further left stands. The shards are then merged by iterative
interleave refinement from these alone: every round re-deals the interleave by the symbols before
its suffixes and steps left, so that after r rounds it is right for the first ``STEP`` r symbols,
and splits the blocks of suffixes that agree so far. No suffixes are compared across shards. Only
suffixes that will stand at the start of a window take part, and blocks whose suffixes all come from
one document are left out, as nothing can be removed in them. After ``LENGTH / STEP`` rounds the
blocks are the intervals of common prefix ``LENGTH``, and the smallest doc_id of each says which of
its windows go.

A minimizer with more than ``HOT`` occurrences is dealt to parts of about so many, which are merged
each by itself; what is left there after removal meets in a second merge. Of a window that goes in
its part one from a smaller document is left, so nothing is lost, and of copies next to nothing is
left.

Null text is empty. A null doc_id has no order: such a row neither loses nor causes anything.
Rows of one doc_id do not remove each other's bytes. Texts of any length are read whole. Repeated
rows give repeated results; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bound_batches, trim

LENGTH = 50
GRAM = 16
#: Windows that share a minimizer stand this close at most.
SPREAD = LENGTH - GRAM + 1
GROUP_BYTES = 8 << 20
SHARD_BYTES = 1 << 15
#: Buckets of segments for each document group: what a bucket's merge holds is this much less.
BUCKETS_A_GROUP = 16
#: Occurrences of one minimizer that are merged in one place.
HOT = 1 << 14
#: Symbols of one refinement, and end symbols after each text.
STEP, ENDS = 5, 8
_CHUNK = 1 << 16
_KEY_BITS = 48
_PLACE_BITS = 24
_PART_BITS = 15

# ---- segments -------------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    step, base = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        step, base = 2 * step, base * base % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n, k = len(h) - width + 1, 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return h[:n] if k == width else np.minimum(h[:n], h[width - k : width - k + n])


def segments(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer of all segments of texts that lie one after
    the other in ``raw``."""
    first, count, key = [], [], []
    ends = np.cumsum(sizes)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        for lo in range(begin, end - LENGTH + 1, _CHUNK):
            low = _sliding_min(_gram_hashes(raw[lo : min(lo + _CHUNK, end - LENGTH + 1) + LENGTH - 1]), SPREAD)
            cut = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
            n = np.diff(np.append(cut, len(low)))
            if n.max() > SPREAD:  # a run of equal minimizers, as in periodic text
                pieces = -(-n // SPREAD)
                inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                n_all = np.minimum(np.repeat(n, pieces) - inner * SPREAD, SPREAD)
                cut, n = np.repeat(cut, pieces) + inner * SPREAD, n_all
            first.append(lo + cut)
            count.append(n)
            key.append(low[cut])
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(key)


# ---- transforms -----------------------------------------------------------------------------


def _stably(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``STEP`` symbols in order, and where each was; equal ones stay in order."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    if 8 * STEP + int(bits) > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order.astype(np.int32)
    packed = np.sort((keys << bits) | np.arange(len(keys), dtype=np.uint64))
    return packed >> bits, (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int32)


def shard_transform(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of a shard of texts that lie one after the other in ``raw``: for each suffix in
    order the ``STEP`` symbols before it and its LF mapping, where the suffix that begins with them
    stands; and the order's place of each symbol.

    Symbols are bytes + 1 (no byte of UTF-8 is 255); each text is followed by ``ENDS`` end symbols 0,
    which rank by their texts. Places of symbols count in the texts so written. A suffix with fewer
    symbols before it in its text gets 0 and -1. Suffixes that are ends only come first."""
    texts, total = len(size), len(raw)
    place = np.arange(total, dtype=np.int32) + np.repeat((ENDS * np.arange(texts)).astype(np.int32), size)
    end = (np.cumsum(size) + ENDS * np.arange(texts)).astype(np.int32)
    ends, n = np.repeat(end, size), total + ENDS * texts
    symbols = np.zeros(n + STEP, np.uint8)
    symbols[place] = raw + 1
    pair = (symbols[:-1].astype(np.uint16) << 8) | symbols[1:]
    four = (pair[:-2].astype(np.uint32) << 16) | pair[2:]
    key = (four[:n].astype(np.uint64) << np.uint64(8)) | symbols[STEP - 1 : STEP - 1 + n]
    sorted_keys, order = _stably(key[place])
    head = np.ones(total, bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.zeros(n, np.int32)
    rank[end] = np.arange(texts)
    rank[place[order]] = texts + np.maximum.accumulate(np.where(head, np.arange(total, dtype=np.int32), 0))
    bits = np.uint64(max(1, (total + texts).bit_length()))
    if 3 * int(bits) > 64:
        raise ValueError("the shard is too large")
    width, at = STEP, None
    while True:
        # only suffixes that share a rank are ordered anew, by the rank ``width`` further on; a tie
        # reaches past an end only if both end at once, and the end's rank, by text, decides
        tied = ~head
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied) if at is None else at[tied]
        if not len(at):
            break
        old = order[at]
        where = place[old]
        packed = rank[where].astype(np.uint64)
        packed <<= bits
        packed |= rank[np.minimum(where + width, ends[old])].astype(np.uint64)
        packed <<= bits
        packed |= old.astype(np.uint64)
        packed.sort()
        old = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int32)
        order[at] = old
        packed >>= bits
        head = np.ones(len(at), bool)
        head[1:] = packed[1:] != packed[:-1]
        rank[place[old]] = texts + np.maximum.accumulate(np.where(head, at, 0)).astype(np.int32)
        width *= 2
    suffixes = np.concatenate((end, place[order]))
    rank[suffixes] = np.arange(len(suffixes), dtype=np.int32)
    begin = (end - size).astype(np.int32)
    room = suffixes - np.concatenate((begin, np.repeat(begin, size)[order])) >= STEP
    before, left = np.zeros(len(suffixes), np.uint64), np.full(len(suffixes), -1, np.int32)
    before[room] = key[suffixes[room] - STEP]
    left[room] = rank[suffixes[room] - STEP]
    return before, left, rank


def merge_transforms(before: np.ndarray, left: np.ndarray, now: np.ndarray, colour: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards, whose transforms lie end to end in ``before`` and ``left`` (LF mappings count in
    both), refining the interleave ``now`` of suffixes round by round. Returns which of ``now`` are
    left, and their block numbers: suffixes of one block are led by the same ``length`` symbols.
    Blocks of one colour only are left out: whatever they are refined into has one colour too."""
    if length % STEP:
        raise ValueError("each round adds STEP symbols")
    # what is looked up or dealt together is kept in one word: symbols and mapping, colour and place
    joint = (before << np.uint64(_PLACE_BITS)) | (left + 1).astype(np.uint64) if len(before) < (1 << _PLACE_BITS) - 1 and 8 * STEP + _PLACE_BITS <= 64 else None
    tag = (colour.astype(np.int64) << 32) | np.arange(len(now))
    block = np.zeros(len(now), np.int32)  # nothing is compared yet
    for _ in range(length // STEP):
        if not len(now):
            break
        if joint is None:
            key, now = before[now], left[now]
        else:
            found = joint[now]
            key, now = found >> np.uint64(_PLACE_BITS), (found & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int32) - np.int32(1)
        symbols, by = _stably(key)
        held, tag = block[by], tag[by]
        fresh = np.ones(len(by), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        fresh[1:] |= held[1:] != held[:-1]
        block = np.cumsum(fresh, dtype=np.int32)
        # a block with a second colour has it beside another one
        tint = (tag >> 32).astype(np.int32)
        mixed = np.zeros(block[-1] + 1, bool)
        mixed[block[1:][(tint[1:] != tint[:-1]) & ~fresh[1:]]] = True
        stay = mixed[block]
        if not stay.all():
            by, block, tag = by[stay], block[stay], tag[stay]
        now = now[by]
    return (tag & 0xFFFFFFFF).astype(np.int32), block


def repeated_windows(raw: np.ndarray, size: np.ndarray, docs: np.ndarray, shard_bytes: int = SHARD_BYTES, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For texts of at least ``length`` bytes, one after the other in ``raw``, with a doc each: the
    smallest doc whose text has each window, and which text the window is from, in order."""
    begin = np.cumsum(size) - size
    shards = max(2, -(-len(raw) // shard_bytes))
    bounds = np.unique(np.concatenate(([0, len(size)], np.searchsorted(begin, np.linspace(0, len(raw), shards + 1)[1:-1])))).tolist()
    ids, colour = np.unique(docs, return_inverse=True)
    windows = size - length + 1
    befores, lefts, starts, base = [], [], [], 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        own, n = size[a:b], windows[a:b]
        before, left, rank = shard_transform(raw[begin[a] : begin[b - 1] + size[b - 1]], own)
        befores.append(before)
        lefts.append(np.where(left >= 0, left + base, -1).astype(np.int32))
        # the suffix right behind each window
        first = begin[a:b] - begin[a] + ENDS * np.arange(b - a) + length
        starts.append(rank[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)] + np.int32(base))
        base += len(before)
    text = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    own = colour.astype(np.int32)[text]
    which, block = merge_transforms(np.concatenate(befores), np.concatenate(lefts), np.concatenate(starts), own, length)
    least = own.copy()
    if len(which):
        heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        least[which] = np.repeat(np.minimum.reduceat(own[which], heads), np.diff(np.append(heads, len(which))))
    return ids[least], text


# ---- stages ---------------------------------------------------------------------------------


def _texts(batch: pa.Table) -> tuple[list[int | None], list[bytes], list[int]]:
    """Ids and texts of a document group in one defined order, and that order."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _ordered(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, bytes of a group's texts; those without an id, which come last, count as empty."""
    ids, texts, _ = _texts(batch)
    texts = [t if i is not None else b"" for i, t in zip(ids, texts, strict=True)]
    return np.array([i if i is not None else -1 for i in ids], np.int64), np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(b"".join(texts), np.uint8)


def _table(shape: dict[str, pa.DataType], columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, shape.values(), strict=True)], names=list(shape))


_I, _L, _B = pa.int32(), pa.int64(), pa.binary()
_NOTE = {"dest": _I, "grp": _I, "keys": _B, "counts": _B}
_MAIL = {"grp": _I, "keys": _B, "parts": _B}
#: Segments (kind 0) with their places, texts, sizes and documents, or answers (kind 1): runs of bytes that go.
_PART = {"kind": _I, "dest": _L, "grp": _I, "onward": _L, "firsts": _B, "texts": _B, "sizes": _B, "docs": _B}
_TYPES = {_I: "int", _L: "long", _B: "binary"}


def _ddl(shape: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_TYPES[v]}" for k, v in shape.items())


def _rising(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)


def _runs(a: np.ndarray) -> list[tuple[int, int]]:
    at = _rising(a).tolist()
    return list(zip(at, [*at[1:], len(a)], strict=True))


def _cut(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``raw``, one after the other."""
    return raw[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]


def split_merge(rows: list[tuple]) -> list[tuple]:
    """Merge the segments of one dest. ``rows`` are (grp, onward, firsts, texts, sizes, docs); returns rows
    of ``_PART``: runs of bytes that go, for each group, and, of rows that name where to meet next, the
    segments that still have a window left."""
    sizes = [np.frombuffer(r[4], "<u2").astype(np.int64) for r in rows]
    docs = [np.frombuffer(r[5], np.int64) for r in rows]
    firsts = [np.cumsum(np.frombuffer(_loosen(r[2]), "<i4"), dtype=np.int64) for r in rows]
    size, doc, first = np.concatenate(sizes), np.concatenate(docs), np.concatenate(firsts)
    raw = np.frombuffer(b"".join(_loosen(r[3]) for r in rows), np.uint8)
    least, text = repeated_windows(raw, size, doc)
    gone = least < doc[text]
    window = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
    fresh = np.ones(len(text), bool)
    fresh[1:] = (gone[1:] != gone[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(fresh)
    n = np.diff(np.append(run, len(text)))
    run, n = run[gone[run]], n[gone[run]]
    owner = text[run]
    start = first[owner] + run - window[owner]
    left = np.bincount(text[~gone], minlength=len(size)) > 0
    begin, bound = np.cumsum(size) - size, np.cumsum([0, *map(len, sizes)])
    out = []
    for (grp, onward, *_), lo, hi in zip(rows, bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        a, b = np.searchsorted(owner, [lo, hi])
        if a < b:
            out.append((1, grp, grp, 0, start[a:b].astype("<i4").tobytes(), b"", (n[a:b] + LENGTH - 1).astype("<u2").tobytes(), b""))
        if onward and left[lo:hi].any():
            keep = lo + np.flatnonzero(left[lo:hi])
            out.append(segment_row(onward, grp, 0, first[keep], _cut(raw, begin[keep], size[keep]), size[keep], doc[keep]))
    return out


def segment_row(dest: int, grp: int, onward: int, first: np.ndarray, raw: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple:
    return 0, dest, grp, onward, _squeeze(np.diff(first, prepend=0).astype("<i4").tobytes()), _squeeze(raw.tobytes()), size.astype("<u2").tobytes(), doc.astype("<i8").tobytes()


def substring_spans(docs: DataFrame, group_bytes: int = GROUP_BYTES, carry: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``carry``, text (what is left) and
    row (the other columns of ``docs`` and whether the text was null) of every row."""
    bound_batches(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.agg(F.sum(size)).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    buckets = groups * BUCKETS_A_GROUP
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    columns = [F.pmod(key, F.lit(groups)).cast("int").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")]
    if carry:
        columns.append(F.struct(F.when(F.col("text").isNull(), F.lit(True)).alias("null"), *[F.col(c) for c in docs.columns if c != "text"]).alias("row"))
    rows = docs.select(*columns)
    shift = np.uint64(64 - _KEY_BITS)

    def note(batch: pa.Table) -> pa.Table:
        """The distinct minimizers of a document group, how often they occur and whether in several
        documents, by the bucket that counts them."""
        grp = batch.column("grp")[0].as_py()
        ids, sizes, raw = _ordered(batch)
        first, _, low = segments(raw, sizes)
        doc, keys = ids[np.searchsorted(np.cumsum(sizes), first, "right")], low >> shift
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        at = _rising(keys)
        if not len(at):
            return _table(_NOTE, [[], [], [], []])
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        counts = (np.diff(np.append(at, len(keys))) * 2 + several).astype("<u4")
        keys = keys[at]
        dest = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        keys, counts, dest = keys[order], counts[order], dest[order]
        runs = _runs(dest)
        return _table(_NOTE, [[int(dest[a]) for a, _ in runs], [grp] * len(runs), [_six(keys[a:b]) for a, b in runs], [_squeeze(counts[a:b].tobytes()) for a, b in runs]])

    def count(batch: pa.Table) -> pa.Table:
        """Tells each document group which of its minimizers occur in other documents too, and in how
        many parts they are merged."""
        keys = [_unsix(b) for b in batch.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(_loosen(b), "<u4") for b in batch.column("counts").to_pylist()])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        at = _rising(flat[order])
        n = np.diff(np.append(at, len(flat)))
        again, parts = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        again[order] = np.repeat((n > 1) | (np.maximum.reduceat(counts[order] & 1, at) > 0), n)
        occur = np.add.reduceat((counts[order] >> 1).astype(np.int64), at)
        parts[order] = np.repeat(np.minimum(-(-occur // hot), (1 << _PART_BITS) - 1), n)
        out, lo = ([], []), 0
        for k in keys:
            use = again[lo : lo + len(k)]
            out[0].append(_six(k[use]))
            out[1].append(_squeeze(parts[lo : lo + len(k)][use].astype("<u2").tobytes()))
            lo += len(k)
        return _table(_MAIL, [batch.column("grp").to_pylist(), *out])

    def collect(batch: pa.Table, mail: pa.Table) -> pa.Table:
        """All segments of a document group that can repeat, by bucket, or by minimizer and part."""
        empty = _table(_PART, [[] for _ in _PART])
        if not batch.num_rows or not mail.num_rows:
            return empty
        grp = batch.column("grp")[0].as_py()
        ids, sizes, raw = _ordered(batch)
        again = np.concatenate([_unsix(b) for b in mail.column("keys").to_pylist()])
        parts = np.concatenate([np.frombuffer(_loosen(b), "<u2") for b in mail.column("parts").to_pylist()])
        if not len(again):
            return empty
        order = np.argsort(again)
        again, parts = again[order], parts[order].astype(np.int64)
        first, n, low = segments(raw, sizes)
        keys = low >> shift
        at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        use = np.flatnonzero(again[at] == keys)
        first, n, keys, parts = first[use], n[use], keys[use], parts[at[use]]
        doc = ids[np.searchsorted(np.cumsum(sizes), first, "right")]
        # hot minimizers have negative numbers; a group begins with a part of its own, so that groups spread
        mine = (grp * 40503 + np.arange(len(keys)) // hot) % np.maximum(parts, 1)
        dest = np.where(parts > 1, -1 - ((keys.astype(np.int64) << _PART_BITS) | mine), (keys % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(dest, kind="stable")
        first, size, doc, dest, keys = first[order], n[order] + LENGTH - 1, doc[order], dest[order], keys[order]
        out = [segment_row(int(dest[a]), grp, -1 - int(keys[a]) if dest[a] < 0 else 0, first[a:b], _cut(raw, first[a:b], size[a:b]), size[a:b], doc[a:b]) for a, b in _runs(dest)]
        return _table(_PART, [list(c) for c in zip(*out, strict=True)]) if out else empty

    def merge(batch: pa.Table) -> pa.Table:
        """The answers of one bucket or part; answers that are there already go on as they are."""
        rows = list(zip(*(batch.column(c).to_pylist() for c in _PART), strict=True))
        open_rows = [(r[2], r[3], *r[4:]) for r in rows if r[0] == 0]
        out = [r for r in rows if r[0] == 1] + (split_merge(open_rows) if open_rows else [])
        return _table(_PART, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in _PART])

    def remove(batch: pa.Table, mail: pa.Table) -> pa.Table:
        ids, texts, order_in = _texts(batch)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        start = np.concatenate([np.empty(0, "<i4"), *(np.frombuffer(b, "<i4") for b in mail.column("firsts").to_pylist())]).astype(np.int64)
        n = np.concatenate([np.empty(0, "<u2"), *(np.frombuffer(b, "<u2") for b in mail.column("sizes").to_pylist())]).astype(np.int64)
        width = int(sizes.sum()) + 1
        covered = np.cumsum(np.bincount(start, minlength=width) - np.bincount(start + n, minlength=width))[:-1] > 0
        raw = np.frombuffer(b"".join(texts), np.uint8)
        out: list[list] = [ids, sizes.tolist(), [], [], [], []]
        nulls = batch.column("row").combine_chunks().field("null").take(pa.array(order_in, pa.int64())).to_pylist() if carry else []
        for i, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            own = covered[lo:hi]
            kept = raw[lo:hi][~own].tobytes()
            out[2].append(hi - lo - len(kept))
            out[3].append(int((own[1:] & ~own[:-1]).sum()) + int(len(own) > 0 and bool(own[0])))
            out[4].append(hashlib.sha256(kept).hexdigest())
            if carry:
                out[5].append(None if nulls[i] else _whole_characters(texts[i], own))
        columns = [pa.array(out[0], pa.int64()), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if carry:
            columns += [pa.array(out[5], pa.string()), _nullable(batch.column("row").combine_chunks().take(pa.array(order_in, pa.int64())))]
            names += ["text", "row"]
        return pa.table(columns, names=names)

    notes = rows.groupBy("grp").applyInArrow(_alone(note), _ddl(_NOTE))
    mail = notes.groupBy("dest").applyInArrow(_alone(count), _ddl(_MAIL))
    # one plan, so that the texts are dealt to their groups once: all three passes read that exchange
    parts = rows.groupBy("grp").cogroup(mail.groupBy("grp")).applyInArrow(_with_mail(collect), _ddl(_PART))
    answers = parts.groupBy("dest").applyInArrow(_alone(merge), _ddl(_PART))
    answers = answers.groupBy("dest").applyInArrow(_alone(merge), _ddl(_PART))
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry:
        shape += ", text string, row " + rows.schema["row"].dataType.simpleString()
    return rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_with_mail(remove), shape)


def _nullable(rows: pa.StructArray) -> pa.StructArray:
    """Spark takes back no fields that may not be null."""
    return pa.StructArray.from_arrays(rows.flatten(), fields=[pa.field(f.name, f.type) for f in rows.type])


def _whole_characters(text: bytes, gone: np.ndarray) -> str:
    """What is left of a text. A character of which a part goes, goes: halves never meet."""
    if not gone.any():
        return text.decode("utf-8", "ignore")
    edges = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), len(gone)]
    return "".join(text[a:b].decode("utf-8", "ignore") for a, b in zip(edges, edges[1:], strict=False) if not gone[a])


def _alone(step):
    """A step on one table of a group that leaves its worker trimmed."""

    def run(batch: pa.Table) -> pa.Table:
        out = step(batch)
        trim()
        return out

    return run


def _with_mail(step):
    def run(batch: pa.Table, mail: pa.Table) -> pa.Table:
        out = step(batch, mail)
        trim()
        return out

    return run


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _loosen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return substring_spans(docs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, repeated strings taken out of their texts; the columns stay the same,
    ``n_chars`` (if there is one) counts what is left, and a null text stays null. Where a cut
    leaves a part of a character, that part goes too."""
    text = F.col("text")
    out = substring_spans(docs, carry=True)
    return out.select(*[text if c == "text" else F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
