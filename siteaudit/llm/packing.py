"""Sum-of-squares packing of token sequences.

Documents are tokenised once; a document of more than ``capacity`` ids is cut into pieces of
exactly that length, of which only the first may be shorter. Full pieces are sequences of their
own. All other pieces are dealt to groups of about ``GROUP`` pieces by a row hash, and each
group is packed by the sum-of-squares rule: a piece goes to the open bin for which the squared
counts of open bins per residual gap become smallest, ties to the smallest gap. Pieces come longest
first, and a bin is opened only when no open bin has room, because the aim is few bins; with
``weigh_opening`` a new bin is one more choice of the same sum, which needs more bins. Groups see
lengths only, never texts or ids.

Null text is empty: it has the closing id only. Texts of any length and kind are encoded whole.
Repeated rows are packed as rows of their own. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import bound_batches, materialize, tidy

CAPACITY = 2048
GROUP = 65_536
END_ID = 0


class Encoder:
    """Token ids of the vocabulary ``byte_bpe_50k``. ``tiktoken`` gives the same ids from the same
    vocabulary about four times as fast; ``tokenizers`` encodes what it does not: texts with the
    special token's string, to which it alone gives its own id, and texts whose runs of white space
    are too long for the other's pattern."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if self.SPECIAL not in text:
            try:
                return np.asarray(self.fast.encode_to_numpy(text), "<u4")
            except ValueError:  # the pattern's backtracking is bounded
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def public_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, weigh_opening: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; lengths are 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual gap
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order.tolist():
        n = int(lengths[i])
        # from gap h to gap h - n the sum changes by 2 (count[h - n] - count[h]) + 2, to a full bin by 1 - 2 count[h]
        change = 2 * (count[: capacity + 1 - n] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = np.iinfo(np.int64).max
        j = int(np.argmin(change))
        opening = 2 * count[capacity - n] + 1 if n < capacity else 0
        if count[n + j] > 0 and not (weigh_opening and opening < change[j]):
            b = open_bins[n + j].pop()
            count[n + j] -= 1
            offset, gap = capacity - (n + j), j
        else:
            b, offset, gap = opened, 0, capacity - n
            opened += 1
        bins[i], offsets[i] = b, offset
        if gap:
            open_bins[gap].append(b)
            count[gap] += 1
    return bins, offsets


def pieces(docs: DataFrame, encoder=public_encoder, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, piece, start, length and ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], "<u4")
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(2)):
                ids = np.concatenate((encode(t.as_py() or ""), end))
                for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                    at.append(i)
                    rows.append((p, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, encoder=public_encoder, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = materialize(pieces(docs, encoder, capacity), "pieces")
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rest.count() / group))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["row", "piece"])  # rows come in any order after a shuffle
        bins, offsets = pack(own["length"].to_numpy(), capacity)
        return own.drop(columns="bucket").assign(sequence_id=(int(key[0]) << 36) + bins, offset=offsets)

    packed = dealt.groupBy("bucket").applyInPandas(run, full.schema)
    return full.unionByName(packed)
