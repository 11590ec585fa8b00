"""Byte-level BPE: texts to token ids and back.

A rank file (base64 token and rank a line) becomes a model of the ``tokenizers`` library: bytes are
written as the characters of the byte table, and each token's merge is found by merging its own
bytes by rank until two parts are left. ``encode`` sends texts through it in Arrow batches, each
match of the split pattern separately, and gives ids and, if asked, the first and last character of
each token; a token that holds part of a character spans the whole of it. ``decode`` reverses the
byte table. Bytes that are no text on their own, as of a character split between tokens, are joined
before they are read as UTF-8; ``token_texts`` gives each token the characters that it completes.

Texts are encoded whole. Of one longer than ``LONG`` characters, parts go to the library one after
another: it is parted only before a space after a letter or digit, where every match of the pattern
ends anyway. Null or empty text has no tokens. Special tokens' strings are ordinary text. Repeated rows
stay rows. An empty table gives no rows. Other columns, whatever their names, are ignored by
``encode`` and kept by ``decode``. Null ids, and ids that are no rank, decode to null.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.common import bound_batches, tidy

LONG = 1 << 18
_SAFE = re.compile(r"[^\W_](?= )")


@lru_cache(maxsize=1)
def byte_table() -> tuple[str, ...]:
    """The character of every byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return tuple(chr(b if b in own else next(others)) for b in range(256))


def public_ranks() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


def public_pattern() -> str:
    import public_tokenizers as P

    return P.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that are left before ``token`` itself is merged."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:], strict=False)]
        i = found.index(min(found))
        if found[i] >= ranks[token]:
            raise ValueError(f"no merges lead to token {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def model(ranks_path: str, pattern: str) -> str:
    """The serialised tokenizer. It is built on the driver, so executors need no file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(ranks_path), byte_table()
    written = lambda token: "".join(chars[b] for b in token)
    order = sorted((t for t in ranks if len(t) > 1), key=ranks.get)
    merges = [tuple(map(written, last_merge(t, ranks))) for t in order]
    made = Tokenizer(models.BPE(vocab={written(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


@lru_cache(maxsize=2)
def _loaded(serialised: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(serialised)


@lru_cache(maxsize=2)
def _token_bytes(serialised: str) -> dict[int, bytes]:
    byte = {c: b for b, c in enumerate(byte_table())}
    return {i: bytes(byte[c] for c in t) for t, i in _loaded(serialised).get_vocab().items()}


def parts(text: str, long: int = LONG) -> list[str]:
    """``text`` in parts of about ``long`` characters, parted where no match of the pattern goes on."""
    out, at = [], 0
    while len(text) - at > long and (m := _SAFE.search(text, at + long)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at else [text]


def _encoded(tokenizer, text: str, long: int, offsets: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and (first, behind last) character of each token."""
    ids, spans, base = [], [], 0
    run = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
    for part in parts(text, long):
        got = run([part], add_special_tokens=False)[0]
        ids.append(np.array(got.ids, "<u4"))
        if offsets:
            spans.append(np.array(got.offsets, np.int32).reshape(-1, 2) + base)
            base += len(part)
    return np.concatenate(ids), np.concatenate(spans) if offsets else np.empty((0, 2), np.int32)


def _lists(rows: list[np.ndarray], of: np.dtype, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype(of) if rows else np.empty(0, of)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None, offsets: bool = False, packed: bool = False, long: int = LONG) -> DataFrame:
    """``key`` and ``ids`` of every row: an array, or ``packed`` as little-endian unsigned 32-bit numbers
    in one binary value. ``offsets`` adds ``starts`` and ``ends``, in characters of the text."""
    serialised = model(ranks or public_ranks(), pattern or public_pattern())
    bound_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    fields = [T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")] if offsets else []
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(serialised)
        for b in batches:
            got = [_encoded(tokenizer, t.as_py() or "", long, offsets) for t in b.column(1)]
            ids = [g[0] for g in got]
            cols = [b.column(0), pa.array([i.tobytes() for i in ids], pa.binary()) if packed else _lists(ids, np.int32, pa.int32())]
            if offsets:
                cols += [_lists([g[1][:, side] for g in got], np.int32, pa.int32()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(tidy(run), T.StructType(fields)).withColumnRenamed("key", key)


def decode(tokens: DataFrame, ids: str = "ids", to: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids (an array or ``packed``) in a new column ``to``. Read them as
    text with ``as_text``."""
    if to in tokens.columns:
        raise ValueError(f"there is a column {to} already")
    serialised = model(ranks or public_ranks(), pattern or public_pattern())
    bound_batches(tokens.sparkSession)
    names = [*tokens.columns, to]
    at, packed = names.index(ids), isinstance(tokens.schema[ids].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _token_bytes(serialised)

        def joined(value: pa.Scalar) -> bytes | None:
            if not value.is_valid:
                return None
            row = np.frombuffer(value.as_buffer(), "<u4").tolist() if packed else value.as_py()
            try:
                return b"".join(map(known.__getitem__, row))
            except KeyError:
                return None

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([joined(v) for v in b.column(at)], pa.binary())], names)

    return tokens.mapInArrow(tidy(run), T.StructType([*tokens.schema.fields, T.StructField(to, T.BinaryType())]))


def as_text(decoded: Column | str) -> Column:
    """Bytes as text; what is no UTF-8, as the half of a character at a cut, becomes U+FFFD."""

    @F.pandas_udf("string")
    def read(s):
        return s.map(lambda v: None if v is None else bytes(v).decode("utf-8", "replace"))

    return read(decoded)


def token_texts(ids: list[int], serialised: str) -> list[str]:
    """The characters that each token completes; those of a split character go to its last token."""
    known, reader = _token_bytes(serialised), codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(known[i]) for i in ids]
    if out:
        out[-1] += reader.decode(b"", final=True)
    return out


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text of ``docs``."""
    both = decode(encode(docs, packed=True))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
