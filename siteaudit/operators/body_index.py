"""Search over page bodies through an index of trigrams.

``build`` writes lists of ids for the distinct trigrams of the bodies, sorted by trigram in range partitions, and how
many bodies have each. A task turns round the bodies that it reads, so a common trigram is as many short lists. A search asks for the rarest trigrams that every hit must have, opens only
the bodies that have all of them, and looks there for the needle itself; so hits are those of a full
scan. Trigrams are of ASCII characters, upper case as lower case, as search takes them to be the same; what has
no three of them in a row that every hit must have (short needles, other scripts, alternatives at the top of a
pattern) is looked for in all bodies. So are needles whose rarest trigram a large share of the bodies has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.operators.inspector import pattern, snippet

#: How many trigrams a search asks for, and the share of bodies from which on an index is no help.
ASKED, SHARE = 4, 0.3
#: Trigrams of bodies that a task turns round at a time, some 40 MB.
HELD = 2_000_000
#: Other characters that a search without regard to case takes for ASCII letters.
_ALSO = str.maketrans({"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"})


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers of 21 bits."""
    # lower() of bytes is that of ASCII letters
    codes = np.frombuffer(text.translate(_ALSO).encode("latin-1", "replace").lower(), np.uint8).astype(np.int32)
    if len(codes) < 3:
        return np.empty(0, np.int32)
    ascii_ = (codes > 0) & (codes < 128) & (codes != ord("?"))  # "?" also stands for what is not Latin-1
    whole = ascii_[:-2] & ascii_[1:-1] & ascii_[2:]
    return np.unique(((codes[:-2] << 14) | (codes[1:-1] << 7) | codes[2:])[whole])


def literals(regex: str) -> list[str]:
    """Runs of plain characters that every match of a pattern has; none if that can't be told."""
    runs, run, at, depth = [], "", 0, 0
    optional = False

    def ended(text: str) -> str:
        if text:
            runs.append(text)
        return ""

    while at < len(regex):
        c = regex[at]
        step, plain = 1, None
        if c == "\\":
            following = regex[at + 1 : at + 2]
            step, plain = 2, following if following and not following.isalnum() else None
            if following in tuple("xuUN0123456789"):
                return []  # numbers and names of characters
        elif c == "[":
            end = at + 1 + (regex[at + 1 : at + 2] == "^")
            end += regex[end : end + 1] == "]"
            while end < len(regex) and regex[end] != "]":
                end += 2 if regex[end] == "\\" else 1
            step = end + 1 - at
        elif c == "(":
            if regex[at + 1 : at + 2] == "?" and regex[at + 2 : at + 3] not in (":", "=", "!", "<", "P"):
                return []  # flags and conditions
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return []
        elif c in "*?{" and depth == 0:
            run, optional = run[:-1], True
        elif c not in ".^$+|*?{}":
            plain = c
        if plain is not None and depth == 0:
            run += plain
        else:
            run = ended(run)
            if optional and c == "{":
                close = regex.find("}", at)
                step = close + 1 - at if close >= 0 else 1
            optional = False
        at += step
    ended(run)
    return runs


def required(needle: str, is_regex: bool = False) -> list[int]:
    """Trigrams that a body with a hit has."""
    parts = literals(needle) if is_regex else [needle]
    return sorted({int(g) for p in parts for g in grams(p)})


def lists(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """The trigrams of some bodies turned round: rows of a trigram, the first id and all ids' distances from it."""
    gram = np.concatenate([g for g, _ in held])
    ids = np.concatenate([np.full(len(g), i, np.int64) for g, i in held])
    order = np.lexsort((ids, gram))
    gram, ids = gram[order], ids[order]
    new = np.concatenate(([True], gram[1:] != gram[:-1]))
    again = np.concatenate(([False], (gram[1:] == gram[:-1]) & (ids[1:] == ids[:-1])))
    gram, ids, new = gram[~again], ids[~again], new[~again]
    # ids far apart go to rows of their own: by ranges of 2^31
    block = ids >> 31
    new |= np.concatenate(([True], block[1:] != block[:-1]))
    starts = np.flatnonzero(new)
    offsets = ids - np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
    whole = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(offsets, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(gram[starts], pa.int32()), pa.array(ids[starts]), whole], ["gram", "first", "offsets"])


@dataclass(frozen=True)
class BodyIndex:
    """A written index. ``bodies`` gives (id, text) again, for the bodies that a search opens."""

    spark: SparkSession
    path: str
    bodies: DataFrame

    def candidates(self, needle: str, is_regex: bool = False) -> DataFrame | None:
        """Ids of the bodies that a hit can be in; None stands for all of them."""
        need = required(needle, is_regex)
        if not need:
            return None
        total = self.spark.read.parquet(f"{self.path}/total").first()[0]
        known = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(need)).collect()}
        rare = sorted(need, key=lambda g: (known.get(g, 0), g))[:ASKED]
        if known.get(rare[0], 0) > SHARE * total:
            return None
        held = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(rare))
        each = held.select("gram", F.explode(F.transform("offsets", lambda o: F.col("first") + o)).alias("id"))
        return each.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("id")

    def search(self, needle: str, is_regex: bool = False) -> DataFrame:
        """(id, matches, snippet) of every body with a hit. An invalid pattern matches nothing."""
        found, shape = pattern(needle, is_regex), "id long, matches int, snippet string"
        if found is None:
            return self.spark.createDataFrame([], shape)
        some = self.candidates(needle, is_regex)
        opened = self.bodies if some is None else self.bodies.join(some, "id", "left_semi")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for i, text in zip(part["id"], part["text"], strict=True):
                    n, first = 0, None
                    for hit in found.finditer(text or ""):
                        n, first = n + 1, first or hit.span()
                    if n:
                        rows.append((i, n, snippet(text, *first)))
                yield pd.DataFrame(rows, columns=["id", "matches", "snippet"])

        return opened.select("id", "text").mapInPandas(run, shape)


def build(bodies: DataFrame, path: str, key: Column | str = "id", text: Column | str = "text") -> BodyIndex:
    """Write the index of (id, text) and open it. Rows without an id or a text have no hits."""
    spark = bodies.sparkSession
    own = bodies.select((F.col(key) if isinstance(key, str) else key).cast("long").alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = grams(t.as_py())
                held.append((found, i))
                size += len(found)
                if size >= HELD:
                    yield lists(held)
                    held, size = [], 0
        if size:
            yield lists(held)

    shape = "gram int, first long, offsets array<int>"
    postings = own.mapInArrow(run, shape).repartitionByRange("gram", "first").sortWithinPartitions("gram", "first")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.schema(shape).parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("offsets")).alias("n")).write.mode("overwrite").parquet(f"{path}/grams")
    own.agg(F.countDistinct("id").alias("n")).write.mode("overwrite").parquet(f"{path}/total")
    return BodyIndex(spark, path, own)
