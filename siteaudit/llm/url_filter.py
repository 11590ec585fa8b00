"""URL rules in a sorted digest array.

The rules (host and path prefix) are written once as one file: their 64-bit xxhash keys in
ascending order, offsets and the full strings. Executors get the file through Spark's own file
distribution from the shared folder, memory-map it, probe it with a vectorised binary search
and confirm each hit against the stored string, so colliding digests never decide.

A rule fits its host and all its subdomains if the path begins with the rule's path; of all
that fit the longest rule (host and path together) wins, then the one with the longer host.
A url without a fitting rule gets the default verdict. Null urls and urls without ``://`` have
an empty host and path, fit no rule and are allowed. Repeated rows give repeated results; other
columns are ignored. Repeated rules are one rule; the same rule with two verdicts is an error.
"""

from __future__ import annotations

import hashlib
import mmap
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm.common import checkpoint_root

#: (verdict, host/path) as the query's contract gives them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
_MAGIC = b"SDIGEST1"


def pack_rules(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file: magic, counts, path lengths, keys, offsets, verdicts, strings."""
    known: dict[str, str] = {}
    for verdict, rule in rules:
        if "/" not in rule or known.setdefault(rule, verdict) != verdict:
            raise ValueError(f"not a rule, or one with two verdicts: {rule!r}")
    entries = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "block") for r, v in known.items())
    lengths = sorted({len(r.partition("/")[2]) + 1 for r in known})
    labels = max((r.partition("/")[0].count(".") + 1 for r in known), default=0)
    offsets = np.cumsum([0, *(len(r) for _, r, _ in entries)])
    head = np.array([len(entries), len(lengths), labels], "<i8")
    return _MAGIC + b"".join(x.tobytes() for x in (head, np.array(lengths, "<i8"), np.array([k for k, _, _ in entries], "<u8"), offsets.astype("<i8"), np.array([b for _, _, b in entries], np.uint8))) + b"".join(r for _, r, _ in entries)


class DigestArray:
    """A packed rule file, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError("not a digest array")
        n, m, self.labels = np.frombuffer(self.map, "<i8", 3, 8).tolist()
        at = 32
        self.lengths = np.frombuffer(self.map, "<i8", m, at).tolist()
        self.keys = np.frombuffer(self.map, "<u8", n, at := at + 8 * m)
        self.offsets = np.frombuffer(self.map, "<i8", n + 1, at := at + 8 * n)
        self.blocked = np.frombuffer(self.map, np.uint8, n, at := at + 8 * (n + 1))
        self.strings = at + n

    def string(self, i: int) -> bytes:
        return self.map[self.strings + int(self.offsets[i]) : self.strings + int(self.offsets[i + 1])]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The index of each candidate's rule, -1 where there is none."""
        found = np.full(len(candidates), -1, np.int64)
        if not candidates or not len(self.keys):
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(low < high).tolist():
            found[i] = next((j for j in range(low[i], high[i]) if self.string(j) == candidates[i]), -1)
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Winning rule and verdict of each url."""
        candidates: list[bytes] = []
        owner: list[int] = []
        rank: list[tuple[int, int]] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            parts = host.rsplit(".", self.labels)
            for k in range(1, min(len(parts), self.labels) + 1):
                suffix = ".".join(parts[-k:])
                if k == len(parts):
                    suffix = host
                for n in self.lengths:
                    if n <= len(path):
                        candidates.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
                        owner.append(i)
                        rank.append((len(suffix) + n, len(suffix)))
        rules: list[str | None] = [None] * len(hosts)
        verdicts = [DEFAULT] * len(hosts)
        best: list[tuple[int, int]] = [(0, 0)] * len(hosts)
        found = self.probe(candidates)
        for c in np.flatnonzero(found >= 0).tolist():
            i, j = owner[c], int(found[c])
            if rank[c] > best[i]:
                best[i], rules[i], verdicts[i] = rank[c], candidates[c].decode(), "block" if self.blocked[j] else "allow"
        return rules, verdicts


def publish(spark: SparkSession, data: bytes) -> str:
    """Put the packed rules into the shared folder and hand them to all executors, present and
    later ones. The name holds the content's digest, so equal rules are published once."""
    name = f"siteaudit-rules-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        # under another name first: a write that breaks off leaves no file of this name
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(part, path):  # another driver was first: its file has the same content
            fs.delete(part, False)
    spark.sparkContext.addFile(path.toString())
    return name


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    name = publish(pages.sparkSession, pack_rules(rules))
    after = F.when(F.instr("url", "://") > 0, F.substring_index(F.expr("substr(url, instr(url, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    bare = F.substring_index(F.coalesce(after, F.lit("")), "?", 1)
    slash = F.instr(bare, "/")
    host = F.when(slash > 0, F.substring_index(bare, "/", 1)).otherwise(bare)
    path = F.when(slash > 0, bare.substr(slash, F.length(bare))).otherwise(F.lit(""))
    split = pages.select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            rule, verdict = array.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
