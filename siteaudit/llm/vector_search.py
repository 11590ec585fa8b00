"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of ``books`` codebooks of full dimension. The books
are fitted one after the other to the residuals of a bounded sample (``SAMPLE`` rows of smallest
hash); encoding keeps the best ``beam`` partial sums at each book. The norm of the decoded vector is
stored beside the codes. A query makes one table of inner products with all words; a row's score
is the sum of the entries its codes name (with ``measure`` l2 less half the stored norm). The best
rows of each slice by that score are then reranked with the original vectors in double precision,
and the best of all slices remain. Slices have one size, so recall does not fall as rows grow.

Every row is indexed and keeps a random number that deals it to a chunk of about ``CHUNK`` rows;
queries are dealt to blocks of about ``BLOCK``. Each block meets each chunk in one task, which keeps
its best over the chunk's slices, so neither queries nor rows pass the driver (the sample alone
does) and the plan has one size. Vectors of floats are shuffled as floats. A row is sent once for each
block and a query once for each chunk, so both are as large as a task's memory allows; where that
would be fewer tasks than cores, chunks are smaller, down to a slice. The search is exhaustive over the
codes: its work is queries times rows.

Vectors that are null, zero, of another length than the first book's, or hold null or non-finite
components take no part, neither as query nor as candidate. Repeated ids are rows of their own; a
query never meets a row of its own id. Ties go to the smaller vec_id. An empty table gives no rows. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteaudit.llm.common import materialize

BOOKS = 16
WORDS = 256
BEAM = 4
SAMPLE = 8192
#: Rows that compete for one shortlist; of so many, each query reranks ``SHORTLIST``.
SLICE = 8192
SHORTLIST = 320
#: Rows and queries that meet in one task, at most: about 70 MB of either.
CHUNK, BLOCK = 131_072, 65_536
ROUNDS = 8


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dim): k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    left, out = sample.astype(np.float32), []
    for _ in range(books):
        own = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(ROUNDS):
            near = np.argmax(left @ own.T - 0.5 * (own * own).sum(1), 1)
            sums = np.zeros_like(own)
            np.add.at(sums, near, left)
            n = np.bincount(near, minlength=words)
            own = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], left[rng.integers(0, len(left), words)])
        left = left - own[np.argmax(left @ own.T - 0.5 * (own * own).sum(1), 1)]
        out.append(own)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) found by beam search, and the norms of the decoded vectors."""
    m, k, dim = books.shape
    codes_out, norms_out = np.empty((len(vectors), m), np.uint8), np.empty(len(vectors), np.float32)
    for lo in range(0, len(vectors), 1024):
        x = vectors[lo : lo + 1024].astype(np.float32)
        left, codes = x[:, None, :], np.empty((len(x), 1, 0), np.uint8)
        for book in books:
            # squared error after each word, less the part that no choice changes
            error = (left * left).sum(2)[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(*left.shape[:2], k) + (book * book).sum(1)
            flat = error.reshape(len(x), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            state, word = best // k, best % k
            left = np.take_along_axis(left, state[:, :, None], 1) - book[word]
            codes = np.concatenate((np.take_along_axis(codes, state[:, :, None], 1), word[:, :, None].astype(np.uint8)), 2)
        final = np.argmin((left * left).sum(2), 1)
        rows = np.arange(len(x))
        codes_out[lo : lo + 1024] = codes[rows, final]
        decoded = x - left[rows, final]
        norms_out[lo : lo + 1024] = (decoded * decoded).sum(1)
    return codes_out, norms_out


def table_scores(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, measure: str = "ip") -> np.ndarray:
    """(queries, rows) scores, summed from each query's tables of inner products with the words."""
    scores = np.zeros((len(queries), len(codes)), np.float32)
    for j, book in enumerate(books):
        scores += (queries.astype(np.float32) @ book.T)[:, codes[:, j]]
    return scores - 0.5 * norms if measure == "l2" else scores


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, shortlist: int, measure: str = "ip"):
    """(query position, id, exact score) of the best k rows of each query. Equal vectors compete
    as one, so however many copies there are, they take one place of the shortlist; each then
    stands for its k smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # no negative zeros
    _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    # groups in order of their smallest ids, which breaks ties of approximate scores
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    group, first = place[group.ravel()], np.sort(first)
    members = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[members], np.arange(len(first) + 1))
    lowest, highest = ids[first], ids[members[starts[1:] - 1]]
    vectors, codes, norms = vectors[first], codes[order[first]], norms[order[first]]
    n = min(shortlist, len(first))
    qs, vs, ss = [], [], []
    for lo in range(0, len(queries), 256):
        q, own = queries[lo : lo + 256], query_ids[lo : lo + 256]
        scores = table_scores(q, codes, norms, books, measure)
        scores[(own[:, None] == lowest) & (own[:, None] == highest)] = -np.inf
        least = -np.partition(-scores, n - 1, 1)[:, n - 1]
        for i in range(len(q)):
            above = np.flatnonzero(scores[i] > least[i])
            short = np.concatenate((above, np.flatnonzero(scores[i] == least[i])[: n - len(above)]))
            short = short[scores[i, short] > -np.inf]
            # summed row by row, so that equal vectors of other slices have equal scores
            exact = (vectors[short] * q[i]).sum(1) if measure == "ip" else -((vectors[short] - q[i]) ** 2).sum(1)
            if len(short) > k:
                near = exact >= -np.partition(-exact, k - 1)[k - 1]
                short, exact = short[near], exact[near]
            found, score = [ids[:0]], [exact[:0]]
            for g, e in zip(short, exact, strict=True):
                rows = ids[members[starts[g] : starts[g + 1]]]
                a, z = np.searchsorted(rows, own[i]), np.searchsorted(rows, own[i], "right")
                rows = np.concatenate((rows[: min(a, k)], rows[z : z + max(0, k - a)]))
                found.append(rows)
                score.append(np.full(len(rows), e))
            found, score = np.concatenate(found), np.concatenate(score)
            top = np.lexsort((found, -score))[:k]
            qs.append(np.full(len(top), lo + i))
            vs.append(found[top])
            ss.append(score[top])
    return np.concatenate(qs), np.concatenate(vs), np.concatenate(ss)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles, or floats as they are) of the rows that take part."""
    floats = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    vec = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    fine = F.size(vec) > 0
    fine &= ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def bounded_sample(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """About ``n`` of ``total`` vectors, those of smallest hash; what reaches the driver does not grow
    with rows or tasks."""
    share = min(1.0, 1.25 * n / max(1, total))
    mixed = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    some = rows.where(mixed <= int(share * (1 << 30))).orderBy(mixed, "vec_id").limit(n).select("embedding")
    found = [np.asarray(v) for v in some.toPandas()["embedding"]]
    return np.stack([v for v in found if len(v) == len(found[0])]) if found else np.empty((0, 0))


def dealt(rows: int, queries: int, cells: int, chunk: int = CHUNK, block: int = BLOCK) -> tuple[int, int]:
    """Into how many chunks and blocks to deal rows and queries, so that about ``cells`` tasks have work."""
    blocks = max(1, -(-queries // block))
    return max(1, -(-rows // chunk), min(-(-rows // SLICE), -(-cells // blocks))), blocks


def search(rows: DataFrame, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST, sample: int = SAMPLE, measure: str = "ip", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each query row. The score is the inner
    product, or with ``measure`` l2 the squared distance, negative."""
    rows, queries = usable(rows), usable(queries)
    spark = rows.sparkSession
    taught = bounded_sample(rows, sample, rows.count())
    if not len(taught):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = taught.shape[1]
    books = spark.sparkContext.broadcast(fit(taught))
    rows, queries = rows.where(F.size("embedding") == dim), queries.where(F.size("embedding") == dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, norms = encode(matrix(b.column(1)), books.value)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, packed, pa.array(norms)], ["vec_id", "embedding", "spread", "codes", "norm"])

    # the random numbers are written, so that a task that runs again deals alike
    spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
    indexed = materialize(rows.select("vec_id", "embedding", spread.alias("spread")).mapInArrow(index, f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, spread long, codes binary, norm float"), "codes")
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", spread.alias("spread")), "queries")
    chunks, blocks = dealt(indexed.count(), asked.count(), 4 * spark.sparkContext.defaultParallelism, chunk, block)
    shape = "row long, query_id long, vec_id long, score double"

    def meet(own: pa.Table, held: pa.Table) -> pa.Table:
        names = ["row", "query_id", "vec_id", "score"]
        if not own.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        own, held = own.combine_chunks(), held.sort_by([("vec_id", "ascending"), ("spread", "ascending")]).combine_chunks()
        row, qid, q = own.column("row").to_numpy(), own.column("vec_id").to_numpy(), matrix(own.column("embedding").combine_chunks())
        # a slice takes every so manieth row, so that slices are alike in size and kind
        slices = max(1, -(-held.num_rows // SLICE))
        at, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for i in range(slices):
            part = held.take(pa.array(np.arange(i, held.num_rows, slices))).combine_chunks()
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            found = best_of(q, qid, matrix(part.column("embedding").combine_chunks()), part.column("vec_id").to_numpy(), codes, part.column("norm").to_numpy(), books.value, k, shortlist, measure)
            at, ids, scores = (np.concatenate(c) for c in zip((at, ids, scores), found, strict=True))
            order = np.lexsort((ids, -scores, at))
            at, ids, scores = at[order], ids[order], scores[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, ids, scores = at[best], ids[best], scores[best]
        return pa.table([pa.array(row[at]), pa.array(qid[at]), pa.array(ids), pa.array(scores)], names=names)

    def cells(table: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return table.withColumn(own, F.pmod("spread", F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    left, right = cells(asked, "block", blocks, "chunk", chunks), cells(indexed, "chunk", chunks, "block", blocks)
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(meet, shape)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
