"""Language identification with a linear-chain conditional random field over words.

Words (runs of letters, lower-cased) are labelled with one of the learned languages. A word's
features are its hashed character n-grams with word borders (those at a border are its affixes),
the word itself, and the lexicons of the languages that list it among their frequent words.
Weights and transitions are learned together, by gradient ascent on the likelihood of sequences
that switch between languages: spans of labelled documents, joined at random, so that the
transitions say how often text switches. Labels come from forward-backward marginals; a text's
language is the one with the largest share of its words' marginals, and its score is that share.

The model is fitted on at most ``DOCS`` labelled documents of each language, those of smallest hash among the
documents of at most ``TAUGHT`` characters, and on the whole of each. Every text of any length is read whole
when it is labelled.

Text that is null or has no letter is ``und`` with score 0, as is every text if there is nothing
to learn from. Rows with null lang or null doc_id teach nothing. Ties go to the first language in
order. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteaudit.llm.common import bound_batches, tidy

UNKNOWN = "und"
DOCS = 150
TAUGHT = 200_000
SPAN = 10
LEXICON = 300
BUCKETS = 1 << 16
STEPS = 40
MIN_SCORE = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of all words in one array, and where each word's begin."""
    bounded = [f"\x02{w}\x03" for w in vocabulary]
    size = np.fromiter(map(len, bounded), np.int64, len(bounded))
    codes = np.frombuffer("".join(bounded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(bounded)), size)
    last = np.repeat(starts + size, size)
    at = np.arange(len(codes))
    ids, whose = [], []

    def add(positions: np.ndarray, n: int) -> None:
        h = np.full(len(positions), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[positions + i]) * _PRIME
            h ^= h >> np.uint64(29)
        ids.append((h % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(owner[positions])

    for n in (2, 3):
        add(at[at + n <= last], n)
    long = size >= 4
    add(starts[long], 4)
    add((starts + size - 4)[long], 4)
    power = np.ones(int(size.max(initial=1)), np.uint64)
    np.multiply.accumulate(np.full(len(power), _PRIME), out=power)
    if len(codes):
        whole = np.add.reduceat(codes * power[at - np.repeat(starts, size)], starts)
        whole ^= whole >> np.uint64(31)
        ids.append((whole % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(np.arange(len(bounded)))
    ids, whose = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return ids[order], np.searchsorted(whose[order], np.arange(len(bounded)))


def forward_backward(emit: np.ndarray, move: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, t, k) of sequences with emission scores (n, t, k), and the expected
    transitions (k, k) of all of them. Places at or past a sequence's length count nothing."""
    n, t, k = emit.shape
    here = np.ones((n, t), bool) if length is None else np.arange(t) < length[:, None]
    e = np.exp(emit - emit.max(2, keepdims=True))
    e[~here] = 1.0
    m = np.exp(move - move.max())
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((n, t))
    a = e[:, 0]
    for i in range(t):
        if i:
            a = (a @ m) * e[:, i]
        scale[:, i] = a.sum(1)
        a = a / scale[:, i, None]
        alpha[:, i] = a
    b = np.ones((n, k))
    expected = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        beta[:, i] = b
        if i:
            both = here[:, i]
            g = np.where(both[:, None], e[:, i] * b / scale[:, i, None], 0)
            expected += (alpha[:, i - 1].T @ g) * m
            b = np.where(both[:, None], g @ m.T, 1.0)
    marginal = alpha * beta
    return marginal / marginal.sum(2, keepdims=True), expected


class Model:
    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, lexical: np.ndarray, move: np.ndarray) -> None:
        self.langs, self.lexicon, self.weights, self.lexical, self.move = langs, lexicon, weights, lexical, move

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        if not vocabulary:
            return np.empty((0, len(self.langs)))
        ids, starts = features(vocabulary)
        return np.add.reduceat(self.weights[ids], starts) + self.membership(vocabulary) @ self.lexical

    def membership(self, vocabulary: list[str]) -> np.ndarray:
        rows = np.fromiter((self.lexicon.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        out = np.zeros((len(vocabulary), len(self.langs)))
        out[rows >= 0] = self.memberships[rows[rows >= 0]]
        return out

    memberships: np.ndarray

    def label(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, probability) of every word of a text, in its lower case."""
        found = [m for m in _WORD.finditer(text.lower()) if any(map(str.isalpha, m[0]))]
        if not found or not self.langs:
            return []
        marginal, _ = forward_backward(self.emissions([m[0] for m in found])[None], self.move)
        best = marginal[0].argmax(1)
        return [(m.start(), m.end(), self.langs[j], float(marginal[0, i, j])) for i, (m, j) in enumerate(zip(found, best, strict=True))]


def train(spans: list[tuple[str, list[str]]], seed: int = 11) -> Model:
    """Fit a model to (language, words) spans."""
    langs = sorted({lang for lang, ws in spans if ws})
    k, index = len(langs), {lang: i for i, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for lang, ws in spans:
        if ws:
            counts[index[lang]].update(ws)
    listed = [{w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]} for c in counts]
    lexicon = {w: i for i, w in enumerate(sorted(set().union(*listed)))}
    model = Model(langs, lexicon, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros((k, k)))
    model.memberships = np.array([[w in own for own in listed] for w in lexicon], float).reshape(len(lexicon), k)
    if not k:
        return model
    rng = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    by = [[[vocabulary[w] for w in ws] for lang, ws in spans if ws and index[lang] == j] for j in range(k)]
    # four spans a sequence; a language keeps going in about three of four places
    length, sequences = 4 * SPAN, []
    for _ in range(max(64, sum(map(len, by)) // 4)):
        ids, gold, j = [], [], int(rng.integers(k))
        while len(ids) < length:
            own = by[j][int(rng.integers(len(by[j])))]
            ids += own
            gold += [j] * len(own)
            j = j if rng.random() < 0.75 else int(rng.integers(k))
        sequences.append((ids[:length], gold[:length]))
    ids, gold = (np.array(x) for x in zip(*sequences, strict=True))
    feats, starts = features(list(vocabulary))
    sizes = np.diff(np.append(starts, len(feats)))
    member = model.membership(list(vocabulary))
    truth = np.zeros((len(vocabulary), k))
    np.add.at(truth, (ids.ravel(), gold.ravel()), 1)
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [model.weights, model.lexical, model.move]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        emit = np.add.reduceat(model.weights[feats], starts) + member @ model.lexical
        marginal, expected = forward_backward(emit[ids], model.move)
        guess = np.stack([np.bincount(ids.ravel(), marginal[:, :, j].ravel(), len(vocabulary)) for j in range(k)], 1)
        slope = (truth - guess) / len(ids)
        spread = np.repeat(slope, sizes, 0)
        grads = [np.stack([np.bincount(feats, spread[:, j], BUCKETS) for j in range(k)], 1), member.T @ slope, (moved - expected) / len(ids)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g - 1e-5 * p
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = DOCS, longest: int = TAUGHT) -> Model:
    """Fit on the rows that are not held out: ``per_lang`` documents of each language at most, whole, of those
    with no more than ``longest`` characters."""
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).where(F.length("text") <= longest)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    share = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1 << 32, int((1 << 32) * 1.3 * per_lang / n) + 1)).otherwise(share)
    # a language's rows by hash; copies of one row share it, and are cut off here as well
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = rows.select("lang", "text", at.alias("h"), share.alias("share")).where("h < share").withColumn("nth", nth).where(F.col("nth") <= per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                ws = words(t.as_py())
                out.append([" ".join(ws[i : i + SPAN]) for i in range(0, len(ws), SPAN)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.string()))], ["lang", "nth", "spans"])

    spans = []
    for r in chosen.select("lang", "text", "nth").mapInArrow(run, "lang string, nth int, spans array<string>").orderBy("lang", "nth").collect():
        spans += [(r.lang, s.split(" ")) for s in r.spans]
    return train(spans)


def marginal_sums(table: np.ndarray, move: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Sums (n, k) of the marginals of all words of each sequence, by forward-backward. ``ids``
    are rows of ``table``, longest sequence first, so that the sequences still running at a
    place are the first ones."""
    n, t, k = len(ids), len(ids[0]), table.shape[1]
    size = np.array([len(x) for x in ids])
    running = np.searchsorted(-size, -np.arange(t), "left")
    padded = np.zeros((n, t), np.int64)
    padded[np.arange(t) < size[:, None]] = np.concatenate(ids)
    factors = np.exp(np.maximum(table - table.max(1, keepdims=True), -60.0))
    e = np.ascontiguousarray(factors[padded.T].transpose(0, 2, 1))
    m = np.exp(move - move.max())
    back = np.ascontiguousarray(m.T)
    alpha, a = np.empty_like(e), e[0]
    for i in range(t):
        r = running[i]
        if i:
            a = back @ a[:, :r]
            a *= e[i, :, :r]
        if not i & 3:
            a = a / a.sum(0)
        alpha[i, :, :r] = a
    b, sums = np.ones((k, n)), np.zeros((k, n))
    for i in range(t - 1, -1, -1):
        r = running[i]
        own = b[:, :r]
        g = alpha[i, :, :r] * own
        g /= g.sum(0)
        sums[:, :r] += g
        if i:
            own = m @ (own * e[i, :, :r])
            b[:, :r] = own if i & 3 else own / own.sum(0)
    return sums.T


#: Words whose scores a worker keeps; a fuller store is begun anew.
KEPT_WORDS = 150_000


class _Store(dict):
    """Numbers for words; -1 for those without a letter. New ones are listed in ``fresh``."""

    def __init__(self) -> None:
        self.n, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        if word.isascii() or any(map(str.isalpha, word)):
            self.fresh.append(word)
            at = self.n
            self.n += 1
        else:
            at = -1
        self[word] = at
        return at


class Labeller:
    """Shares of the languages in whole texts, for many texts at a time."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, _Store()
        self.table = np.empty((1 << 14, len(model.langs)))

    def ids(self, text: str | None) -> np.ndarray:
        found = _WORD.findall((text or "").lower())
        ids = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        return ids if not len(ids) or ids.min() >= 0 else ids[ids >= 0]

    def learn(self) -> None:
        """Scores for the words seen since the last time."""
        fresh, base = self.known.fresh, self.known.n - len(self.known.fresh)
        while len(self.table) < self.known.n:
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.table[base + i : base + i + len(part)] = self.model.emissions(part)
        self.known.fresh = []

    def shares(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.model.langs)))
        if not self.model.langs:
            return out
        if len(self.known) > KEPT_WORDS:
            self.known = _Store()
        ids = [self.ids(t) for t in texts]
        self.learn()
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
        while order:
            n = max(1, min(512, 400_000 // len(ids[order[0]])))
            own, order = order[:n], order[n:]
            local, small = np.unique(np.concatenate([ids[i] for i in own]), return_inverse=True)
            sizes = [len(ids[i]) for i in own]
            parts = np.split(small, np.cumsum(sizes)[:-1])
            out[own] = marginal_sums(self.table[local], self.model.move, parts) / np.array(sizes)[:, None]
        return out


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the shares of all languages for every row."""
    bound_batches(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets and lexicons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        langs = shared.value.langs
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                share = labeller.shares(part.column(2).to_pylist())
                best = share.argmax(1) if langs else np.zeros(len(share), int)
                score = share.max(1) if langs else np.zeros(len(share))
                names = [langs[j] if s > 0 else UNKNOWN for j, s in zip(best, score, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array([dict(zip(langs, x, strict=True)) for x in share.tolist()], pa.map_(pa.string(), pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, shares map<string,double>")


def drop_unknown(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``min_score`` or more; where
    nothing could be learned, all rows."""
    bound_batches(docs.sparkSession)
    model = model or fit(docs)
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                share = labeller.shares(part.column(at).to_pylist())
                yield part.filter(pa.array(share.max(1) >= min_score))

    return docs.mapInArrow(tidy(run), docs.schema)
