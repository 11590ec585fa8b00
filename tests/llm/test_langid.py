"""Language identification against a plain version of the same model, and odd columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import langid
from tests.conftest import SF


def plain(model: langid.Model, text: str | None) -> tuple[str, float]:
    """The language of a text, word by word: emissions summed one by one, forward and backward in turn."""
    k, ws = len(model.langs), langid.words(text or "")
    if not ws or not k:
        return langid.UNKNOWN, 0.0
    emit = []
    for w in ws:
        feats, _ = langid.features([w])
        e = model.weights[feats].sum(0)
        if w in model.lexicon:
            e = e + model.memberships[model.lexicon[w]] @ model.lexical
        emit.append([math.exp(x) for x in e - e.max()])
    move = np.exp(model.move).tolist()

    def scaled(row):
        total = sum(row)
        return [x / total for x in row]

    ahead = [scaled(emit[0])]
    for e in emit[1:]:
        ahead.append(scaled([e[j] * sum(ahead[-1][i] * move[i][j] for i in range(k)) for j in range(k)]))
    behind, shares = [1.0] * k, [0.0] * k
    for t in range(len(ws) - 1, -1, -1):
        own = scaled([a * b for a, b in zip(ahead[t], behind, strict=True)])
        shares = [s + o for s, o in zip(shares, own, strict=True)]
        behind = scaled([sum(move[i][j] * emit[t][j] * behind[j] for j in range(k)) for i in range(k)])
    best = max(range(k), key=lambda j: shares[j])
    return model.langs[best], shares[best] / len(ws)


def test_whole_texts_agree_with_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        lang, score = plain(model, r.text)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-6), r.doc_id


def test_fit_sees_the_ends_of_texts(spark):
    """A language's words that stand behind thousands of others are learned."""
    rows = [(i, " ".join(["lorem"] * 4000 + ["zyx", "wvu", "tsr"] * 400), "xx") for i in range(20)] + [(100 + i, " ".join(["lorem"] * 4000 + ["abc", "def", "ghi"] * 400), "yy") for i in range(20)]
    docs = spark.createDataFrame([*rows, (999, "zyx wvu tsr zyx wvu", None), (998, "abc def ghi abc", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs).where("doc_id > 900").collect()}
    assert got == {999: "xx", 998: "yy"}


def test_one_hot_document_leaves_the_other_languages(spark):
    rows = [(7, "uno dos tres cuatro cinco", "es")] * 3000 + [(i, f"one two three four {'five ' * (i % 5)}", "en") for i in range(20, 60)]
    docs = spark.createDataFrame([*rows, (999, "two three four", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs).where("doc_id = 999").first().lang_pred == "en"


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = docs.withColumns({c: F.lit("x") for c in ("h", "nth", "share", "spans", "lang_pred", "score", "held_out", "row")})
    one, two = (sorted(tuple(r) for r in langid.predict(d).select("doc_id", "held_out", "lang_pred", "score").collect()) for d in (docs, more))
    assert one == two
