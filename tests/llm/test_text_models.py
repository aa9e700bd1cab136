import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language as L
from millrace.llm import toxicity as T

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("run", [32, 3])
def test_forward_sums_all_segmentations(monkeypatch, run):
    pieces = [b"a", b"b", b" ", b"ab", b" a", b"ba", b" ab"]
    index = {p: i for i, p in enumerate(pieces)}
    probs = np.vstack([np.random.default_rng(0).random((len(pieces), 2)), np.zeros(2)])
    monkeypatch.setattr(L, "RUN", run)
    words = [b" abab", b" b", b" aab"]
    use = L.Lattice(words, index).expected(L.scaled(pieces, probs), np.ones((3, 2)))
    due = np.zeros_like(use)
    for k, word in enumerate(words):
        want, used = np.zeros(2), np.zeros_like(use)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(ends)]
            if all(p in index for p in parts):
                p = np.prod([probs[index[x]] for x in parts], axis=0)
                want += p
                for x in parts:
                    used[index[x]] += p
        due += used / want
        assert np.allclose(np.exp(L.Lattice(words, index).forward(L.scaled(pieces, probs))[k]), want)
    assert np.allclose(use, due)


def test_language_held_out(spark):
    out = L.op6_unigram(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = spark.createDataFrame([(None, None, "en"), (1, "", None), (2, "12 |", "xx"), (3, "a" * 5000 + " the of and", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(odd, docs).collect()}
    assert got[None] == got[1] == got[2] == ("und", 0.0) and got[3][0] in ("de", "en", "es", "fr") and math.isfinite(got[3][1])
    assert {r.lang_pred for r in L.identify(odd.where("lang IS NULL"), odd.limit(0)).collect()} == {"und"}
    assert L.identify(odd.limit(0), docs).count() == 0


@pytest.fixture(scope="module")
def scorer(spark):
    return L.Scorer(*L.train(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize("text", ["\U00012000" * 12, "\u1200\u1208\u1210" * 10, "\ua984\ua985" * 15, "x" * 5000, "five words of english text " + "\U00012000" * 12])
def test_unseen_scripts_have_scores(scorer, text):
    lang, score = next(scorer.scores([text]))
    assert lang in ("de", "en", "es", "fr") and 0 <= score <= 1


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "\u00bd \u2461 \u2167 12 _", "en"), (2, "words of a text", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs, docs).orderBy("doc_id").collect()][0] == "und"
    assert [r.doc_id for r in L.accept(docs).collect()] == [2]


def test_long_texts_teach_their_language(spark):
    rows = [(i, " ".join(f"{a}{b}{c}" for c in "xyzuvw" for b in "aeiou" for a in "bcdfgh") * 60, "xx") for i in range(12)]
    rows += [(100 + i, "plain words of another tongue altogether", "yy") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(docs)[0] == ["xx", "yy"]


def test_machine_learns_interactions():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = [f"w{x}" for x in rng.integers(0, 40, 6)]
        bags.append(np.array(sorted({T.term(x) for x in noise + ["insult"] * a + ["group"] * b}), dtype=np.int64))
        labels.append(a and b)
    m = T.fit(bags, np.array(labels, dtype=float), epochs=20)
    low = max(m.score("insult w1 w2"), m.score("group w1 w2"), m.score("w1 w2"))
    assert m.score("insult group w1 w2") > 0.5 > low


def test_machine_learns_what_only_pairs_tell():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = [f"w{x}" for x in rng.integers(0, 40, 6)]
        bags.append(np.array(sorted({T.term(x) for x in noise + ["insult"] * a + ["group"] * b}), dtype=np.int64))
        labels.append(a != b)
    m = T.fit(bags, np.array(labels, dtype=float), epochs=40)
    one = min(m.score("insult w1 w2"), m.score("group w1 w2"))
    assert one > 0.6 > 0.4 > max(m.score("insult group w1 w2"), m.score("w1 w2"))


def test_training_does_not_depend_on_the_order(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.union(docs.limit(40).withColumn("text", F.lit("the same words")))
    a, b = T.train(docs, labels), T.train(docs.repartition(7, "source").orderBy(F.desc("text")), labels.repartition(5))
    assert a.row == b.row and a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


@pytest.mark.parametrize("labels", [[], [0.0, 0.0], [1.0, 1.0]])
def test_machine_without_contrast(labels):
    m = T.fit([np.array([T.term("x")], dtype=np.int64) for _ in labels], np.array(labels))
    assert 0 <= m.score("x") <= 1 and 0 <= m.score(None) <= 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = T.op5_machine(spark, sf)
    assert out.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0
    rows = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] > 0.7 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) < 0.02 * n[0, 0]


def test_toxicity_odd_rows(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(None, None, "x"), (1, "", None), (1, "idiot", None)], schema)
    labels = spark.createDataFrame([(1, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    m = T.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in T.score(docs, m).collect()) and T.score(docs.limit(0), m).count() == 0
