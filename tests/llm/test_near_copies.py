import random

import pytest

import corpus_pipeline
from millrace.llm import near_copies as N


def plain_kept(rows):
    """Indices of the first row of each group that pairs of Jaccard 0.8 or more over five-word shingles connect."""
    sets, root = [], []
    for i, text in enumerate(rows):
        w = (text or "").lower().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        near = {root[j] for j, o in enumerate(sets) if (s == o if not s else len(s & o) * 5 >= len(s | o) * 4)}
        root = [min(near) if r in near else r for r in root] + [min(near, default=i)]
        sets.append(s)
    return [i for i, r in enumerate(root) if i == r]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "one  TWO", "one three", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 400))]
        texts += [" ".join(base), *[edited(rng, base, rng.randrange(1, 1 + len(base) // 30)) for _ in range(4)]]
    want = plain_kept(texts)
    assert len(texts) - len(want) > 40
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_a_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[12 * i : 12 * i + 200]) for i in (0, 4, 2, 3, 1, 6, 5)] + ["something else that is alone here"]
    assert plain_kept(texts) == [0, 7]
    got = N.drop_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 7]


def test_components_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(N, "MANY", 3)
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(120)]
        texts += [edited(rng, base, rng.randrange(0, 6)) for _ in range(25)]
    got = N.drop_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bits=8)
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(texts)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(rng, base, rng.randrange(1, 8)) for _ in range(400)]
    got = N.drop_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(texts)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows(spark, kind):
    text = "the words of this text are many and all alike"
    rows = [(None, text), ("7", text + " "), ("7", text), (None, None), ("9", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text")
    assert sorted(str(r.doc_id) for r in N.drop_copies(docs).collect()) == ["7", "9"]
    assert N.drop_copies(docs.limit(0)).count() == 0
