import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import repeats


def plain(texts, depth):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + depth] for x in raw for i in range(len(x) - depth + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - depth + 1):
            if seen[x[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n, depth, letters):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(depth // 2, depth * 4))) for _ in range(5)]
    out = [None, "", "é" * (depth - 1), "ab" * (3 * depth), "x" * (2 * depth), "x" * depth]
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(2 * depth)] if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(depth)))
        out.append(t)
    return out + out[8:11]


@pytest.mark.parametrize(("seed", "depth", "how"), [(1, 40, {}), (2, 40, {"gram": 30}), (3, 24, {"large": 3, "contexts": 100}), (4, 24, {"contexts": 2}), (5, 24, {"large": 9, "contexts": 2})])
def test_matches_brute_force(spark, seed, depth, how, monkeypatch):
    t = texts(seed, 60, depth, "abé" if seed % 2 else "abcdefghij")
    docs = spark.createDataFrame([(i, x, "extra", 0) for i, x in enumerate(t)], "doc_id long, text string, a string, p int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, depth, **how).collect()}
    want = plain(t, depth)
    bad = [(i, got[i], want[i]) for i in got if got[i] != want[i]]
    assert len(got) == len(t) and not bad, (len(bad), bad[:3])


def test_large_groups_by_some_places_at_a_time(spark, monkeypatch):
    t = texts(8, 60, 24, "abé")
    raw = [(i, int(i), x.encode()) for i, x in enumerate(t) if x]
    docs = spark.createDataFrame([(i, x.decode()) for i, _, x in raw], "doc_id long, text string")
    rows = docs.selectExpr("doc_id AS dk", "text").mapInArrow(repeats._anchor_rows(24, 12), "dk long, p long, g long, kl long, kr long")
    rows = rows.groupBy("g", "kl", "kr", repeats.F.expr("p & 16777215").alias("size")).agg(repeats.F.count("*").alias("n"), repeats.F.first("dk").alias("dk"), repeats.F.first("p").alias("p"))
    schema = "g long, dk long, p long, kl long, kr long, n long, state int"
    ends = rows.select("g", "dk", "p", "kl", "kr", "n").repartition(1).sortWithinPartitions("g").mapInArrow(repeats._ends(12, 1000), schema).where("state > 0")
    asked = ends.groupBy("dk").agg(repeats.F.collect_list(repeats.F.struct("g", "p", "state")).alias("asked"))
    ctx = docs.join(asked, docs.doc_id == asked.dk).select("dk", "text", "asked").mapInArrow(repeats._context_rows(24, 12), "g long, dk long, p long, state int, ctx binary")
    batches = ctx.orderBy("g").toArrow().to_batches()
    spans = lambda: sorted(tuple(r.values()) for b in repeats._edges(24, 12, 1000)(iter(batches)) for r in b.select(["dk", "a", "b"]).to_pylist())
    whole = spans()
    monkeypatch.setattr(repeats, "HELD", 30)
    assert whole and spans() == whole


def test_long_text_in_chunks(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 100) for _ in range(5000))
    whole = repeats.anchors(text, 40, 20)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(text, 40, 20), strict=True))


def test_depth_is_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for depth, gram in ((9000, 4000), (40, 40), (40, 0)):
        with pytest.raises(ValueError, match="depth"):
            repeats.repeated_spans(docs, depth, gram)


def test_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "q" * 50 + "w"), (None, "z" + "q" * 50), (1, None)]
    got = sorted((r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, schema), 40).collect())
    assert got == [(0, 0), (50, 1), (50, 1)]
    assert repeats.remove_repeats(spark.createDataFrame([], schema), 40).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_suffix_radix(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == plain([d.text for d in docs], 400)
    assert sum(x[1] for x in got.values()) > 0
