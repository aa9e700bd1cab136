import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import stored
from millrace.llm.mixing import mix, take, targets
from millrace.llm.sharding import deal, shard

SCHEMA = "doc_id long, text string, source string, size string"


def odd(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice(["a", "a", "a", "b", None, "ü"]), "x") for i in range(n)]
    rows += [(3, "w ", "a", "x")] * 3 + [(None, None, None, None), (7, None, "a", None), (8, "", "c", None), (9, "long " * 50_000, "b", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shards_are_even_and_mixed(spark):
    docs = odd(spark)
    out = shard(docs, 7, keep=["source", "size"], cells=16).collect()
    assert len(out) == docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for s, n in Counter(r.source for r in out).items():
        per = Counter(r.shard for r in out if r.source == s)
        assert max(per[k] for k in range(7)) - min(per[k] for k in range(7)) <= 2 + (n < 7)
    again = {(r.doc_id, r.shard, r.slot) for r in shard(docs.repartition(5), 7, cells=64).collect()}
    assert {x for x in again if x[0] not in (3,)} == {(r.doc_id, r.shard, r.slot) for r in out if r.doc_id not in (3,)}


def test_sources_of_one_row(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "concat('host', id) AS source").union(
        spark.range(500).selectExpr("id + 9000", "'x'", "'big'"))
    rows = shard(docs, 9, keep=["source"]).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(9) for i in range((3500 * (s + 1) + 8) // 9 - (3500 * s + 8) // 9)]


NAMES = ["shard", "slot", "_row", "_file", "_copy", "own", "_shard", "kept", "_metadata", "taken", "size"]


def clashing(spark, tmp_path):
    base = spark.createDataFrame([(i, f"some words {i % 50}", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    base = base.select("*", *[F.lit(n).alias(n) for n in NAMES])
    base.write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_any_column_names(spark, tmp_path):
    docs = clashing(spark, tmp_path)
    out = deal(docs, 7)
    assert out.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"] and out.count() == 60
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [8] * 3 + [9] * 4
    taken = take(docs)
    assert taken.columns == docs.columns and taken.count() > 0
    assert simhash.drop_near(docs).columns == docs.columns


def test_rows_made_of_file_rows(spark, tmp_path):
    docs = clashing(spark, tmp_path)
    for many in (docs.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(2)))), docs.join(docs.select("source").distinct(), "source"), docs.union(docs), docs.limit(40), docs.orderBy("text")):
        n = many.count()
        assert deal(many, 5).count() == n
        assert simhash.drop_near(many).count() == many.select("doc_id", "text").distinct().select("text").distinct().count() == simhash.drop_near(stored(many)).count()


def test_a_hundred_thousand_sources(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "'two words' AS text", "concat('s', id) AS source")
    out = mix(docs)
    assert out.count() == 100_000 and out.where("taken > 3 * size").count() == 0
    assert shard(docs, 40).groupBy("shard").count().where("count <> 2500").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard(empty, 7).count() == 0
    assert mix(empty).count() == 0


def filled(sizes, weights=(5, 2, 1), most=3):
    """The rule as told: share, stop, share the excess anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while True:
        total = sum(w[s] for s in free)
        above = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not above:
            return out | {s: left * w[s] / total for s in free}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 20_000]) for s in ["b", "a", "é", "z", None, "aa", "B", "src10", "src9"]}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(float(t), 6) for s, t in want.items()}


def test_mixture_meets_its_targets(spark):
    docs = odd(spark).withColumn("q", F.when(F.col("doc_id") % 5 == 0, 4.0).otherwise(F.lit(None)))
    out = mix(docs, quality="q", cells=16).collect()
    assert len(out) == docs.count()
    by = defaultdict(list)
    for r in out:
        by[(r.source_size, r.target)].append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    for (_, goal), rows in by.items():
        assert abs(sum(r.taken for r in rows) - goal) <= max(r.size for r in rows) / 2 + 1e-6
    again = mix(docs.repartition(3), quality="q", cells=99).collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)


def test_quality_is_preferred(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two' AS text", "if(id % 2 = 0, 'a', 'b') AS source", "if(id % 4 < 2, 8.0, 1.0) AS q")
    out = mix(docs, quality="q").where("source_size = 4000 AND target < 4000")
    good, poor = (out.where(f"doc_id % 4 {c} 2").agg(F.avg("taken")).first()[0] for c in ("<", ">="))
    assert good > 1.5 * poor
