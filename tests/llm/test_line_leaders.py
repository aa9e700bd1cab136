import random

from pyspark.sql import functions as F

from millrace.llm import line_dedup as L


def near(rng, name, size, first, changed):
    out = []
    for i in range(size):
        words = [f"{name}{j}" for j in range(40)]
        for j in rng.sample(range(40), changed):
            words[j] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(words)))
    return out


def test_only_large_groups_have_leaders(spark):
    rng = random.Random(11)
    small = [row for k in range(12) for row in near(rng, f"g{k}w", 6, 1000 * (k + 1), 2)]
    sets = L.stored(L.classes(spark.createDataFrame(small, "doc_id long, text string")))
    assert L.leading(sets).count() == 0  # the join finds what they have
    large = near(rng, "w", 300, 100_000, 2)
    sets = L.stored(L.classes(spark.createDataFrame(small + large, "doc_id long, text string").repartition(3)))
    leads = L.leading(sets)
    led = leads.join(sets.select(F.col("id").alias("y"), "doc_id"), "y").select("doc_id").distinct()
    assert led.where("doc_id < 100000").count() == 0 and led.count() > 250
    assert leads.count() <= 3 * L.LEADERS * sets.count()


def test_small_and_large_groups_against_brute_force(spark):
    rng = random.Random(12)
    docs = [row for k in range(6) for row in near(rng, f"g{k}w", 6, 1000 * (k + 1), 3)] + near(rng, "w", 150, 100_000, 3) + [(7, "one"), (8, "one two three")]
    seen, want = [], set()
    for i, text in sorted(docs):
        words = set(text.split())
        if not any(len(words & s) * 9 >= 4 * (len(words) + len(s)) for s in seen):
            want.add(i)
        seen.append(words)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for broadcast_rows in (0, 1000):
        assert {r.doc_id for r in L.kept_lines(df, broadcast_rows=broadcast_rows).collect()} == want


def test_words_from_held_lines_are_those_of_the_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nf g h i j"), (1, "k l m n o"), (None, "p q r s t"), (2, None)], "doc_id long, text string")
    cut, sets = L.held(docs), L.stored(L.classes(docs, 6))
    pairs = sets.select(F.col("id").alias("x"), F.col("id").alias("y"))
    rows = lambda df: sorted((r.id, str(r["at"]), sorted(r.words)) for r in df.collect())
    assert rows(L.words_of_classes(docs, sets, pairs, 1000, cut)) == rows(L.words_of_classes(docs, sets, pairs, 1000))
    assert len(rows(L.words_of_classes(docs, sets, pairs, 0, cut))) == 4
    cut.unpersist()
