import random

from pyspark.sql import functions as F

from millrace.llm import line_dedup as L


def group(seed, size):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(size):
        words = list(base)
        for j in rng.sample(range(60), 4):
            words[j] = f"x{rng.randrange(9)}y{j}"
        out.append((i, " ".join(words)))
    return out


def test_only_open_lines_ask_for_earlier_ones(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k"), (2, "a b c d e f g h i j l"), (3, "a b c d e f g h i j m")], "doc_id long, text string")
    sets = L.stored(L.classes(docs, 6))
    ids = {r.doc_id: r.id for r in sets.collect()}

    def pairs(*settled):
        done = spark.createDataFrame([(ids[d],) for d in settled], "id long")
        return {(frozenset((r.x, r.y)), r["asks"]) for r in L.candidates(sets, done).collect()}

    asked = lambda a, b: (frozenset((ids[a], ids[b])), ids[b])
    assert pairs() == {asked(None, 2), asked(None, 3), asked(2, 3)}
    assert pairs(3) == {asked(None, 2)}  # the last one has gone: no pair is made for it
    assert pairs(2) == {asked(None, 3), asked(2, 3)}  # a line that goes still counts as an earlier one
    assert pairs(2, 3) == set()


def test_nearest_first_finds_the_same(spark):
    docs = group(5, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = L.stored(L.classes(df, 6))
    pairs = L.stored(L.candidates(sets, spark.createDataFrame([], "id long")))
    words = [set(t.split()) for _, t in docs]
    want = {b for b in range(80) if any(len(words[a] & words[b]) * 9 >= 4 * (len(words[a]) + len(words[b])) for a in range(b))}
    for nearest in (1, 4, 1000):
        near, rest = L.settled_by(df, sets, pairs, 1000, nearest)
        first, other = ({r.doc_id for r in x.collect()} for x in (near, rest))
        assert first | other == want and not first & other, nearest
        assert nearest < 1000 or not other
    leads = L.leading(sets)
    assert leads.count() <= 4 * L.LEADERS * sets.count()
    assert not leads.join(sets.select(F.col("id").alias("x"), F.col("doc_id").alias("a")), "x").join(sets.select(F.col("id").alias("y"), F.col("doc_id").alias("b")), "y").where("a >= b").count()
