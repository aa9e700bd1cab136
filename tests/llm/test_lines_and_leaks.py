import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate as D
from millrace.llm import line_dedup as L


def plain_lines(docs):
    seen, out = [], {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        kept = []
        for line in (text or "").split("\n") if text is not None else []:
            words = set("".join(c if c.isalnum() else " " for c in line.lower()).split())
            if not words or not any(len(words & s) * 9 >= 4 * (len(words) + len(s)) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = "\n".join(kept) if text is not None else None
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_lines(spark, broadcast_rows):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 16))] for _ in range(12)]
    docs = [(None, None if broadcast_rows else "null id"), (1, None), (2, ""), (3, "\n\n"), (4, "...\n!"), (5, "Same LINE twice\nsame, line twice")]
    for i in range(6, 60):
        lines = []
        for _ in range(rng.randrange(4)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    docs.append((99, " ".join(f"v{i}" for i in range(20_000)) + "\n" + " ".join(f"v{i}" for i in range(100, 20_000))))
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, line string, n int").repartition(3)
    got = {r.doc_id: r.text for r in L.dedup_lines(df, broadcast_rows=broadcast_rows, bits=6).collect()}
    assert got == plain_lines(docs)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_shared_ids_and_groups(spark):
    words = [f"w{i}" for i in range(20)]
    group = [(i, " ".join(words[:j] + [f"x{i}"] + words[j + 1 :])) for i, j in zip(range(10, 40), list(range(20)) * 2)]
    docs = [(1, " ".join(words)), (1, " ".join(words[:19])), (1, "quite another line of words"), *group]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(df, bits=6).collect())
    assert got == sorted(docs[:3] + [(i, "") for i, _ in group])


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew some potions in a very dark old castle tonight"


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_leaks(spark, broadcast_rows):
    words = ITEM.split()
    changed = [w if i % 7 != 3 else "other" for i, w in enumerate(words)]
    half = words[: len(words) // 3]
    docs = [
        (1, "before it " + ITEM + " after it"), (2, "Before, " + ", ".join(changed).upper()), (3, " ".join(half) + " and then on"),
        (4, " ".join(reversed(words))), (5, None), (6, ""), (None, ITEM), (8, "clean " * 20_000 + ITEM), (1, "nothing here"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame([(7, ITEM), (9, ITEM.title()), (11, "too short"), (12, None), (None, "")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in D.contaminated(df, bench, broadcast_rows=broadcast_rows).collect()}
    assert got == {i: [7] for i in (1, 2, None, 8)}
    left = D.decontaminate(df, bench, broadcast_rows=broadcast_rows)
    assert sorted((r.doc_id, r.text) for r in left.select("doc_id", F.substring("text", 1, 7).alias("text")).collect() if r.text) == [(1, "nothing"), (3, "the qui"), (4, "tonight")]
    assert left.count() == 5 and left.columns == df.columns
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_short_items_and_common_seeds(spark):
    bench = [(1, "five little words in all"), (2, "one"), *[(10 + i, f"{ITEM} and then {i}") for i in range(40)]]
    docs = [(1, "say FIVE little, words in all!"), (2, "five little words"), (3, "One and only"), (4, "ones"), (5, "x " + ITEM), (6, None)]
    got = {r.doc_id: r["items"] for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 5} and got[1] == [1] and got[3] == [2]
    assert 10 in got[5]


def test_any_column_names(spark):
    names = ["kept", "own", "_doc", "_bad", "_file", "_row", "line", "at", "h", "wins", "words"]
    df = spark.createDataFrame([(1, f"{ITEM}\nb", *names), (2, f"clean\n{ITEM}", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    lines = L.dedup_lines(df)
    assert lines.columns == df.columns and sorted((r.doc_id, r.text) for r in lines.collect()) == [(1, f"{ITEM}\nb"), (2, "clean")]
    left = D.decontaminate(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert left.columns == df.columns and left.count() == 0
