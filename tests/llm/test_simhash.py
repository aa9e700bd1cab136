import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def plain_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, distance):
    """Least index reachable, by comparing all pairs."""
    v = np.array(prints, dtype=np.uint64)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "Ä É x y z z z z", "a\x0bb\x0cc d e", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [plain_print(docs[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, plain_groups(prints, 2), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize(("distance", "small", "large"), [(2, 24, 4096), (2, 3, 40), (5, 24, 4096), (5, 2, 16)])
def test_links_keep_components(spark, distance, small, large):
    rng = random.Random(distance + small)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        p = rng.choice(prints[:4] if rng.random() < 0.6 else prints)
        for _ in range(rng.randrange(distance + 2)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long").repartition(3)
    found = simhash.links(nodes, distance, small, large)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in pairs)
    roots = {r.id: r.root for r in simhash.components(found).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == plain_groups(prints, distance)


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp string, id int"
    rows = [(5, None, None, 1), (3, "", "x", 1), (None, " ", "x", 1), (9, "one two three four", None, None), (9, "one two three four", None, None), (None, "alone among all", None, 2)]
    got = sorted(simhash.near_groups(spark.createDataFrame(rows, schema)).select("doc_id", "component_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (None, None)], key=str)
    assert simhash.near_groups(spark.createDataFrame([], schema)).count() == 0
