import math

import numpy as np
import pytest

from millrace.llm import neighbours as N


def brute(rows, queries, k):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, dtype=float)
    ids = np.array(sorted(fine))
    m = np.array([fine[i] for i in ids])
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for q in queries:
        if q in fine:
            cos = m @ fine[q] / (norm * math.sqrt(fine[q] @ fine[q]))
            order = [j for j in np.lexsort((ids, -cos)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        least = best[-1][1] - 1e-9 if best else 0
        mine = [s for _, s in got.get(q, [])]
        hits += sum(s >= least for s in mine)
        total += len(best)
    return hits / max(total, 1)


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = as_lists(N.op2_projected_tree(spark, sf))
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("cell", [100, 100_000])
def test_cells_copies_and_odd_rows(spark, cell):
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [(i, rows[3][1]) for i in range(2000, 2600)]
    rows += [(5000, None), (5050, [0.0] * 12), (5100, [float("nan")] * 12), (5150, [None] * 12), (5200, [1.0]), (None, rows[0][1]), (5250, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = as_lists(N.nearest(df, df.where("vec_id % 50 = 0"), 5, cell=cell))
    want = brute([r for r in rows if not (r[1] and len(r[1]) == 1)], [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q in range(2000, 2600, 50):
        assert [v for v, _ in got[q]] == [v for v in [3, *range(2000, 2010)] if v != q][:5]


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert N.nearest(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], schema)
    assert [(r.vec_id, round(r.score, 9)) for r in N.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 0.707106781), (2, 0.707106781)]


def test_equal_cosines_go_by_id(spark):
    base = np.array([0.3, -1.7, 2.9, 0.1])
    df = spark.createDataFrame([(i, (base * (1 + i / 7)).tolist()) for i in range(1, 61)], "vec_id long, embedding array<double>")
    got = as_lists(N.nearest(df.repartition(3), df.where("vec_id = 50")))
    assert got == {50: [(i, 1.0) for i in range(1, 6)]}


def test_a_query_vector_of_many_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(i, [1.0] * 8) for i in range(1000, 4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = as_lists(N.nearest(df, df.where("vec_id % 2 = 0"), cell=100, block=50))
    assert len(got) == 200 + 1500
    for q in range(1000, 4000, 2):
        assert [v for v, _ in got[q]] == [v for v in range(1000, 1006) if v != q][:5]
    want = brute(rows, list(range(0, 400, 2)), 5)
    assert recall({q: got[q] for q in want}, want) >= 0.9


def test_boxes_within_reach():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(500, 4))
    splits, leaves = N.split_tree(points, 20)
    home, limit = N.locate(points, splits), np.full(40, 0.5)
    row, at = N.within(points[:40], splits, limit)
    seen = set(zip(row.tolist(), at.tolist(), strict=True))
    assert len(seen) == len(row)
    for i in range(40):
        near = ((points - points[i]) ** 2).sum(axis=1) <= 0.5
        assert {(i, int(c)) for c in home[near]} <= seen


def test_chi_square():
    assert abs(float(N.chi_square(np.array(18.307), 10)) - 0.95) < 1e-4 and abs(N.quantile(0.95, 10) - 18.307) < 1e-3
