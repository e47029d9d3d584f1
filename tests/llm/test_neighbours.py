from math import erf, sqrt

import numpy as np

from wavemark.llm import collisions
from wavemark.llm.neighbours import nearest
from wavemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score double, number int"


def brute(rows, asked, k=10):
    """All distances, ties to the smaller id; one candidate for equal rows."""
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok, out = sorted(set(ok)), {}
    for i, q in {(i, v) for i, v in ok if asked(i)}:
        found = [(float(np.sqrt(np.square(np.array(v) - np.array(q)).sum())), j) for j, v in ok if j != i and len(v) == len(q)]
        out.setdefault(i, []).append(sorted(found)[:k])
    return {i: sorted(x) for i, x in out.items()}


def lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def clusters(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dims))
    return [(i, [float(x) for x in centres[r.integers(30)] + r.choice([0.01, 0.3, 1.0]) * r.normal(size=dims)]) for i in range(n)]


def test_recall_and_order(spark):
    rows = clusters(3000, 24, 2)
    df = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA)
    want = brute(rows, lambda i: i % 20 == 0)
    for size in (100_000, 100):
        got = lists(nearest(df, df.where("vec_id % 20 = 0"), shard_rows=size).collect())
        assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
        hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i][0]}) for i in want)
        assert hits >= 0.97 * 10 * len(want)
        exact = {i: dict((j, d) for d, j in [(float(np.linalg.norm(np.array(v) - np.array(rows[i][1]))), k) for k, v in rows]) for i in want}
        assert all(abs(d - exact[i][j]) < 1e-12 for i in got for d, j in got[i])


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 100 == 0), lists(QUERIES["op12_nearest_neighbours"](spark, sf).collect())
    assert set(got) == set(want)
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i][0]}) for i in want) >= 0.95 * 10 * len(want)


def test_many_copies_ties_and_few_candidates(spark):
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400, 0, -1)] + [(1000 + i, [float(x) for x in r.normal(size=3)]) for i in range(50)]
    rows += [(2000, [1.0, 1.0]), (2010, [1.0, 2.0]), (2001, [4.0, 5.0])]  # another length: two candidates each
    df = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA).repartition(7)
    got, want = lists(nearest(df, df.where("vec_id % 10 = 0"), shard_rows=40).collect()), brute(rows, lambda i: i % 10 == 0)
    assert [j for _, j in got[10]] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11] and [j for _, j in got[400]] == list(range(1, 11))
    assert [j for _, j in got[2000]] == [2010, 2001] and set(got) == set(want)
    assert all(got[i] == want[i][0] for i in (10, 20, 200, 400, 2000, 2010))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (10, []), (20, [0.0, 0.0]), (30, [None, 1.0]), (40, [nan, 1.0]), (50, [inf, 1.0]), (None, [1.0, 1.0]), (60, [1.0, 1.0]), (60, [1.0, 1.0]), (70, [1e200, 1e200]), (80, [1e-200, 0.0]), (80, [3.0, 4.0]), (81, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA)
    got = nearest(df, df.where("vec_id % 10 = 0")).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((i, k, j) for i, many in want.items() for one in many for k, (_, j) in enumerate(one, 1))
    assert nearest(df.limit(0), df.limit(0)).count() == 0 and nearest(df.where("vec_id = 60"), df.where("vec_id = 60")).count() == 0


def test_width_holds_the_chance_that_it_promises():
    p = erf(collisions.WIDTH / sqrt(2))
    r = np.random.default_rng(0)
    missed = (r.binomial(collisions.PROJECTIONS, p, 200_000) < collisions.THRESHOLD).mean()
    assert abs(missed - collisions.MISSED) < 0.002


def test_windows_prune():
    """Of a table with near neighbours, only a small part is verified."""
    rows = clusters(4000, 32, 9)
    v, tested = np.array([x for _, x in rows]), []
    shard = collisions.Shard.build(v, np.arange(4000), 11)
    keep = shard.distances
    shard.distances = lambda rows, q: tested.append(len(rows)) or keep(rows, q)
    near = [i for i in range(4000) if np.partition(np.square(v - v[i]).sum(1), 10)[10] < 0.1][:50]
    best = [(np.empty(0), np.empty(0, np.int64))] * len(near)
    shard.search(v[near], np.array(near), best, 10)
    assert len(near) == 50 and sum(tested) < 0.1 * 50 * 4000
