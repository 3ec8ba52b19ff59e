from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from tidelens.llm import negatives, queries

SCHEMA = "vec_id long, label string, v array<double>"


def brute(rows, asked, positives=5, negs=3, low=50, high=95):
    """rows and asked: (place in rows, id, label, vector)."""
    out = []
    for k, i, label, q in asked:
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v, strict=True))), j, other) for m, j, other, v in rows if m != k and len(v) == len(q))
        for s, p, other in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negs]
            out += [(i, p, r, x[1], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out)


def numbered(rows):
    return [(k, *r) for k, r in enumerate(rows)]


def mined(spark, rows, every=50, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, df.filter(f"vec_id % {every} = 0"), **more).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_and_its_sql(spark, sf):
    found = sorted(tuple(r) for r in queries.op13_voronoi_hard_negatives(spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    assert found == sorted(con.execute(queries.oracle_sql()["op13_voronoi_hard_negatives"]).fetchall()) and found


@pytest.mark.parametrize(("pivots", "sample", "block", "part"), [(256, 2048, 1024, 8192), (12, 40, 2, 50), (1, 1, 3, 1000), (30, 300, 1, 7)])
def test_against_brute_force(spark, pivots, sample, block, part):
    """Ties, repeated ids and rows, two lengths, one vector for a third of all rows, whatever the sizes of cells and blocks."""
    rng = random.Random(pivots)
    centres = [[rng.randint(-40, 40) for _ in range(4)] for _ in range(6)]
    rows = [(i, rng.choice("abc"), [float(c + rng.randint(-4, 4)) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, "abcd"[i % 4], [30.0, -10.0, 5.0, 7.0]) for i in range(150)]
    rows += [(i, "a", [float(i % 9), 3.0]) for i in range(500, 530)] + [rows[50]] * 2 + [(100, "b", [9.0, 9.0, 9.0, 9.0]), (600, "alone", [1.0, 2.0, 3.0, 4.0]), (650, "a", [1.0])]
    want = brute(numbered(rows), [r for r in numbered(rows) if r[1] % 50 == 0])
    assert mined(spark, rows, pivots=pivots, sample_rows=sample, block_rows=block, part_rows=part) == want and len(want) > 50


def test_large_numbers(spark):
    rows = [(0, "a", [3e9, 1.0]), (1, "a", [3e9, 2.0]), (2, "b", [2e9, 7.0]), (3, "b", [2e9, 8.0]), (4, "b", [1.0, 1.0]), (5, "b", [-3e9, 1.0])]
    assert mined(spark, rows) == brute(numbered(rows), numbered(rows)[:1])


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], 7), (1, 1, [1.0, 1.0], 7), (2, 2, [0.9, 0.4], 7), (3, None, [1.0, 1.0], 7), (4, 2, None, 7), (5, 2, [1.0, None], 7), (6, 2, [nan, 1.0], 7), (7, 2, [inf, 1.0], 7), (None, 2, [1.0, 1.0], 7), (8, 2, [], 7)]
    df = negatives.labelled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v int"))
    assert sorted(r.vec_id for r in df.collect()) == [0, 1, 2]
    got = [tuple(r) for r in negatives.hard_negatives(df, df.filter("vec_id = 0")).collect()]
    assert got == [(0, 1, 1, 2, 256 * 256 + 128 * 256, 230 * 256 + 102 * 128)]
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, df.limit(0)).count() == 0


def test_bounds_keep_what_serves_and_leave_out_most():
    rng = np.random.default_rng(3)
    v = np.floor(np.repeat(rng.normal(size=(40, 6)) * 1000, 100, 0) + rng.normal(size=(4000, 6)) * 5)
    space = negatives.Space(v[::7], float(np.sqrt((v**2).sum(1).max())), 40)
    q = v[::50]
    scores, cell = q @ v.T, space.distances(q, anchors=True).argmin(1)
    fifth = np.sort(scores, 1)[:, -5]
    near, far = space.far(q, np.full(len(q), np.inf)), space.far(q, fifth)
    radius = space.distances(q, anchors=True).min(1)
    groups = negatives.Groups(space, {int(c): (1, radius[cell == c].max(), near[cell == c].min(), far[cell == c].max()) for c in np.unique(cell)}, 1)
    served = groups.served(v)
    for k in range(len(q)):
        assert served[scores[k] >= fifth[k], groups.of_cell[int(cell[k])]].all()
    assert served.mean() < 0.5
