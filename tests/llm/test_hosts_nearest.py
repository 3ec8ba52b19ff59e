from __future__ import annotations

import random

import numpy as np
import pytest

from tidelens.llm import hosts, nearest, queries

URLS = {
    "http://a.COM/en/x": ("a.com", "/en/x", "com/en/", "block"), "https://www.example.com/en/77?q#f": ("www.example.com", "/en/77", "example.com/en/7", "allow"),
    "x://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "x://other.net/de/": ("other.net", "/de/", "net/de/", "allow"), "x://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
    "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "http://": ("", "", None, None), "http://h?x/y": ("h", "", None, None), "http://h#/en/": ("h", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://ORG/es/\n": ("org", "/es/\n", "org/es/", "block"), "http://É.com/en/": ("É.com", "/en/", "com/en/", "block"),
}
PAGES, OUTCOMES = "page_id long, url string, verdict string, bound string", "page_id long, bad int, host string"


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], PAGES)
    found = {r.page_id: r for r in hosts.filter_urls(pages, spark.createDataFrame([], OUTCOMES), queries.URL_RULES).collect()}
    for k, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (found[k].host, found[k].path, found[k].rule, found[k].verdict) == (host, path, rule, verdict or "allow")


def test_reputation(spark):
    pages, outcomes, k = [], [], 0
    for host, n, bad in (("bad.one.com", 40, 39), ("good.one.com", 40, 1), ("few.one.com", 1, 1), ("new.one.com", 0, 0), ("worse.two.org", 30, 30), ("also.two.org", 30, 29), ("new.two.org", 0, 0)):
        for i in range(max(n, 3)):
            pages.append((k, f"http://{host}/{i}", "", ""))
            if i < n:
                outcomes.append((k, int(i < bad), host))
            k += 1
    outcomes += [(None, 1, "x"), (0, 7, "x"), (1, None, "x"), (2, 1, "again")]
    found = hosts.filter_urls(spark.createDataFrame([*pages, (None, "http://good.one.com/", "", "")], PAGES), spark.createDataFrame(outcomes, OUTCOMES), {}).collect()
    verdicts = {r.host: r.verdict for r in found}
    assert len(found) == len(pages) + 1
    assert verdicts["bad.one.com"] == verdicts["worse.two.org"] == "block" and verdicts["good.one.com"] == verdicts["few.one.com"] == verdicts["new.one.com"] == "allow"
    bounds = {r.host: r.bound for r in found}
    assert bounds["new.two.org"] > bounds["new.one.com"] and bounds["few.one.com"] > bounds["good.one.com"]
    assert hosts.filter_urls(spark.createDataFrame([], PAGES), spark.createDataFrame([], OUTCOMES), {}).count() == 0


def test_suffixes_of_two_labels(spark):
    row = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("com",), ("1.2.3.4",)], "h string").select(hosts.domain_of(hosts.F.col("h"), ("co.uk",)).alias("d"), hosts.suffix_of(hosts.F.col("h"), ("co.uk",)).alias("s")).collect()
    assert [tuple(r) for r in row] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("com", "com"), ("1.2.3.4", "1.2.3.4")]


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scored = [(-int(np.dot(v, w)), i) for i, w in rows]
        scored.remove((-int(np.dot(v, v)), q))
        out += [(q, place + 1, i, -s) for place, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "shard", "block"), [(600, 150, 5), (600, 4096, 4096), (4, 2, 1), (1, 10, 10)])
def test_top_k(spark, n, shard, block):
    rng = random.Random(n)
    rows = [(i, [float(rng.randint(-6, 6)) for _ in range(5)]) for i in range(n)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, -1.0, 0.0]) for i in range(300 if n > 100 else 0)]
    asked = [r for r in rows if r[0] % 50 == 0]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = sorted(tuple(r) for r in nearest.top_k(df, df.filter("vec_id % 50 = 0"), 5, shard, block).collect())
    assert found == brute([(i, np.array(v)) for i, v in rows], asked, 5)


def test_tree_skips_leaves():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(size=(4000, 3)) * 100)
    t = nearest.Tree(np.arange(4000), v)
    q = np.array([100.0, 50.0, -20.0])
    best, read = t.search(q, -1, t.bounds(q[None])[0], 5, -np.inf)
    want = sorted(zip(-(v @ q), range(4000), strict=True))[:5]
    assert best == [(-s, i) for s, i in want] and read < 12


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], 1), (1, [0.001, -0.001], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (None, [1.0, 1.0], 1), (7, [3e38, 3e38], 1), (8, [1.0, 1.0, 1.0], 1)]
    df = nearest.whole_parts(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int"))
    assert {r.vec_id: list(r.v) for r in df.collect() if r.vec_id < 7} == {0: [128.0, -64.0], 1: [0.0, -1.0]}
    found = {(r.query_id, r.rank): r for r in nearest.top_k(df, df.filter("vec_id = 0"), 5).collect()}
    assert {k: (r.vec_id) for k, r in found.items()} == {(0, 1): 7, (0, 2): 1}
    assert nearest.top_k(df.limit(0), df.limit(0)).count() == 0


def test_repeated_ids_and_rows(spark):
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [1.0, 1.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0]), *((9, [5.0, 5.0]) for _ in range(8))]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = sorted(tuple(r) for r in nearest.top_k(df, df.filter("vec_id % 50 = 0"), 3, 2, 1).collect())
    assert found == brute([(i, np.array(v)) for i, v in rows], [(i, np.array(v)) for i, v in rows if i % 50 == 0], 3)


def test_cells_out_of_reach():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 1000
    v = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 8)) * 5)
    cells = nearest.Cells(v[::3].tolist(), 40)
    own = cells.of(v)
    cells.know({8: {int(c): (v[own == c].min(0).tolist(), v[own == c].max(0).tolist()) for c in np.unique(own)}})
    q = v[::50]
    scores = q @ v.T
    fifth = np.sort(scores, 1)[:, -5]
    known, most = cells.bounds(q)
    for row, bound, kth in zip(scores, most, fifth, strict=True):
        reach = set(known[bound >= kth].tolist())
        assert set(own[row >= kth].tolist()) <= reach and len(reach) < cells.count / 4


def test_one_vector_for_a_third_of_rows(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(4)]) for i in range(400)] + [(1000 + i, [7.0, 1.0, 0.0, 2.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = sorted(tuple(r) for r in nearest.top_k(df, df.filter("vec_id % 50 = 0"), 5, 40, 3).collect())
    assert found == brute([(i, np.array(v)) for i, v in rows], [(i, np.array(v)) for i, v in rows if i % 50 == 0], 5)
