"""The matcher on small cases made by hand, with every boundary."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelens.functions.geo import haversine_km
from tidelens.operators import match
from tidelens.plans.source_queries import DRIVER, database_of
from tidelens.sources import sources

T0 = datetime(2026, 8, 1, 12)
DET = "detection_id string, ts timestamp, lat double, lon double"
POS = "mmsi bigint, ts timestamp, lat double, lon double"
ALL = [(T0 - timedelta(hours=1), None, T0 + timedelta(hours=1))]


def run(spark, positions, detection=(40.0, 25.0), ledger=ALL, **params):
    d = spark.createDataFrame([("d", T0, *detection)], DET)
    p = spark.createDataFrame([(m, T0 + timedelta(seconds=s), lat, lon) for m, s, lat, lon in positions], POS)
    sessions = spark.createDataFrame(ledger, "started_at timestamp, last_message_at timestamp, ended_at timestamp")
    return match.match_detections(d, p, match.covered_by_ledger(d, sessions), match.Params(**params)).first()


def test_match_close_by(spark):
    r = run(spark, [(123456789, 0, 40.0, 25.0)], (40.001, 25.001))
    assert (r.status, r.best.mmsi) == ("Matched", 123456789)
    assert r.best.distance_km == pytest.approx(0.14007, abs=1e-5)


def test_dark_when_covered(spark):
    r = run(spark, [(999, 0, 10.0, 10.0)])
    assert (r.status, r.had_coverage, r.best, r.candidates) == ("Dark", True, None, [])


def test_unknown_without_coverage(spark):
    r = run(spark, [], ledger=[])
    assert (r.status, r.had_coverage) == ("UnknownNoCoverage", False)


def test_nearest_of_several(spark):
    r = run(spark, [(1, 0, 40.03, 25.03), (2, 0, 40.002, 25.002)])
    assert r.status == "Matched" and [c.mmsi for c in r.candidates] == [2, 1]
    assert [c.distance_km for c in r.candidates] == pytest.approx([0.28014, 4.20181], abs=1e-5)


def test_report_outside_the_window(spark):
    r = run(spark, [(1, 2400, 40.0, 25.0)])
    assert (r.status, r.best) == ("Dark", None)


def test_interpolates_between_reports(spark):
    r = run(spark, [(1, -600, 40.02, 25.02), (1, 600, 40.08, 25.08)], (40.05, 25.05))
    assert (r.status, r.best.gap_s) == ("Matched", 0) and r.best.distance_km < 0.1


def test_refuses_times_without_zone(spark):
    d = spark.createDataFrame([("d", T0, 0.0, 0.0)], DET).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        match.match_detections(d, spark.createDataFrame([], POS))


@pytest.mark.parametrize(("seconds", "found"), [(899, True), (900, True), (901, False), (-900, True), (-901, False)])
def test_gap_is_closed(spark, seconds, found):
    r = run(spark, [(1, seconds, 40.0, 25.0)])
    assert (r.best is not None) == found and r.status == ("Matched" if found else "Dark")


@pytest.mark.parametrize(("seconds", "found"), [(1200, True), (1200.000001, False), (-1200, True), (-1200.000001, False)])
def test_window_is_closed(spark, seconds, found):
    r = run(spark, [(1, seconds, 40.0, 25.0)], gap_s=5000)
    assert (r.best is not None) == found


def test_end_outside_the_radius_is_not_used(spark):
    r = run(spark, [(1, -600, 40.0, 25.0), (1, 600, 40.2, 25.2)])
    assert (r.best.gap_s, r.best.distance_km) == (600, 0)


def test_exact_report_has_no_gap(spark):
    r = run(spark, [(1, 0, 40.0, 25.0), (1, -60, 40.01, 25.0), (1, 60, 40.01, 25.0)])
    assert (r.best.gap_s, r.best.distance_km) == (0, 0)


def test_match_beats_missing_coverage(spark):
    r = run(spark, [(1, 0, 40.0, 25.0)], ledger=[])
    assert (r.status, r.had_coverage) == ("Matched", False)


def test_far_candidate_is_told_when_dark(spark):
    r = run(spark, [(1, 0, 40.03, 25.0)])
    assert r.status == "Dark" and r.best.mmsi == 1


def test_ties(spark):
    r = run(spark, [(7, 0, 40.001, 25.0), (3, 0, 40.001, 25.0), (3, 0, 40.004, 25.0)])
    assert [c.mmsi for c in r.candidates] == [3, 7]


def test_box_keeps_corners(spark):
    corner = [(1, 0, 40.04, 25.05)]
    assert run(spark, corner).best is None and run(spark, corner, circle=False).best.distance_km > 5


def test_ledger_rows(spark):
    early = T0 - timedelta(minutes=30)
    cases = [((early, None, None), False), ((early, T0 - timedelta(minutes=5), None), True), ((early, T0, T0 - timedelta(minutes=6)), False), ((T0 + timedelta(minutes=5), None, None), True)]
    for row, expected in cases:
        assert run(spark, [], ledger=[row]).had_coverage == expected


def test_empty_tables_and_nulls(spark):
    d = spark.createDataFrame([("a", None, 1.0, 1.0), ("b", T0, None, 1.0)], DET)
    p = spark.createDataFrame([(1, None, 1.0, 1.0), (2, T0, None, None)], POS)
    assert {r.status for r in match.match_detections(d, p).collect()} <= {"UnknownNoCoverage", "Dark"}
    assert match.match_detections(d.limit(0), p).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(-2000, 2000), st.floats(-90, 90), st.floats(-180, 180)), max_size=12), st.sampled_from([0.0, 60.0, -60.0, 89.2]))
def test_cells_find_what_a_nested_loop_finds(spark, reports, lat):
    d = spark.createDataFrame([("a", T0, lat, 25.0), ("b", T0 + timedelta(seconds=700), lat + 0.03, -179.99)], DET)
    near = [(m, s, lat + x / 2000, 25.0 + y / 2000) for m, s, x, y in reports]
    p = spark.createDataFrame([(m, T0 + timedelta(seconds=s), x, y) for m, s, x, y in near], POS)
    got = sorted((r.detection_id, r.mmsi, r.t) for r in match.candidate_reports(d, p).collect())
    pairs = d.crossJoin(p.select("mmsi", F.col("ts").alias("pt"), F.col("lat").alias("plat"), F.col("lon").alias("plon")))
    apart = F.abs(F.unix_micros("pt") - F.unix_micros("ts")) <= 1_200_000_000
    inside = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= 5
    want = sorted((r.detection_id, r.mmsi, r.t) for r in pairs.filter(apart & inside).select("detection_id", "mmsi", F.unix_micros("pt").alias("t")).collect())
    assert got == want


def test_a_crowded_cell_is_split(spark):
    """Most reports in one place and hour: the same pairs, whatever the parts, and no part with much more than its share."""
    rng = random.Random(2)
    base = 1_785_542_400
    rows = [(i, base + rng.randint(0, 1100), 42.0 + rng.random() / 50, 27.0 + rng.random() / 50) for i in range(4000)] + [(10_000 + i, base + rng.randint(0, 9000), 42.0 + rng.random() * 3, 27.0 + rng.random() * 3) for i in range(400)]
    reports = spark.createDataFrame(rows, "mmsi long, t long, lat double, lon double").selectExpr("mmsi", "timestamp_seconds(t) as ts", "lat", "lon")
    det = spark.createDataFrame([(f"d{i}", base + 120 * i, 42.0 + (i % 7) / 300, 27.0 + (i % 5) / 300) for i in range(60)], "detection_id string, t long, lat double, lon double").selectExpr("detection_id", "timestamp_seconds(t) as ts", "lat", "lon")
    pairs = lambda hot: sorted((r.detection_id, r.mmsi, r.t) for r in match.candidate_reports(det, reports, hot_rows=hot).collect())
    want = pairs(None)
    assert want and pairs(100) == want == pairs(5000)
    plain = det.alias("d").crossJoin(reports.alias("r")).filter("abs(unix_micros(d.ts) - unix_micros(r.ts)) <= 1200000000").filter(haversine_km(F.col("d.lat"), F.col("d.lon"), F.col("r.lat"), F.col("r.lon")) <= 5)
    assert sorted((r.detection_id, r.mmsi) for r in plain.select("d.detection_id", "r.mmsi").collect()) == [x[:2] for x in want]


def test_cells_near_a_pole_and_the_date_line(spark):
    base = "2026-08-01 12:00:00"
    det = spark.createDataFrame([("n", 89.99, 10.0), ("s", -89.97, -170.0), ("e", 10.0, 179.99), ("w", 10.0, -179.99), ("band", 45.0, 27.0)], "detection_id string, lat double, lon double").selectExpr("detection_id", f"timestamp'{base}' as ts", "lat", "lon")
    reports = spark.createDataFrame([(i, lat, lon) for i, (lat, lon) in enumerate([(89.99, 15.0), (89.98, 10.1), (-89.96, -168.0), (10.01, 179.98), (10.0, -179.98), (44.96, 27.0), (45.04, 27.01), (45.0, 27.06), (45.0, 26.94)])], "mmsi long, lat double, lon double").selectExpr("mmsi", f"timestamp'{base}' as ts", "lat", "lon")
    got = sorted((r.detection_id, r.mmsi) for r in match.candidate_reports(det, reports).collect())
    plain = det.alias("d").crossJoin(reports.alias("r")).filter(haversine_km(F.col("d.lat"), F.col("d.lon"), F.col("r.lat"), F.col("r.lon")) <= 5).filter("abs(d.lon - r.lon) < 180")
    assert got == sorted((r.detection_id, r.mmsi) for r in plain.select("d.detection_id", "r.mmsi").collect()) and len(got) == 9


def test_database_is_asked_for_spans(spark):
    """What the database is asked for, and that matching with it gives what matching with the whole table gives."""
    base = 1_785_542_400
    reports = spark.range(3000).selectExpr("id % 20 as mmsi", f"timestamp_seconds({base} + id * 60) as ts", "42.0D + (id % 7) * 0.01D as lat", "27.0D + (id % 11) * 0.01D as lon")
    det = spark.createDataFrame([("a", base + 600, 42.0, 27.0), ("b", base + 90_000, 42.05, 27.05), ("c", base + 90_300, 60.0, 10.0)], "detection_id string, t long, lat double, lon double").selectExpr("detection_id", "timestamp_seconds(t) as ts", "lat", "lon")
    url, driver = database_of(reports), DRIVER
    asked = sources.near_predicates(det, parts=10)
    assert 2 <= len(asked) <= 4 and all("ts >= {ts '2026-0" in x and "lat >= " in x for x in asked)
    found = sources.from_jdbc_near(spark, url, det, parts=10, driver=driver)
    assert found.rdd.getNumPartitions() == len(asked) and 0 < found.count() < 400
    pairs = lambda rows: sorted((r.detection_id, r.mmsi, r.t) for r in match.candidate_reports(det, rows).collect())
    assert pairs(found) == pairs(reports) != []
    assert sources.from_jdbc_near(spark, url, det.limit(0), driver=driver).count() == 0
    plan = sources.from_jdbc(spark, url, driver=driver).filter("lat > 42.05")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(LAT,42.05)" in plan.replace("lat", "LAT")


def _crowd(spark, n=400, seed=3):
    """Reports of which most vessels have one within reach of a cell and some have many, over a window's edges, at a band's edge, near a pole and the date line."""
    rng = random.Random(seed)
    base = 1_785_542_400
    places = [(42.0, 27.0), (4 * 2 * 5 / 111.0, 10.0), (89.97, 100.0), (-10.0, 179.98)]
    at = lambda i, spread: (base + rng.randint(0, 9000), places[i % 4][0] + rng.uniform(-spread, spread), places[i % 4][1] + rng.uniform(-spread, spread))
    reports = [(i % 7 * 4 + i % 4 if i % 3 else 1000 + i, *at(i, 0.05)) for i in range(n)]
    reports += [(5000 + i, t, lat, lon) for i, (_, t, lat, lon) in enumerate(reports[:40])]  # vessels equally far away
    det = [(f"d{i}", *at(i, 0.03)) for i in range(n // 5)]
    return (
        spark.createDataFrame(det, "detection_id string, t long, lat double, lon double").selectExpr("detection_id", "timestamp_seconds(t) as ts", "lat", "lon"),
        spark.createDataFrame(reports, "mmsi long, t long, lat double, lon double").selectExpr("mmsi", "timestamp_seconds(t) as ts", "lat", "lon", "mmsi * 3 as more"),
    )


@pytest.mark.parametrize("circle", [True, False])
def test_meetings_without_a_shuffle_of_pairs_find_the_same(spark, circle):
    det, reports = _crowd(spark)
    p = match.Params(circle=circle)
    columns = ["detection_id", "mmsi", "before", "after", "nearest", "n_reports"]
    told = lambda rows, by=columns: sorted(map(repr, (tuple(r) for r in rows.select(*by).collect())))
    want = match.tracks(match.candidate_reports(det, reports, p, carry=("more",)), carry=("more",))
    got = match.tracks_near(det, reports, p, carry=("more",))
    assert told(got) == told(want) and want.filter("n_reports > 1").count() > 20 and want.filter("n_reports = 1").count() > 20
    columns = ["detection_id", "mmsi", "distance_km", "gap_s", "lat", "lon"]
    found = match.candidates(match.tracks(match.candidate_reports(det, reports, p)), p)
    assert told(match.candidates_near(det, reports, p), columns) == told(found, columns)
    listed = {r.detection_id: r for r in match.match_detections(det, reports, p=p).collect()}
    for r in match.match_best(det, reports, p=p).collect():
        own = listed[r.detection_id]
        assert (r.status, r.had_coverage, r.best, r.n_candidates) == (own.status, own.had_coverage, own.best, len(own.candidates))


@pytest.mark.parametrize("name", ["match_status", "match_box_mode", "match_ledger_coverage", "dark_flags", "dark_totals", "keep_set", "status_breakdown", "scene_totals", "nearest_report", "asof_pair"])
def test_pairs_are_not_shuffled(spark, name):
    """Nothing is shuffled by detection and vessel, and what is by detection was brought down to a row for each before."""
    import re

    from tidelens.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(when_cell" in plan
    assert not re.search(r"hashpartitioning\(detection_id#\d+L?, mmsi", plan)


def test_candidates_are_ranked_where_they_are_found(spark):
    """The same places whatever the parts of crowded cells, and no shuffle or list of pairs on the way."""
    det, reports = _crowd(spark)
    want = sorted((r.detection_id, c.mmsi, k + 1) for r in match.match_detections(det, reports).collect() for k, c in enumerate(r.candidates))
    ranked = {most: match.ranked_candidates(det, reports, most_pairs=most) for most in (10**7, 20)}
    for rows in ranked.values():
        assert sorted((r.detection_id, r.mmsi, r.place) for r in rows.collect()) == want
    assert sorted((r.detection_id, r.mmsi, r.place) for r in match.nearest_first_cap(ranked[20], 1).collect()) == [x for x in want if x[2] == 1]


@pytest.mark.parametrize("name", ["match_candidates", "match_nearest_three"])
def test_ranking_shuffles_no_pairs(spark, name):
    import re

    from tidelens.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(when_cell" in plan and not re.search(r"hashpartitioning\([^)]*detection_id", plan)


@pytest.mark.parametrize("name", ["match_candidates", "match_nearest_three", "match_box_mode", "match_status", "asof_pair", "nearest_report"])
def test_pairs_are_rows_only_where_they_are_asked_for(spark, name):
    """Detections meet reports within a cell's task, once: no join makes a row of each pair, and none is sorted."""
    import re

    from tidelens.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert len(re.findall("FlatMapGroupsInArrow", plan)) == 1 and "Window" not in plan and "SortMergeJoin [when_cell" not in plan.split("FlatMapGroupsInArrow")[0]


def test_places_are_told_of_ties_and_unknown_vessels(spark):
    """Vessels at one place, mirrored ones, some without mmsi, and rounded places on which distances meet the circle's edge closely: as SQL orders them."""
    import duckdb

    rows = [(None if k % 11 == 0 else k % 37, 1_785_542_400 + 61 * (k % 53), 42.0 + 0.001 * (k % 61), 27.0 + 0.005 * (k % 19)) for k in range(900)]
    det = [(k, 1_785_542_400 + 400 * k, 42.02 + 0.01 * (k % 3), 27.045) for k in range(8)]
    reports = spark.createDataFrame(rows, "mmsi long, s long, lat double, lon double").selectExpr("mmsi", "timestamp_seconds(s) as ts", "lat", "lon")
    found = spark.createDataFrame(det, "detection_id long, s long, lat double, lon double").selectExpr("detection_id", "timestamp_seconds(s) as ts", "lat", "lon")
    for circle in (True, False):
        p = match.Params(circle=circle)
        listed = match.candidates(match.tracks(match.candidate_reports(found, reports, p)), p).toPandas()
        want = duckdb.sql("select detection_id, mmsi, row_number() over (partition by detection_id order by distance_km, mmsi nulls first) as place from listed").fetchall()
        got = [(r.detection_id, r.mmsi, r.place) for r in match.ranked_candidates(found, reports, p).collect()]
        known = lambda x: sorted((d, -1 if m is None or m != m else int(m), k) for d, m, k in x)
        assert known(got) == known(want) and len(got) > 100
        best = {d: (m, k) for d, m, k in known(want) if k == 1 for m in [m]}
        for r in match.match_best(found, reports, p=p).collect():
            assert (r.best is None) == (r.detection_id not in best)
            assert r.best is None or (-1 if r.best.mmsi is None else r.best.mmsi) == best[r.detection_id][0]


def test_reports_are_hardly_repeated(spark):
    """Of reports in the middle of a cell of place, only those near a cell's end in time go to two."""
    reports = spark.range(9000).selectExpr("id % 50 as mmsi", "timestamp_seconds(1785542400 + id * 96) as ts", "41.98D as lat", "27.9D as lon")
    det = reports.filter("mmsi = 3").selectExpr("cast(ts as long) as detection_id", "ts", "lat", "lon")
    rows = match._meetings(det, reports, match.Params()).count().agg(F.sum("count")).first()[0] - det.count()
    assert 9000 <= rows < 9000 * 1.25


def test_crowded_cells_are_split_by_time(spark, monkeypatch):
    det, reports = _crowd(spark)
    columns = ["detection_id", "mmsi", "before", "after", "nearest", "n_reports"]
    told = lambda: sorted(map(repr, (tuple(r) for r in match.tracks_near(det, reports).select(*columns).collect())))
    want = told()
    monkeypatch.setattr(match, "CELL_REPORTS", 7)
    assert match._meetings(det, reports, match.Params()).count().filter("part > 0").count() > 3 and told() == want != []


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    from tidelens.functions.geo import rounded

    rng = random.Random(4)
    x = [520.2905, 0.0, -0.5, 0.0005, 2.5, 1.0005, -3.0000005, 42.123, 1e300] + [rng.randint(-(10**7), 10**7) / 2000 for _ in range(2000)] + [rng.uniform(-200, 200) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", rounded(F.col("x"), 3).alias("three"), rounded(F.col("x"), 6).alias("six")).toPandas()
    assert duckdb.sql("select count(*) from got where three <> round(x, 3) or six <> round(x, 6)").fetchall() == [(0,)]
