"""Scene reports of both dialects, written by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidelens.functions import geo, text
from tidelens.operators import scenes

NEW = {
    "scene": "S1C_IW_GRDH_1SDV_20260807T041322_X", "acquisition_time": "2026-08-07T04:13:22.5Z", "backend": None,
    "footprint_lonlat": [[27.0, 42.0], [28.0, 42.0], [28.0, 43.0], [27.0, 43.0]], "overview_bounds_lonlat": [[27.0, 43.0], [28.0, 43.0], [28.0, 42.0], [27.0, 42.0]], "swath_lonlat": [[27.1, 43.0], [27.9, 43.0], [28.0, 42.0], [27.0, 42.0]],
    "timings": [{"stage": "nms", "ms": 12.5}, {"stage": "bad"}],
    "detections": [{"confidence": 0.87, "center": {"lon": 27.2, "lat": 42.5}, "length_m": 120.0, "width_m": 20.0, "heading_deg": 268.0, "heading_confidence": 0.1, "corners_pixel": [[1, 2], [3, 2], [3, 4], [1, 4]], "corners_lonlat": [[27.19, 42.49], [27.21, 42.49], [27.21, 42.51], [27.19, 42.51]]}],
}
OLD = {"meta": {"scene": "TYR_20240311", "acquired": "2024-03-11 04:17:00"}, "ships": [{"id": 1, "latitude": 41.05, "longitude": 12.35, "length_m": 120, "heading": 268, "conf": 0.87}, {"latitude": None, "longitude": 12.0}, {"latitude": 41.06, "longitude": 12.36}]}


@pytest.fixture(scope="module")
def normal(spark):
    files = [("S1C_IW_GRDH_1SDV_20260807T041322_X", json.dumps(NEW)), ("TYR_20240311", json.dumps(OLD)), ("broken", "{no json"), ("un safe", json.dumps(OLD)), ("newline\n", json.dumps(OLD)), ("empty", json.dumps({"detections": []}))]
    return scenes.normalize(scenes.parse_reports(spark.createDataFrame(files, "name string, content string"))).cache()


def test_normal_form(normal):
    by = {r.name: r for r in normal.collect()}
    assert set(by) == {"S1C_IW_GRDH_1SDV_20260807T041322_X", "TYR_20240311", "empty"}
    new = by["S1C_IW_GRDH_1SDV_20260807T041322_X"]
    ship = new.ships[0]
    assert (ship.id, ship.col_px, ship.row_px, ship.corners[0]) == (1, 2, 3, [42.49, 27.19]) and (new.meta.model, new.meta.ships) == ("yolov8s-obb-cpp", 1)
    assert len(by["TYR_20240311"].ships) == 3 and by["empty"].ships == []


def test_lists_and_overlays(normal):
    listed = {r.name: r for r in scenes.scene_list(normal).collect()}
    assert listed["S1C_IW_GRDH_1SDV_20260807T041322_X"].label == "S1C - 7 Aug 2026 04:13" and listed["TYR_20240311"].label == "11 Mar 2024 04:17" and "empty" not in listed
    assert listed["TYR_20240311"].corners == [[41.05, 12.35], [41.05, 12.36], [41.06, 12.36], [41.06, 12.35]]
    o = {r.name: r for r in scenes.overlays(normal).collect()}["S1C_IW_GRDH_1SDV_20260807T041322_X"]
    assert o.corners[0] == [43.0, 27.0] and o.swath[1] == [43.0, 27.9] and [(t.stage, t.ms) for t in o.timings] == [("nms", 12.5)] and o.has_sar


def test_vessels(spark, normal):
    shown = {r.id: r for r in scenes.vessels(normal, None).collect()}
    assert set(shown) == {"S1C_IW_GRDH_1SDV_20260807T041322_X-001", "TYR_20240311-001", "TYR_20240311-002"} and all(r.dark for r in shown.values())
    keep = spark.createDataFrame([("TYR_20240311-2",)], "detection_id string")
    shown = {r.id: r for r in scenes.vessels(normal, keep).collect()}
    assert shown["TYR_20240311-002"].contact == "Dark contact 02" and shown["TYR_20240311-001"].contact == "AIS-matched contact 01"
    assert shown["TYR_20240311-001"].detected_at == "2024-03-11 04:17 UTC"
    lines = {r.label: r.value for r in scenes.card_rows(scenes.vessels(normal, keep)).filter("id like 'S1C%'").collect()}
    assert lines["Heading"] == "268°  (direction uncertain)" and lines["Confidence"] == "87 %" and lines["Length"] == "120 m" and "Speed" not in lines


def test_box_of_one_ship_is_padded(spark):
    row = spark.range(1).select(scenes.ships_box(F.from_json(F.lit('[{"latitude": 1.0, "longitude": 2.0}]'), f"array<struct<{scenes.SHIP}>>")).alias("b")).first()
    assert row.b[0] == pytest.approx([0.9995, 1.9995]) and row.b[2] == pytest.approx([1.0005, 2.0005])


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.acquired_utc(F.lit("at 2024-03-11T04:17:00+05:00"))).isoformat() == "2024-03-11T04:17:00"
    assert one(text.acquired_utc(F.lit("soon"))) is None and one(text.acquired_utc(F.lit(" "))) is None
    assert one(text.image_display_name(F.lit("S1A_IW_GRDH_1SDV_20260807T041322_1.tif"))) == "Sentinel-1A — 7 Aug 2026, 04:13 UTC"
    assert one(text.scene_id_for_image(F.lit("a.b.tif"))) == "a.b__cpp" and one(text.region_name(F.lit(41.0), F.lit(28.0))) == "Sea of Marmara"
    assert one(text.half_up(F.lit(-0.5))) == 0 and one(text.is_json(F.lit('{"a": 1}'))) and not one(text.is_json(F.lit("{")))
    assert one(text.url_component(F.lit("a b/c"))) == "a%20b%2Fc"
    assert one(geo.swath_clip(*[F.array().cast("array<array<double>>")] * 2)) == ""


def test_footprint_maps(spark):
    maps = spark.createDataFrame([('{"a": [[1, 2]], "b": null}',), ("no json",)], "content string")
    assert [(r.name, r.corners) for r in scenes.explode_footprints(maps).collect()] == [("a", [[1.0, 2.0]])]


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_archive_stamps_in_any_session(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        stamps = spark.createDataFrame([("01/01/2024 9:05",), ("15/07/2024 23:59",), ("15/07/2024 23:59 ",), ("x",), (None,)], "s string")
        parsed = stamps.select(text.parse_archive_stamp(F.col("s"), "Europe/Sofia").alias("t"))
        found = parsed.select(F.unix_seconds("t").alias("t"), text.format_archive_stamp(F.col("t"), "Europe/Sofia").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in found] == [(1704092700, "01/01/2024 09:05"), (1721077140, "15/07/2024 23:59"), (None, None), (None, None), (None, None)]
