"""Scene reports in both dialects, built from the detections of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import text
from tidelens.operators import match, scenes
from tidelens.plans.adapter import CANDIDATES, DET, POS, detections, near, positions, with_views
from tidelens.plans.registry import query


def _files(spark: SparkSession, d: str) -> DataFrame:
    """name and content: for every day of detections a report of the detector, on even days with a footprint of its own;
    one in the older dialect; a file that is no JSON and one with an unsafe name."""
    det = detections(spark, d).withColumn("day", F.dayofyear("ts"))
    lon, lat = F.col("lon"), F.col("lat")
    pair = lambda x, y: F.array(lon + x, lat + y)
    one = F.struct(
        F.col("detection_id").alias("n"),
        F.struct(
            ((F.col("detection_id") % 100) / 100).alias("confidence"), F.struct(lon.alias("lon"), lat.alias("lat")).alias("center"), (F.col("detection_id") % 300).cast("double").alias("length_m"), F.lit(20.0).alias("width_m"), (F.col("detection_id") % 360).cast("double").alias("heading_deg"),
            F.when(F.col("detection_id") % 20 == 0, 0.1).alias("heading_confidence"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(4.0))).alias("corners_pixel"),
            F.array(pair(-0.01, -0.01), pair(0.01, -0.01), pair(0.01, 0.01), pair(-0.01, 0.01)).alias("corners_lonlat"),
        ).alias("d"),
    )
    days = det.groupBy("day").agg(F.date_format(F.min("ts"), "yyyyMMdd").alias("date"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("iso"), F.array_sort(F.collect_list(one)).alias("found"))
    quad = F.from_json(F.lit("[[27.0, 42.0], [28.0, 42.0], [28.0, 43.0], [27.0, 43.0]]"), "array<array<double>>")
    report = F.to_json(F.struct(
        F.concat(F.lit("scene "), F.col("day").cast("string")).alias("scene"), F.concat("iso", F.lit("T04:13:22.5Z")).alias("acquisition_time"), F.when(F.col("day") % 2 == 0, quad).alias("footprint_lonlat"), quad.alias("overview_bounds_lonlat"),
        F.from_json(F.lit('[{"stage": "nms", "ms": 12.5}, {"stage": "bad"}]'), "array<struct<stage: string, ms: double>>").alias("timings"), F.transform("found", lambda x: x["d"]).alias("detections"),
    ))
    new = days.select(F.concat(F.lit("S1C_IW_GRDH_1SDV_"), F.col("date"), F.lit("T041322_X")).alias("name"), report.alias("content"))
    old = '{"meta":{"scene":"TYR_20240311","acquired":"2024-03-11 04:17:00"},"ships":[{"id":1,"latitude":41.05,"longitude":12.35,"length_m":120,"heading":268,"conf":0.87},{"latitude":null,"longitude":12.0},{"latitude":41.06,"longitude":12.36}]}'
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit("TYR_20240311").alias("name"), F.lit(old).alias("content")), F.struct(F.lit("broken").alias("name"), F.lit("{no json").alias("content")), F.struct(F.lit("un safe").alias("name"), F.lit(old).alias("content")))).alias("f")).select("f.*")
    return new.unionByName(extra)


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return scenes.normalize(scenes.parse_reports(_files(spark, d)))


_SHIPS = f"""{with_views(POS, DET)}, days as (select dayofyear(ts) as day, strftime(min(ts), '%Y%m%d') as date, min(ts) as dawn from det group by 1),
    named as (select *, 'S1C_IW_GRDH_1SDV_' || date || 'T041322_X' as name from days),
    ships as (select n.name, n.day, date_trunc('day', n.dawn) as dawn, d.detection_id as n, row_number() over (partition by n.name order by d.detection_id) as ship, d.lat, d.lon from det d join named n on n.day = dayofyear(d.ts))"""


@query(f"{_SHIPS} select name, cast(ship as integer) as id, round((n % 100) / 100.0, 6) as conf, round(lat, 6) as latitude, round(lon, 6) as longitude, cast(n % 360 as double) as heading, 2.0::double as col_px, 3.0::double as row_px, round(lat - 0.01, 6) as corner_lat, round(lon - 0.01, 6) as corner_lon from ships")
def scene_normalize(spark: SparkSession, d: str) -> DataFrame:
    s = _normal(spark, d).filter("name like 'S1C%'").select("name", F.explode("ships").alias("s"))
    first = F.element_at("s.corners", 1)
    return s.select("name", "s.id", F.round("s.conf", 6).alias("conf"), F.round("s.latitude", 6).alias("latitude"), F.round("s.longitude", 6).alias("longitude"), "s.heading", "s.col_px", "s.row_px", F.round(F.element_at(first, 1), 6).alias("corner_lat"), F.round(F.element_at(first, 2), 6).alias("corner_lon"))


@query(f"{_SHIPS} select name, 'scene ' || day as scene, strftime(dawn, '%Y-%m-%d') || 'T04:13:22.5Z' as acquired, 'yolov8s-obb-cpp' as model, cast(count(*) as integer) as n from ships group by name, day, dawn union all select 'TYR_20240311', 'TYR_20240311', '2024-03-11 04:17:00', '-', cast(3 as integer)")
def scene_meta(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).select("name", "meta.scene", "meta.acquired", F.coalesce("meta.model", F.lit("-")).alias("model"), F.size("ships").alias("n"))



@query(f"{_SHIPS} select name, 'S1C - ' || strftime(dawn, '%-d %b %Y') || ' 04:13' as label, dawn + interval '4 hours 13 minutes 22 seconds 500 milliseconds' as acquired from (select distinct name, dawn from ships) as x union all select 'TYR_20240311', '11 Mar 2024 04:17', timestamp '2024-03-11 04:17:00'")
def scene_label(spark: SparkSession, d: str) -> DataFrame:
    return scenes.scene_list(_normal(spark, d)).select("name", "label", F.col("acquired").cast("timestamp_ntz").alias("acquired"))


_BOX = """boxes as (select name, case when day % 2 = 0 then 42.0 else min(lat) - case when max(lat) - min(lat) < 1e-4 then 5e-4 else 0 end end as south, case when day % 2 = 0 then 43.0 else max(lat) + case when max(lat) - min(lat) < 1e-4 then 5e-4 else 0 end end as north,
    case when day % 2 = 0 then 27.0 else min(lon) - case when max(lon) - min(lon) < 1e-4 then 5e-4 else 0 end end as west, case when day % 2 = 0 then 28.0 else max(lon) + case when max(lon) - min(lon) < 1e-4 then 5e-4 else 0 end end as east from ships group by name, day
    union all select 'TYR_20240311', 41.05, 41.06, 12.35, 12.36)"""


@query(f"{_SHIPS}, {_BOX} select name, round(south, 6) as south, round(north, 6) as north, round(west, 6) as west, round(east, 6) as east from boxes")
def scene_footprint(spark: SparkSession, d: str) -> DataFrame:
    rows = _normal(spark, d).select("name", scenes.footprint().alias("f"))
    side = lambda k, f: F.round(f(F.transform("f", lambda c: F.element_at(c, k))), 6)
    return rows.select("name", side(1, F.array_min).alias("south"), side(1, F.array_max).alias("north"), side(2, F.array_min).alias("west"), side(2, F.array_max).alias("east"))


@query(f"{_SHIPS} select distinct name, 42.0::double as first_lat, 27.0::double as first_lon, 'nms' as stage, 12.5::double as ms, true as has_sar from ships")
def scene_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = scenes.overlays(_normal(spark, d)).filter("has_sar").select("name", F.element_at("corners", 1).alias("c"), F.explode("timings").alias("t"), "has_sar")
    return rows.select("name", F.element_at("c", 1).alias("first_lat"), F.element_at("c", 2).alias("first_lon"), "t.stage", "t.ms", "has_sar")


_STATUS = f"""{with_views(POS, DET, near(), CANDIDATES)},
    dark as (select d.detection_id, coalesce(min(c.distance_km), 9) > 1 as dark from det d left join cand c using (detection_id) group by d.detection_id)"""
_VESSELS = f"""{_SHIPS.replace(with_views(POS, DET), _STATUS)},
    shown as (select s.name, s.dawn, s.ship, s.n, s.lat, s.lon, k.dark from ships s join dark k on k.detection_id = s.n)"""


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """The ships of the detector's reports, with what the matching of their detections says: dark is what matches no vessel."""
    normal = _normal(spark, d).filter("name like 'S1C%'")
    ids = detections(spark, d).withColumn("name", F.concat(F.lit("S1C_IW_GRDH_1SDV_"), F.date_format("ts", "yyyyMMdd"), F.lit("T041322_X")))
    from pyspark.sql.window import Window

    ship = F.row_number().over(Window.partitionBy("name").orderBy("detection_id"))
    known = match.matched_ids(detections(spark, d), positions(spark, d))
    keep = ids.select("detection_id", text.match_id(F.col("name"), ship).alias("key")).join(known, "detection_id", "left_anti")
    return scenes.vessels(normal, keep.select(F.col("key").alias("detection_id")))


@query(f"{_VESSELS} select name, name || '-' || printf('%03d', ship) as id, dark, case when dark then 'Dark contact ' else 'AIS-matched contact ' end || printf('%02d', ship) as contact, strftime(dawn, '%Y-%m-%d') || ' 04:13 UTC' as detected_at, round(lat, 6) as lat, round(lon, 6) as lon, round((n % 100) / 100.0, 6) as confidence from shown")
def scene_vessels(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).select("name", "id", "dark", "contact", "detected_at", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("confidence", 6).alias("confidence"))


@query(f"{_VESSELS} select name, count(*) as total, count(*) filter (where dark) as dark from shown group by name")
def scene_totals(spark: SparkSession, d: str) -> DataFrame:
    return scenes.totals(_shown(spark, d))


@query(f"{_VESSELS} select name || '-' || printf('%03d', ship) as id from shown where dark")
def scene_dark_only(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).filter("dark").select("id")


_CARD = " union all ".join(
    f"select name || '-' || printf('%03d', ship) as id, '{label}' as label, {value} as value from shown{where}"
    for label, value, where in (
        ("Status", "case when dark then 'Dark vessel (no AIS)' else 'AIS reported' end", ""),
        ("MMSI", "'—'", ""),
        ("Type", "'Unknown'", ""),
        ("Length", "cast(n % 300 as varchar) || ' m'", " where n % 300 <> 0"),
        ("Heading", "cast(n % 360 as varchar) || '°' || case when n % 20 = 0 then '  (direction uncertain)' else '' end", ""),
        ("Detected", "strftime(dawn, '%Y-%m-%d') || ' 04:13 UTC'", ""),
        ("Confidence", "cast(n % 100 as varchar) || ' %'", ""),
    )
)


@query(f"{_VESSELS} {_CARD}")
def ship_card(spark: SparkSession, d: str) -> DataFrame:
    return scenes.card_rows(_shown(spark, d)).filter("label not in ('Latitude', 'Longitude')").select("id", "label", "value")


_IMAGES = "images as (select 'S1A_IW_GRDH_1SDV_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || event_id || case when event_id % 3 = 0 then '.SAFE' else '.tif' end as name, event_id as n, ts from events where event_id % 5 = 0)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    from tidelens.plans.adapter import events

    e = events(spark, d).filter("event_id % 5 = 0")
    return e.select(F.concat(F.lit("S1A_IW_GRDH_1SDV_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".SAFE").otherwise(".tif")).alias("name"), F.col("event_id").alias("n"))


@query(f"with {_IMAGES} select name, case when n % 3 = 0 then 'SAFE' else 'TIF' end as kind from images where n % 7 <> 0")
def unprocessed_images(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    done = images.filter("n % 7 = 0").select(text.scene_id_for_image(F.col("name")).alias("name"))
    return scenes.unprocessed(images, done).select("name", text.image_kind(F.col("name")).alias("kind"))


@query(f"with {_IMAGES} select name, n % 2 = 0 as placed, case when n % 2 = 0 then 30 + n % 15 else -1 end as first_lat from images")
def images_with_footprint(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    lat = (30 + F.col("n") % 15).cast("double")
    corners = F.when(F.col("n") % 2 == 0, F.array(F.array(lat, F.lit(20.0)), F.array(lat + 1, F.lit(21.0))))
    maps = images.groupBy(F.pmod("n", F.lit(16)).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", corners)))).alias("content"))
    found = scenes.images_with_places(images, scenes.explode_footprints(maps))
    return found.select("name", F.col("corners").isNotNull().alias("placed"), F.coalesce(F.element_at(F.element_at("corners", 1), 1).cast("long"), F.lit(-1).cast("long")).alias("first_lat"))


@query(f"with {_IMAGES} select name, 'S1A' as mission, 'IW' as mode, 'GRDH' as product, date_trunc('second', ts) as acquired, 'Sentinel-1A — ' || strftime(ts, '%-d %b %Y, %H:%M') || ' UTC' as shown from images")
def sentinel_name_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).select("name", text.sentinel_parts(F.col("name")).alias("p"))
    return rows.select("name", "p.mission", "p.mode", "p.product", F.col("p.acquired").cast("timestamp_ntz").alias("acquired"), text.image_display_name(F.col("name")).alias("shown"))


@query(f"with {_IMAGES} select regexp_replace(name, '\\.[^.]+$', '') || '__cpp' as name from images where n % 10 <> 0")
def scene_cache_forget(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    cached = images.select(text.scene_id_for_image(F.col("name")).alias("name"))
    return scenes.forget(cached, images.filter("n % 10 = 0").select("name"))


@query("select event_id, event_type || case when event_id % 4 = 0 then ' /' else '' end as name, event_id % 4 <> 0 as safe from events")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.concat("event_type", F.when(F.col("event_id") % 4 == 0, " /").otherwise(""))
    return e.select("event_id", name.alias("name"), text.safe_name(name).alias("safe"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """name, content and n: reports of either dialect. The detector's have a swath where n % 2 is 0 and bounds where n % 3 is
    not; the older ones' ships have no id, and each second ship has no place."""
    from tidelens.plans.adapter import events

    n = F.col("event_id")
    x, y = (n % 30).cast("double"), (30 + n % 15).cast("double")
    quad = lambda by: F.array(*(F.array(x + by * a, y + by * b) for a, b in ((0, 1), (1, 1), (1, 0), (0, 0))))
    new = F.to_json(F.struct(F.lit("2026-08-07T04:13:22Z").alias("acquisition_time"), quad(1).alias("footprint_lonlat"), F.when(n % 3 != 0, quad(2)).alias("overview_bounds_lonlat"), F.when(n % 2 == 0, quad(3)).alias("swath_lonlat"), F.from_json(F.lit("[]"), "array<struct<confidence: double>>").alias("detections")))
    ship = lambda k: F.struct(F.when(F.lit(k % 2 == 0), y + k).alias("latitude"), (x + k).alias("longitude"), F.lit(0.5).alias("conf"))
    old = F.to_json(F.struct(F.struct(F.lit("x").alias("scene"), F.lit("2024-03-11 04:17:00").alias("acquired")).alias("meta"), F.array(*map(ship, range(5))).alias("ships")))
    rows = events(spark, d).filter("event_id % 5 = 0")
    return rows.select(n.alias("n"), F.concat(F.lit("scene_"), n.cast("string")).alias("name"), F.when(n % 10 == 0, new).otherwise(old).alias("content"))


def _normal_reports(spark: SparkSession, d: str) -> DataFrame:
    return scenes.normalize(scenes.parse_reports(_reports(spark, d).select("name", "content")))


@query("select 'scene_' || event_id as name, cast(30 + event_id % 15 + case when event_id % 3 <> 0 then 2 else 1 end as double) as first_lat, cast(case when event_id % 2 = 0 then event_id % 30 + 3 end as double) as swath_lon, 4 as n_corners from events where event_id % 10 = 0")
def scene_overlay_swath(spark: SparkSession, d: str) -> DataFrame:
    """Overlays with bounds of their own or else the footprint, and the swath where a report has one."""
    rows = scenes.overlays(_normal_reports(spark, d)).filter("has_sar")
    at = lambda quad, corner, k: F.element_at(F.element_at(quad, corner), k)
    return rows.select("name", at("corners", 1, 1).alias("first_lat"), at("swath", 2, 2).alias("swath_lon"), F.size("corners").alias("n_corners"))


@query("select 'scene_' || event_id || '-' || printf('%03d', k + 1) as id, 'Dark contact ' || printf('%02d', k + 1) as contact, cast(30 + event_id % 15 + 2 * k as double) as lat, cast(event_id % 30 + 2 * k as double) as lon from events, range(3) as r(k) where event_id % 10 = 5")
def ships_without_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ships of older reports are numbered in the order in which they are shown; those without a place are not shown."""
    return scenes.vessels(_normal_reports(spark, d), None).select("id", "contact", "lat", "lon")


@query("select 'scene_' || event_id as name, event_id % 10 = 0 or event_id % 3 = 0 as has_sar from events where event_id % 5 = 0")
def scene_has_sar(spark: SparkSession, d: str) -> DataFrame:
    """By the report, or by an overview image that lies ready; one that is empty does not count."""
    ready = _reports(spark, d).filter("n % 3 = 0 or n % 7 = 0").select(F.concat("name", F.lit(".png")).alias("name"), F.when(F.col("n") % 3 == 0, 100).otherwise(0).alias("bytes"))
    return scenes.with_sar(_normal_reports(spark, d), ready)
