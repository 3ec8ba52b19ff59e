"""The driver's events as position reports, detections and the texts that sources would bring; each view has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_id % 10 <> 0")
    return e.selectExpr("event_id", "200000000 + user_id as mmsi", "ts", "42.0D + 0.02D * (user_id % 10) + 0.001D * (event_id % 7) as lat", "28.0D + 0.025D * ((user_id div 10) % 10) + 0.001D * (event_id % 5) as lon")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_id % 10 = 0")
    return e.selectExpr("event_id as detection_id", "ts", "42.0D + 0.02D * ((event_id div 10) % 10) as lat", "28.0D + 0.025D * ((event_id div 100) % 10) as lon")


POS = """pos as (select event_id, 200000000 + user_id as mmsi, ts, epoch_us(ts) as t,
    42.0::double + 0.02::double * (user_id % 10) + 0.001::double * (event_id % 7) as lat,
    28.0::double + 0.025::double * ((user_id // 10) % 10) + 0.001::double * (event_id % 5) as lon from events where event_id % 10 <> 0)"""
DET = """det as (select event_id as detection_id, ts, epoch_us(ts) as t, 42.0::double + 0.02::double * ((event_id // 10) % 10) as lat,
    28.0::double + 0.025::double * ((event_id // 100) % 10) as lon from events where event_id % 10 = 0)"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of the great-circle distance."""
    return f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def near(circle: bool = True) -> str:
    """SQL of the pairs of a detection and a report near it, as the plain range join."""
    ring = f"and {km('d.lat', 'd.lon', 'p.lat', 'p.lon')} <= 5" if circle else ""
    return f"""near as (select d.detection_id, d.t as d_t, d.lat as d_lat, d.lon as d_lon, p.mmsi, p.t, p.lat, p.lon, p.event_id from det d join pos p
        on p.t between d.t - 1200000000 and d.t + 1200000000 and p.lat between d.lat - 5 / 111.0 and d.lat + 5 / 111.0
        and p.lon between d.lon - 5 / (111.0 * cos(radians(d.lat))) and d.lon + 5 / (111.0 * cos(radians(d.lat))) {ring})"""


CANDIDATES = f"""ends as (select detection_id, mmsi, any_value(d_t) as d_t, any_value(d_lat) as d_lat, any_value(d_lon) as d_lon,
        max(t) filter (where t <= d_t) as t0, min(t) filter (where t >= d_t) as t1, min(abs(t - d_t)) as apart, count(*) as n_reports from near group by detection_id, mmsi),
    placed as (select e.detection_id, e.mmsi, e.d_lat, e.d_lon, e.t0, e.t1, e.n_reports,
        case when e.t0 is not null and e.t1 is not null and e.t0 <> e.t1 then 0.0::double else e.apart / 1e6 end as gap_s,
        case when e.t0 is not null and e.t1 is not null and e.t0 <> e.t1 then a.lat + (b.lat - a.lat) * ((e.d_t - e.t0) / (e.t1 - e.t0)::double) else c.lat end as lat,
        case when e.t0 is not null and e.t1 is not null and e.t0 <> e.t1 then a.lon + (b.lon - a.lon) * ((e.d_t - e.t0) / (e.t1 - e.t0)::double) else c.lon end as lon
        from ends e left join pos a on a.mmsi = e.mmsi and a.t = e.t0 left join pos b on b.mmsi = e.mmsi and b.t = e.t1
        join (select n.detection_id, n.mmsi, n.lat, n.lon, row_number() over (partition by n.detection_id, n.mmsi order by abs(n.t - n.d_t), n.t) as k from near n) c
            on c.detection_id = e.detection_id and c.mmsi = e.mmsi and c.k = 1),
    cand as (select detection_id, mmsi, {km('d_lat', 'd_lon', 'lat', 'lon')} as distance_km, gap_s, lat, lon from placed where gap_s <= 900)"""


def with_views(*views: str) -> str:
    return "with " + ", ".join(views)
