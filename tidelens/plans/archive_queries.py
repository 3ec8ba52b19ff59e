"""The archive: typing texts, statistics, merging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import text
from tidelens.operators import archive
from tidelens.plans.adapter import DET, POS, detections, events, positions, with_views
from tidelens.plans.registry import query
from tidelens.sources import sources


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Reports as the archive's import left them: texts, with NULL for no value, and some that cannot be read."""
    e = positions(spark, d)
    hour = F.date_format("ts", "H")
    stamp = F.when(F.col("event_id") % 13 == 0, "garbage").when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "dd/MM/yyyy "), hour, F.date_format("ts", ":mm"))).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm"))
    some = lambda k, value: F.when(F.col("event_id") % k == 0, "NULL").otherwise(value)
    return e.select("event_id", some(17, F.col("mmsi").cast("string")).alias("mmsi"), stamp.alias("ts"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), some(3, (F.col("event_id") % 30).cast("string")).alias("sog"), F.lit("268").alias("cog"), F.lit("NULL").alias("heading"), F.lit("0").alias("nav_status"))


_TYPED = "typed as (select event_id, case when event_id % 17 = 0 then 0 else mmsi end as mmsi, date_trunc('minute', ts) as ts, lat, lon, case when event_id % 3 <> 0 then cast(event_id % 30 as double) end as sog from pos where event_id % 13 <> 0)"


@query(f"{with_views(POS, _TYPED)} select mmsi, ts, round(lat, 6) as lat, round(lon, 6) as lon, coalesce(sog, -1) as sog, cast(268 as double) as cog, true as no_heading from typed")
def text_ts_parse(spark: SparkSession, d: str) -> DataFrame:
    t = archive.typed_positions(_landed(spark, d))
    return t.select("mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("sog", F.lit(-1.0)).alias("sog"), "cog", F.col("heading").isNull().alias("no_heading"))


@query(f"{with_views(POS, _TYPED)} select count(*) as n_rows, min(ts) as oldest, max(ts) as newest from typed")
def archive_text_span(spark: SparkSession, d: str) -> DataFrame:
    s = archive.archive_stats(archive.typed_positions(_landed(spark, d)))
    return s.select(F.col("rows").alias("n_rows"), F.col("oldest").cast("timestamp_ntz").alias("oldest"), F.col("newest").cast("timestamp_ntz").alias("newest"))


@query(f"{with_views(POS)} select count(*) as n_rows, min(ts) as oldest, max(ts) as newest from pos")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    s = archive.archive_stats(positions(spark, d))
    return s.select(F.col("rows").alias("n_rows"), F.col("oldest").cast("timestamp_ntz").alias("oldest"), F.col("newest").cast("timestamp_ntz").alias("newest"))


@query("select cast(sum(n_nationkey + 1 + length(n_name) + 1) as bigint) as bytes from nation")
def archive_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The size of a text archive in several files, each row of which has a known length: the key's as many x, the name."""
    from tidelens.sources.folders import shared_folder

    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.repeat(F.lit("x"), F.col("n_nationkey").cast("int")), F.lit("/"), "n_name").alias("value"))
    lines.repartition(3).write.text(folder)
    return archive.archive_bytes(spark.read.text(folder))


@query(f"""{with_views(DET)}, minutes as (select detection_id, unnest(generate_series(date_trunc('minute', ts - interval 20 minutes), ts + interval 20 minutes, interval 1 minute)) as m from det)
select detection_id, strftime(m, '%d/%m/%Y %H:%M') as key from minutes union all select detection_id, strftime(m, '%d/%m/%Y %-H:%M') as key from minutes where hour(m) < 10""")
def minute_keys(spark: SparkSession, d: str) -> DataFrame:
    return archive.minute_keys(detections(spark, d))


@query(f"{with_views(POS)} select event_id, mmsi, ts from pos where lat between 42.05 and 42.15 and lon between 28.0 and 28.1 and ts between timestamp '2024-01-03' and timestamp '2024-01-20'")
def positions_in_box(spark: SparkSession, d: str) -> DataFrame:
    return archive.positions_in_box(positions(spark, d), (42.05, 28.0), (42.15, 28.1), "2024-01-03", "2024-01-20").select("event_id", "mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"))


_BATCHES = "old as (select mmsi, date_trunc('hour', ts) as ts, min(event_id) as event_id from pos where event_id % 3 = 1 group by 1, 2), batch as (select mmsi, date_trunc('hour', ts) as ts, min(event_id) as event_id from pos where event_id % 3 <> 1 group by 1, 2)"


@query(f"{with_views(POS, _BATCHES)} select mmsi, ts, event_id from batch b where not exists (select 1 from old o where o.mmsi = b.mmsi and o.ts = b.ts)")
def insert_ignore_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select("mmsi", F.date_trunc("hour", "ts").alias("ts"), "event_id")
    new = archive.insert_ignore(rows.filter("event_id % 3 = 1"), rows.filter("event_id % 3 <> 1"))
    return new.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _vessels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, " ").otherwise(F.col("c_name"))
    day = lambda k: F.timestamp_seconds(1700000000 + k * F.col("c_custkey"))
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("mmsi"), F.lit("old").alias("name"), (F.col("c_custkey") % 7).cast("int").alias("ship_type"), day(60).alias("first_seen"), day(90).alias("last_seen"))
    new = c.filter("c_custkey % 2 = 0 or c_custkey % 4 = 1").select(F.col("c_custkey").alias("mmsi"), name.alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.lit(70)).alias("ship_type"), day(30 + 0).alias("seen_at"))
    return old, new


def _merged_sql(blank: str) -> str:
    return f"""with old as (select c_custkey as mmsi, 'old' as name, c_custkey % 7 as ship_type, 1700000000 + 60 * c_custkey as f, 1700000000 + 90 * c_custkey as l from customer where c_custkey % 3 <> 0),
    new as (select c_custkey as mmsi, case c_custkey % 4 when 0 then null when 1 then {blank} else c_name end as name, case when c_custkey % 5 <> 0 then 70 end as ship_type, 1700000000 + 30 * c_custkey as s from customer where c_custkey % 2 = 0 or c_custkey % 4 = 1)
    select coalesce(o.mmsi, n.mmsi) as mmsi, coalesce(n.name, o.name, '?') as name, cast(coalesce(n.ship_type, o.ship_type, -1) as integer) as ship_type, least(o.f, n.s) as first_s, greatest(o.l, n.s) as last_s from old o full join new n on o.mmsi = n.mmsi"""


def _merged(merged: DataFrame) -> DataFrame:
    return merged.select("mmsi", F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("ship_type", F.lit(-1)).alias("ship_type"), F.unix_seconds("first_seen").alias("first_s"), F.unix_seconds("last_seen").alias("last_s"))


@query(_merged_sql("' '"))
def vessel_upsert_keep_blank(spark: SparkSession, d: str) -> DataFrame:
    return _merged(archive.merge_vessels(*_vessels(spark, d), keep_blank=True))


@query(_merged_sql("null"))
def vessel_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _merged(archive.merge_vessels(*_vessels(spark, d), keep_blank=False))


@query(f"{with_views(POS)} select mmsi, date_trunc('minute', ts) as ts, max(event_id) as event_id from pos group by 1, 2")
def position_minute_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select("mmsi", "ts", "event_id", F.col("event_id").alias("order"))
    return archive.last_in_minute(rows, "order").select("mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query(f"{with_views(POS)} select mmsi, max(event_id) as event_id, arg_max(case when event_id % 2 = 0 then 'x' else '-' end, event_id) as name from pos group by mmsi")
def vessel_last_record(spark: SparkSession, d: str) -> DataFrame:
    rows = positions(spark, d).select("mmsi", "event_id", F.when(F.col("event_id") % 2 == 0, "x").alias("name"), F.col("event_id").alias("order"))
    return archive.last_record(rows, "order").select("mmsi", "event_id", F.coalesce("name", F.lit("-")).alias("name"))


@query(f"{with_views(POS)} select event_id, strftime(ts + interval 2 hours, '%d/%m/%Y %H:%M') as local, date_trunc('minute', ts) as back from pos")
def archive_zone_round_trip(spark: SparkSession, d: str) -> DataFrame:
    zone = "Europe/Sofia"  # two hours ahead of UTC in winter
    local = positions(spark, d).select("event_id", text.format_archive_stamp(F.col("ts"), zone).alias("local"))
    return local.select("event_id", "local", text.parse_archive_stamp(F.col("local"), zone).cast("timestamp_ntz").alias("back"))


@query(f"{with_views(POS)} select count(*) as n, count(distinct mmsi) as vessels from pos")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """Reports by the name of a source."""
    events_at = f"{d}/events.parquet"
    found = sources.open_positions(spark, "parquet", path=events_at, select=("200000000 + user_id as mmsi", "cast(ts as timestamp) as ts", "0.0D as lat", "0.0D as lon"), where="event_id % 10 <> 0")
    return found.agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by event_type")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))
