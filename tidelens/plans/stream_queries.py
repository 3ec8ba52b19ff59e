"""The collector over messages built from events."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.plans.adapter import POS, events, positions, with_views
from tidelens.plans.registry import query
from tidelens.streaming import collector


def _position_lines(spark: SparkSession, d: str) -> DataFrame:
    """seq, arrived, value: a message for each report, some with the values for no value, and lines that say nothing."""
    n = F.col("event_id")
    report = F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.when(n % 3 == 0, 102.3).otherwise((n % 30).cast("double")).alias("Sog"), F.when(n % 4 == 0, 360.0).otherwise((n % 360).cast("double")).alias("Cog"), F.when(n % 5 == 0, 511.0).otherwise(90.0).alias("TrueHeading"), F.lit(0).alias("NavigationalStatus"))
    meta = F.when(n % 11 != 0, F.struct(F.col("mmsi").alias("MMSI"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_utc")))
    kind = F.when(n % 13 == 0, "Other").otherwise("PositionReport")
    line = F.when(n % 17 == 0, "{no json").otherwise(F.to_json(F.struct(kind.alias("MessageType"), meta.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))))
    return positions(spark, d).select(n.alias("seq"), F.col("ts").alias("arrived"), line.alias("value"))


def _static_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    data = F.struct(F.concat(F.lit(" ship "), (n % 9).cast("string"), F.lit(" ")).alias("Name"), F.lit("").alias("CallSign"), n.alias("ImoNumber"), F.lit(70).alias("Type"), F.struct((n % 100).cast("double").alias("A"), F.lit(20.0).alias("B"), F.lit(10.0).alias("C"), F.lit(None).cast("double").alias("D")).alias("Dimension"))
    line = F.to_json(F.struct(F.lit("ShipStaticData").alias("MessageType"), F.struct((F.col("user_id") + 200000000).alias("MMSI")).alias("MetaData"), F.struct(data.alias("ShipStaticData")).alias("Message")))
    return events(spark, d).filter("event_id % 10 = 5").select(n.alias("seq"), F.col("ts").alias("arrived"), line.alias("value"))


_GOOD = "good as (select * from pos where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0)"
_VALUES = "coalesce(case when event_id % 3 <> 0 then event_id % 30 end, -1)::double as sog, coalesce(case when event_id % 4 <> 0 then event_id % 360 end, -1)::double as cog, case when event_id % 5 = 0 then -1 else 90 end::double as heading"


@query(f"{with_views(POS, _GOOD)} select event_id as seq, mmsi, ts, round(lat, 6) as lat, {_VALUES} from good")
def ais_parse_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = collector.positions_of(collector.messages(_position_lines(spark, d)), F.col("arrived"))
    none = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return rows.select("seq", "mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lat", 6).alias("lat"), none("sog"), none("cog"), none("heading"))


@query("select event_id as seq, 200000000 + user_id as mmsi, 'ship ' || (event_id % 9) as name, '' as callsign, event_id as imo, cast(event_id % 100 + 20 as double) as length_m, true as no_width from events where event_id % 10 = 5")
def ais_parse_static(spark: SparkSession, d: str) -> DataFrame:
    rows = collector.vessels_of(collector.messages(_static_lines(spark, d)), F.col("arrived"))
    return rows.select("seq", "mmsi", "name", "callsign", "imo", "length_m", F.col("width_m").isNull().alias("no_width"))


@query(f"{with_views(POS, _GOOD)} select event_id % 3 = 0 as no_sog, event_id % 4 = 0 as no_cog, event_id % 5 = 0 as no_heading, count(*) as n from good group by 1, 2, 3")
def ais_sentinels(spark: SparkSession, d: str) -> DataFrame:
    rows = collector.positions_of(collector.messages(_position_lines(spark, d)), F.col("arrived"))
    return rows.groupBy(*(F.col(c).isNull().alias(f"no_{c}") for c in ("sog", "cog", "heading"))).agg(F.count("*").alias("n"))


@query(f"{with_views(POS, _GOOD)} select mmsi, date_trunc('minute', ts) as ts, arg_max(event_id, event_id) as seq_seen, arg_max(round(lat, 6), event_id) as lat from good group by 1, 2".replace("arg_max(event_id, event_id) as seq_seen, ", ""))
def stream_collector(spark: SparkSession, d: str) -> DataFrame:
    """Messages through a file stream into the collector's tables, and the archive read back."""
    from tidelens.sources.folders import shared_folder

    folder = f"{shared_folder(spark)}/collector-{uuid.uuid4().hex}"
    _position_lines(spark, d).unionByName(_static_lines(spark, d)).write.parquet(f"{folder}/in")
    raw = spark.readStream.schema("seq bigint, arrived timestamp, value string").parquet(f"{folder}/in")
    sink = collector.Collector(spark, f"{folder}/out")
    q = sink.start(raw, f"{folder}/checkpoint", every=None)
    q.awaitTermination()
    return sink.positions().select("mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lat", 6).alias("lat"))


@query(f"{with_views(POS)} select started, ended, cast(messages as bigint) as messages from (select min(ts) as started, max(ts) as ended, count(*) as messages from (select ts, sum(case when gap > 3600 or gap is null then 1 else 0 end) over (order by ts rows unbounded preceding) as k from (select ts, epoch(ts) - epoch(lag(ts) over (order by ts)) as gap from pos) as a) as b group by k) as c")
def coverage_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of listening, told from gaps of an hour between reports."""
    found = collector.sessions_of(positions(spark, d))
    return found.select(F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "messages")


_SESSIONS = "bounds as (select epoch_us(min(ts)) as lo, epoch_us(max(ts)) as hi from pos), told as (select ts, case when epoch_us(ts) <= lo + (hi - lo) // 3 then 0 when epoch_us(ts) >= hi - (hi - lo) // 3 then 1 end as session from pos, bounds)"


@query(f"{with_views(POS, _SESSIONS)} select min(ts) as started_at, max(ts) as last_message_at, case when session = 0 then max(ts) end as ended_at, count(*) as messages from told where session is not null group by session")
def coverage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of two runs with nobody listening between: the first has two flushes and is closed, the second repeats
    one of these, as after a failure, and is open."""
    from tidelens.sources.folders import shared_folder

    lines = _position_lines(spark, d)
    t = F.unix_micros("arrived")
    low, high = lines.agg(F.min(t), F.max(t)).first()
    third = (high - low) // 3
    first, second = lines.filter(t <= low + third), lines.filter(t >= high - third)
    sink = collector.Collector(spark, f"{shared_folder(spark)}/collector-{uuid.uuid4().hex}", idle_seconds=None)
    for number in range(2):
        sink.flush(first.filter(F.col("seq") % 2 == number), number)
    sink.close(first.agg(F.max("arrived")).first()[0])
    sink = collector.Collector(spark, sink.folder, idle_seconds=None)
    sink.flush(first.filter(F.col("seq") % 2 == 1), 1)
    sink.flush(second, 2)
    times = (F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "last_message_at", "ended_at"))
    return sink.coverage().select(*times, "messages")


_SILENCES = "numbered as (select ts, sum(case when epoch_us(ts) - before > 120000000 then 1 else 0 end) over (order by ts rows unbounded preceding) as k from (select ts, lag(epoch_us(ts)) over (order by ts) as before from pos) as a)"


@query(f"{with_views(POS, _SILENCES)} select min(ts) as started_at, max(ts) as last_message_at, max(ts) + interval 120 seconds as ended_at, count(*) as messages from numbered group by k")
def coverage_idle(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of one run that is closed long after its last message: 120 seconds of silence end each of its rows."""
    from tidelens.sources.folders import shared_folder

    lines = _position_lines(spark, d)
    first, last = lines.agg(F.min("arrived"), F.max("arrived")).first()
    sink = collector.Collector(spark, f"{shared_folder(spark)}/collector-{uuid.uuid4().hex}")
    sink.open(first)
    for number in range(2):
        sink.flush(lines.filter(F.col("seq") % 2 == number), number)
    sink.close(last + timedelta(days=9))
    times = (F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "last_message_at", "ended_at"))
    return sink.coverage().select(*times, "messages")


#: Files, and so tasks at least, of a flush of collector_status.
FLUSH_FILES = 32


@query(f"{with_views(POS, _GOOD)} select 1 as sessions, (select count(*) from pos) + (select count(*) from events where event_id % 10 = 5) as messages, (select count(*) from (select distinct mmsi, date_trunc('minute', ts) from good)) as rows_written, true as running, greatest((select max(ts) from pos), (select max(ts) from events where event_id % 10 = 5)) as last_message_at")
def collector_status(spark: SparkSession, d: str) -> DataFrame:
    """What the collector tells of itself after a stream of four flushes: lines that came, and rows that were written."""
    from tidelens.sources.folders import shared_folder

    folder = f"{shared_folder(spark)}/collector-{uuid.uuid4().hex}"
    lines = _position_lines(spark, d).unionByName(_static_lines(spark, d))
    # four batches of many files each, so that no task has a quarter of all lines
    lines.repartitionByRange(4 * FLUSH_FILES, "arrived").write.parquet(f"{folder}/in")
    raw = spark.readStream.schema("seq bigint, arrived timestamp, value string").option("maxFilesPerTrigger", FLUSH_FILES).parquet(f"{folder}/in")
    sink = collector.Collector(spark, f"{folder}/out", late="400 days")
    sink.start(raw, f"{folder}/checkpoint", every=None).awaitTermination()
    told = sink.status()
    return told.agg(F.count("*").cast("int").alias("sessions"), F.sum("messages").alias("messages"), F.sum("rows_written").alias("rows_written"), F.bool_and("running").alias("running"), F.max("last_message_at").cast("timestamp_ntz").alias("last_message_at"))


@query(f"{with_views(POS, _GOOD)} select mmsi, date_trunc('minute', ts) as ts from good group by 1, 2")
def event_time_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Reports by the time that messages carry, one for each vessel and minute, through a stream."""
    from tidelens.sources.folders import shared_folder

    folder = f"{shared_folder(spark)}/event-time-{uuid.uuid4().hex}"
    _position_lines(spark, d).select("value").write.parquet(f"{folder}/in")
    stream = collector.event_time_positions(spark.readStream.schema("value string").parquet(f"{folder}/in"))
    q = stream.select("mmsi", "ts").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema("mmsi bigint, ts timestamp").parquet(f"{folder}/out").select("mmsi", F.col("ts").cast("timestamp_ntz").alias("ts"))


_HOSTS = "numbered as (select host, ts, sum(case when epoch_us(ts) - before >= 3600000000 then 1 else 0 end) over (partition by host order by ts rows unbounded preceding) as k from (select event_id % 2 as host, ts, lag(epoch_us(ts)) over (partition by event_id % 2 order by ts) as before from pos) as a)"


@query(f"{with_views(POS, _HOSTS)} select 'host ' || host as host, min(ts) as started, max(ts) + interval 1 hour as ended, max(ts) as last_message_at, count(*) as messages from numbered group by host, k having max(ts) + interval 1 hour <= (select max(ts) from pos)")
def coverage_sessions_live(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of two hosts' messages tells of each hour-long silence: all sessions that are over by the last message."""
    from tidelens.sources.folders import shared_folder

    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    _position_lines(spark, d).select(F.concat(F.lit("host "), (F.col("seq") % 2).cast("string")).alias("host"), "arrived").write.parquet(f"{folder}/in")
    stream = collector.live_sessions(spark.readStream.schema("host string, arrived timestamp").parquet(f"{folder}/in"), 3600, late="0 seconds")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    rows = spark.read.schema("host string, started timestamp, ended timestamp, last_message_at timestamp, messages long").parquet(f"{folder}/out")
    return rows.select("host", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended", "last_message_at")), "messages")
