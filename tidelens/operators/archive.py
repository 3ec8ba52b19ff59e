"""The archive of positions and vessels: typing, merging, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.text import lenient_double, lenient_long, parse_archive_stamp

LANDED = "mmsi string, ts string, lat string, lon string, sog string, cog string, heading string, nav_status string"


def typed_positions(landed: DataFrame, zone: str = "UTC") -> DataFrame:
    """The archive's texts as types. A number that cannot be read is null, and an mmsi that cannot be read is 0; a row
    without a readable time or place is dropped."""
    rows = landed.select(F.coalesce(lenient_long(F.col("mmsi")), F.lit(0)).cast("long").alias("mmsi"), parse_archive_stamp(F.col("ts"), zone).alias("ts"), *(lenient_double(F.col(c)).alias(c) for c in ("lat", "lon", "sog", "cog", "heading")))
    return rows.filter("ts is not null and lat is not null and lon is not null")


def minute_keys(detections: DataFrame, window_minutes: float = 20, most: int = 2880) -> DataFrame:
    """detection_id and key: the stamps, as the text archive writes them, of each minute of a detection's window; those
    before ten o'clock also with one digit. Only for archives that have to be asked by text; `most` keys at most."""
    half = F.expr(f"interval {int(window_minutes * 60)} seconds")
    minutes = F.sequence(F.date_trunc("minute", F.col("ts") - half), F.col("ts") + half, F.expr("interval 1 minute"))
    keys = F.flatten(F.transform(minutes, lambda m: F.array_distinct(F.array(F.date_format(m, "dd/MM/yyyy HH:mm"), F.date_format(m, "dd/MM/yyyy H:mm")))))
    return detections.select("detection_id", F.explode(F.slice(keys, 1, most)).alias("key"))


def positions_in_box(positions: DataFrame, low: tuple[float, float], high: tuple[float, float], since: str, until: str) -> DataFrame:
    """Reports of a closed box and time range given as literals, which go down to the scan."""
    return positions.filter(F.col("lat").between(low[0], high[0]) & F.col("lon").between(low[1], high[1]) & F.col("ts").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def archive_stats(positions: DataFrame) -> DataFrame:
    """One row: rows (exact), oldest, newest; times are null for an empty archive."""
    return positions.agg(F.count("*").alias("rows"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def archive_bytes(stored: DataFrame) -> DataFrame:
    """One row: bytes of the files that a file-based table is read from; null if it has none."""
    return stored.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("bytes"))


def insert_ignore(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of batch that the archive does not have yet, by mmsi and ts: the first one written stays. Of several in
    the batch the one that sorts first by its other columns is taken."""
    rest = [c for c in batch.columns if c not in ("mmsi", "ts")]
    one = batch.groupBy("mmsi", "ts").agg(F.min(F.struct(*rest)).alias("r")).select("mmsi", "ts", "r.*")
    return one.join(archive.select("mmsi", "ts"), ["mmsi", "ts"], "left_anti")


def merge_vessels(vessels: DataFrame, updates: DataFrame, keep_blank: bool = True) -> DataFrame:
    """The vessel table after updates (one row for each mmsi, with seen_at): each attribute that an update has replaces
    the old one; first_seen and last_seen widen. keep_blank: whether a blank text counts as a value."""
    attributes = [c for c in updates.columns if c not in ("mmsi", "seen_at")]
    texts = {c for c, kind in updates.dtypes if kind == "string"}

    def value(c: str) -> Column:
        new = F.col(f"u.{c}")
        return new if keep_blank or c not in texts else F.when(F.trim(new) != "", new)

    joined = vessels.alias("v").join(updates.alias("u"), F.col("v.mmsi") == F.col("u.mmsi"), "full")
    return joined.select(
        F.coalesce("v.mmsi", "u.mmsi").alias("mmsi"),
        *(F.coalesce(value(c), F.col(f"v.{c}")).alias(c) for c in attributes),
        F.least("v.first_seen", "u.seen_at").alias("first_seen"),
        F.greatest("v.last_seen", "u.seen_at").alias("last_seen"),
    )


def last_in_minute(reports: DataFrame, order: str) -> DataFrame:
    """One report for each vessel and minute: the last by `order`; its time is the minute."""
    rest = [c for c in reports.columns if c not in ("mmsi", "ts", order)]
    minute = F.date_trunc("minute", F.col("ts")).alias("ts")
    return reports.groupBy("mmsi", minute).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select("mmsi", "ts", "r.*")


def last_record(records: DataFrame, order: str) -> DataFrame:
    """The whole last record of each vessel by `order`, nulls included."""
    rest = [c for c in records.columns if c not in ("mmsi", order)]
    return records.groupBy("mmsi").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select("mmsi", "r.*")
