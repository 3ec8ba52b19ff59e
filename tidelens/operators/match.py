"""Detections against position reports: candidates, tracks, coverage, status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StructField, StructType

from tidelens.functions.geo import half_height, half_width, haversine_km
from tidelens.operators.meetings import in_cells, told_best, told_places, told_ranks, told_tracks

MATCHED, DARK, UNKNOWN = "Matched", "Dark", "UnknownNoCoverage"


@dataclass(frozen=True)
class Params:
    """window: how far reports may lie from the detection in time. radius: and in space. match: up to which distance the
    nearest vessel matches. gap: how old a report may be that is not one of two around the detection. slack: how far
    from the detection coverage may lie. circle: whether reports in the corners of the box around the circle are out."""

    window_minutes: float = 20
    radius_km: float = 5
    match_km: float = 1
    gap_s: float = 900
    slack_minutes: float = 5
    circle: bool = True


def require_instants(detections: DataFrame) -> DataFrame:
    """A time without a zone is not a moment, so it is refused."""
    kind = dict(detections.dtypes)["ts"]
    if kind != "timestamp":
        raise ValueError(f"detections need instants (timestamp), not {kind}")
    return detections


#: Cells of the candidate join that are split at most; there cannot be more than rows / hot_rows of them anyway.
HOT_CELLS = 1000
_CELL = ("when_cell", "lat_cell", "lon_cell")
#: How many boxes a cell is high and wide: of smaller cells a detection meets more, of larger ones it meets more reports in vain.
CELL_BOXES = 4


def _cell(x: Column, size: Column | float) -> Column:
    return F.floor(x / size).cast("long")


def _lon_size(lat_cell: Column, height: float, radius_km: float) -> Column:
    """How wide the cells of a band of latitude are, in degrees: some boxes as wide as these are at the band's edge nearer to a pole."""
    edge = F.greatest(F.abs(lat_cell * height), F.abs((lat_cell + 1) * height))
    return F.least(CELL_BOXES * 2 * half_width(F.least(edge, F.lit(90.0)), radius_km), F.lit(360.0))


def _hot(reports: DataFrame, hot_rows: int) -> DataFrame:
    """The cells with more than hot_rows reports, and into how many parts they are split."""
    counts = reports.groupBy(*_CELL).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    return counts.orderBy(F.desc("n")).limit(HOT_CELLS).select(*_CELL, F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))


def candidate_reports(detections: DataFrame, positions: DataFrame, p: Params = Params(), carry: tuple[str, ...] = (), hot_rows: int | None = None) -> DataFrame:
    """Every report near a detection: closed window in time, closed box, and the circle unless p.circle is false.

    detections: detection_id, ts, lat, lon. positions: mmsi, ts, lat, lon, and the columns of carry, which the result has
    too. Both sides meet on equal cells of time and place, so the join is hashed and shuffled by cell and grows with the
    pairs that are near. Cells are as long as the window and some boxes large, so a detection is repeated for
    three of time and one to four of place; a report has one cell, so no pair comes twice. With hot_rows, a cell with more reports, as of
    a busy port, is split: its reports are dealt to parts, and its detections repeated for each. That reads the reports
    once more to count cells; without it, adaptive execution splits what is large in bytes. Reports without a time or place are left out.
    """
    w = int(p.window_minutes * 60_000_000)
    up, across = half_height(p.radius_km), half_width(F.col("d_lat"), p.radius_km)
    height = CELL_BOXES * 2 * up
    d = detections.select("detection_id", F.unix_micros("ts").alias("d_t"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    d = d.filter("d_t is not null and d_lat is not null and d_lon is not null")
    d = d.select("*", F.explode(F.sequence(F.floor((F.col("d_t") - w) / w), F.floor((F.col("d_t") + w) / w))).alias("when_cell"))
    # beyond the limits of the globe there are no cells worth a row
    d = d.select("*", F.explode(F.sequence(_cell(F.greatest(F.col("d_lat") - up, F.lit(-91.0)), height), _cell(F.least(F.col("d_lat") + up, F.lit(91.0)), height))).alias("lat_cell"))
    wide = _lon_size(F.col("lat_cell"), height, p.radius_km)
    d = d.select("*", F.explode(F.sequence(_cell(F.greatest(F.col("d_lon") - across, F.lit(-181.0)), wide), _cell(F.least(F.col("d_lon") + across, F.lit(181.0)), wide))).alias("lon_cell"))
    r = positions.select("mmsi", F.unix_micros("ts").alias("t"), "lat", "lon", *carry).filter("t is not null and lat is not null and lon is not null")
    r = r.select("*", F.floor(F.col("t") / w).alias("when_cell"), _cell(F.col("lat"), height).alias("lat_cell"))
    r = r.withColumn("lon_cell", _cell(F.col("lon"), _lon_size(F.col("lat_cell"), height, p.radius_km)))
    key = list(_CELL)
    if hot_rows is not None:
        hot = F.broadcast(_hot(r, hot_rows))  # HOT_CELLS rows at most
        parts = F.coalesce("parts", F.lit(1))
        d = d.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        r = r.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("mmsi", "t"), parts).cast("int")).drop("parts")
        key.append("part")
    near = F.col("t").between(F.col("d_t") - w, F.col("d_t") + w) & F.col("lat").between(F.col("d_lat") - up, F.col("d_lat") + up) & F.col("lon").between(F.col("d_lon") - across, F.col("d_lon") + across)
    if p.circle:
        near = near & (haversine_km(F.col("d_lat"), F.col("d_lon"), F.col("lat"), F.col("lon")) <= p.radius_km)
    return d.join(r, key).filter(near).select("detection_id", "d_t", "d_lat", "d_lon", "mmsi", "t", "lat", "lon", *carry)


def tracks(reports: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each detection and vessel: before, the last report up to the detection's time; after, the first from then on;
    nearest, the one nearest in time, the earlier of two. Reports of one vessel at one time are taken by place, and then
    by the columns of carry, which the three have too."""
    at = F.struct("t", "lat", "lon", *carry)
    return reports.groupBy("detection_id", "mmsi").agg(
        F.first("d_t").alias("d_t"),
        F.first("d_lat").alias("d_lat"),
        F.first("d_lon").alias("d_lon"),
        F.max(F.when(F.col("t") <= F.col("d_t"), at)).alias("before"),
        F.min(F.when(F.col("t") >= F.col("d_t"), at)).alias("after"),
        F.min(F.struct(F.abs(F.col("t") - F.col("d_t")).alias("apart"), "t", "lat", "lon", *carry)).alias("nearest"),
        F.count("*").alias("n_reports"),
    )


#: How many windows the cells are long in which detections and vessels meet.
CELL_WINDOWS = 12
#: Cells are met a little beyond what is near, so that rounding leaves no report out.
_BEYOND = 1 + 1e-9
#: How many reports, and how many detections times reports, a task takes of a cell before it is split by time.
CELL_REPORTS, CELL_PAIRS = 2_000_000, 20_000_000_000


def _split(d: DataFrame, r: DataFrame, most_pairs: int) -> DataFrame:
    """The cells with more reports or pairs than a task should have, and into how many parts of their time they are split: of
    parts shorter than half a window a report would be in too many."""
    met = d.groupBy(*_CELL).agg(F.count("*").alias("n_d")).join(r.groupBy(*_CELL).agg(F.count("*").alias("n_r")), list(_CELL))
    parts = F.ceil(F.greatest(F.col("n_r") / CELL_REPORTS, F.col("n_d") * F.col("n_r") / most_pairs, F.lit(1.0)))
    return met.select(*_CELL, F.least(parts, F.lit(2 * CELL_WINDOWS)).cast("long").alias("parts")).filter("parts > 1")


def _meetings(detections: DataFrame, positions: DataFrame, p: Params, carry: tuple[str, ...] = (), most_pairs: int = CELL_PAIRS) -> GroupedData:
    """Detections (where across is not null) and the reports that can be near them, by cell, for in_cells(), without a shuffle of pairs.

    Here a detection has one cell, and a report is repeated for those whose detections it can be near: a little more than one of
    time on average and one to four of place. So what is shuffled grows with the reports, not with the pairs. Cells with very many of them are split.
    """
    w = int(p.window_minutes * 60_000_000)
    up, height = half_height(p.radius_km), CELL_BOXES * 2 * half_height(p.radius_km)
    length = CELL_WINDOWS * w
    wide = _lon_size(F.col("lat_cell"), height, p.radius_km)
    cells = lambda name, x, reach, size: F.explode(F.sequence(_cell(x - reach, size), _cell(x + reach, size))).alias(name)

    d = detections.select("detection_id", F.unix_micros("ts").alias("t"), "lat", "lon").filter("t is not null and lat is not null and lon is not null")
    d = d.select("*", half_width(F.col("lat"), p.radius_km).alias("across"), _cell(F.col("t"), length).alias("when_cell"), _cell(F.col("lat"), height).alias("lat_cell"))
    d = d.withColumn("lon_cell", _cell(F.col("lon"), wide))

    r = positions.select("mmsi", F.unix_micros("ts").alias("t"), "lat", "lon", *carry).filter("t is not null and lat is not null and lon is not null")
    r = r.select("*", cells("when_cell", F.col("t"), w, length))
    r = r.select("*", cells("lat_cell", F.col("lat"), up * _BEYOND, height))
    # a detection of the band reaches at most as far as one at the band's edge, and no further than round the globe
    edge = F.greatest(F.abs(F.col("lat_cell") * height), F.abs((F.col("lat_cell") + 1) * height))
    r = r.select("*", cells("lon_cell", F.col("lon"), F.least(half_width(F.least(edge, F.lit(90.0)), p.radius_km) * _BEYOND, F.lit(360.0)), wide))

    split, parts = F.broadcast(_split(d, r, most_pairs)), F.coalesce("parts", F.lit(1))  # no more cells than there are reports / CELL_REPORTS or pairs / most_pairs
    part = lambda t: F.least(F.greatest(F.floor((t - F.col("when_cell") * length) * parts / length), F.lit(0)), parts - 1)
    d = d.join(split, list(_CELL), "left").withColumn("part", part(F.col("t"))).drop("parts")
    r = r.join(split, list(_CELL), "left").withColumn("part", F.explode(F.sequence(part(F.col("t") - w), part(F.col("t") + w)))).drop("parts")
    spark = d.sparkSession
    # as many as asked for, whatever they have in bytes: what they compute grows with the pairs
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return d.unionByName(r, allowMissingColumns=True).repartition(tasks, *_CELL, "part").groupBy(*_CELL, "part")


def _types(df: DataFrame, *names: str) -> dict[str, DataType]:
    return {name: df.schema[name].dataType for name in names}


def _told(met: GroupedData, columns: dict[str, DataType], tell: Callable, p: Params, carry: tuple[str, ...], *args) -> DataFrame:
    schema = StructType([StructField(name, kind) for name, kind in columns.items()])
    return met.applyInArrow(in_cells(tell, p, carry, list(columns), *args), schema)


_AT = {"gap_s": DoubleType(), "lat": DoubleType(), "lon": DoubleType()}
_D = {"d_lat": DoubleType(), "d_lon": DoubleType()}


def _away() -> Column:
    return haversine_km(F.col("d_lat"), F.col("d_lon"), F.col("lat"), F.col("lon")).alias("distance_km")


def track_ends(detections: DataFrame, positions: DataFrame, told: tuple[str, ...], p: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """detection_id, mmsi, n_reports and of what tracks() says the columns told, such as d_t, before_t or nearest_lat."""
    kinds = {"t": LongType(), "lat": DoubleType(), "lon": DoubleType()} | _types(positions, *carry)
    columns = _types(detections, "detection_id") | _types(positions, "mmsi") | {"n_reports": LongType()} | {c: kinds[c.split("_", 1)[1]] for c in told}
    return _told(_meetings(detections, positions, p, carry), columns, told_tracks, p, carry, told)


def tracks_near(detections: DataFrame, positions: DataFrame, p: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """What tracks() says of candidate_reports(), by _meetings(), so that pairs are not shuffled."""
    fields = ("t", "lat", "lon", *carry)
    found = track_ends(detections, positions, ("d_t", "d_lat", "d_lon", *(f"{end}_{c}" for end in ("before", "after", "nearest") for c in fields)), p, carry)
    at = lambda end: F.struct(*(F.col(f"{end}_{c}").alias(c) for c in fields))
    end = lambda name: F.when(F.col(f"{name}_t").isNotNull(), at(name)).alias(name)
    nearest = F.struct(F.abs(F.col("nearest_t") - F.col("d_t")).alias("apart"), *(F.col(f"nearest_{c}").alias(c) for c in fields)).alias("nearest")
    return found.select("detection_id", "mmsi", "d_t", "d_lat", "d_lon", end("before"), end("after"), nearest, "n_reports")


def candidates_near(detections: DataFrame, positions: DataFrame, p: Params = Params()) -> DataFrame:
    """candidates() by _meetings(), so that pairs are not shuffled."""
    columns = _types(detections, "detection_id") | _types(positions, "mmsi") | _AT | _D
    return _told(_meetings(detections, positions, p), columns, told_places, p, ()).select("detection_id", "mmsi", _away(), "gap_s", "lat", "lon")


def candidates(found: DataFrame, p: Params = Params(), more: tuple[str, ...] = ()) -> DataFrame:
    """detection_id, mmsi, distance_km, gap_s, lat, lon: where each vessel of tracks() was at the detection's time, and the columns of more. Between two
    reports it is interpolated, in degrees; else the nearest report stands for it, if it is at most p.gap_s away."""
    between = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before.t") != F.col("after.t"))
    share = (F.col("d_t") - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))

    def at(axis: str) -> Column:
        low = F.col(f"before.{axis}")
        return F.when(between, low + (F.col(f"after.{axis}") - low) * share).otherwise(F.col(f"nearest.{axis}"))

    placed = found.select("detection_id", "mmsi", "d_lat", "d_lon", F.when(between, 0.0).otherwise(F.col("nearest.apart") / 1e6).alias("gap_s"), at("lat").alias("lat"), at("lon").alias("lon"), *more)
    return placed.filter(F.col("gap_s") <= p.gap_s).select("detection_id", "mmsi", haversine_km(F.col("d_lat"), F.col("d_lon"), F.col("lat"), F.col("lon")).alias("distance_km"), "gap_s", "lat", "lon", *more)


def covered_by_reports(detections: DataFrame, positions: DataFrame, slack_minutes: float = 5) -> DataFrame:
    """detection_ids with any report, anywhere, within the slack.

    The reports are first brought down to the first and last of each interval as long as the slack. A detection's time
    then meets three intervals at most, and what it has to ask of each is its first or last report.
    """
    s = int(slack_minutes * 60_000_000)
    t = F.unix_micros("ts")
    spans = positions.select(t.alias("t")).filter("t is not null").groupBy(F.floor(F.col("t") / s).alias("cell")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    d = detections.select("detection_id", t.alias("t")).filter("t is not null")
    d = d.select("*", F.explode(F.sequence(F.floor((F.col("t") - s) / s), F.floor((F.col("t") + s) / s))).alias("cell"))
    return d.join(spans, "cell").filter((F.col("last") >= F.col("t") - s) & (F.col("first") <= F.col("t") + s)).select("detection_id").distinct()


def covered_by_ledger(detections: DataFrame, ledger: DataFrame, slack_minutes: float = 5) -> DataFrame:
    """detection_ids within the slack of a session of the ledger (started_at, last_message_at, ended_at); a session that
    has not ended lasts up to its last message. Both sides meet on days, so no side has to be broadcast."""
    s, day = int(slack_minutes * 60_000_000), 86_400_000_000
    days = lambda low, high: F.explode(F.sequence(F.floor(low / day), F.floor(high / day))).alias("day")
    sessions = ledger.select(F.unix_micros("started_at").alias("low"), F.unix_micros(F.coalesce("ended_at", "last_message_at", "started_at")).alias("high")).filter("low <= high")
    sessions = sessions.select("low", "high", days(F.col("low"), F.col("high")))
    d = detections.select("detection_id", F.unix_micros("ts").alias("t")).filter("t is not null")
    d = d.select("*", days(F.col("t") - s, F.col("t") + s))
    return d.join(sessions, "day").filter((F.col("low") <= F.col("t") + s) & (F.col("high") >= F.col("t") - s)).select("detection_id").distinct()


def match_detections(detections: DataFrame, positions: DataFrame, covered: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """One row for each detection: status, had_coverage, best and candidates (nearest first, ties to the smaller mmsi).

    covered: detection_ids that had coverage; without it, reports within p.slack_minutes are coverage. A match within
    p.match_km stands whether there was coverage or not; a best candidate is told also when it is too far to match.
    """
    detections = require_instants(detections)
    covered = covered_by_reports(detections, positions, p.slack_minutes) if covered is None else covered
    found = candidates_near(detections, positions, p)
    listed = found.groupBy("detection_id").agg(F.array_sort(F.collect_list(F.struct("distance_km", "mmsi", "gap_s", "lat", "lon"))).alias("candidates"))
    joined = detections.join(listed, "detection_id", "left").join(covered.withColumn("covered", F.lit(True)), "detection_id", "left")
    best = F.when(F.size("candidates") > 0, F.element_at("candidates", 1))
    status = F.when(best["distance_km"] <= p.match_km, MATCHED).when(F.col("covered"), DARK).otherwise(UNKNOWN)
    return joined.select("detection_id", status.alias("status"), F.coalesce("covered", F.lit(False)).alias("had_coverage"), best.alias("best"), F.coalesce("candidates", F.array().cast("array<struct<distance_km: double, mmsi: bigint, gap_s: double, lat: double, lon: double>>")).alias("candidates"))


def match_best(detections: DataFrame, positions: DataFrame, covered: DataFrame | None = None, p: Params = Params(), which: bool = True) -> DataFrame:
    """As match_detections(), with the best candidate and how many there are (n_candidates): nothing is listed or sorted on the way.
    Without which, the distance is all that best has."""
    detections = require_instants(detections)
    covered = covered_by_reports(detections, positions, p.slack_minutes) if covered is None else covered
    columns = _types(detections, "detection_id") | _types(positions, "mmsi") | _AT | _D | {"n_candidates": LongType()}
    found = _told(_meetings(detections, positions, p), columns, told_best, p, ()).withColumn("distance_km", _away())
    told = ("distance_km", "mmsi", "gap_s", "lat", "lon") if which else ("distance_km",)
    best = found.groupBy("detection_id").agg(F.min(F.struct(*told)).alias("best"), F.max("n_candidates").alias("n_candidates"))
    joined = detections.select("detection_id").join(best, "detection_id", "left").join(covered.withColumn("covered", F.lit(True)), "detection_id", "left")
    status = F.when(F.col("best.distance_km") <= p.match_km, MATCHED).when(F.col("covered"), DARK).otherwise(UNKNOWN)
    return joined.select("detection_id", status.alias("status"), F.coalesce("covered", F.lit(False)).alias("had_coverage"), "best", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def matched_ids(detections: DataFrame, positions: DataFrame, p: Params = Params()) -> DataFrame:
    """detection_ids that match: some vessel was within p.match_km. Coverage has no part in that."""
    found = candidates_near(require_instants(detections), positions, p)
    return found.filter(F.col("distance_km") <= p.match_km).select("detection_id").distinct()


def keep_set(matches: DataFrame) -> DataFrame:
    """Ids of detections that the map shows as dark: all that are not matched, covered or not."""
    return matches.filter(F.col("status") != MATCHED).select("detection_id")


def ranked_candidates(detections: DataFrame, positions: DataFrame, p: Params = Params(), most_pairs: int = CELL_PAIRS, most: int | None = None) -> DataFrame:
    """All candidates with their place, from 1: nearest first, ties to the smaller mmsi; with `most`, those up to that place. All candidates of a
    detection are in one task, which sorts them a batch of detections after the other, so they are neither shuffled nor collected."""
    columns = _types(detections, "detection_id") | _types(positions, "mmsi") | _AT | {"distance_km": DoubleType(), "place": IntegerType()}
    return _told(_meetings(detections, positions, p, most_pairs=most_pairs), columns, told_ranks, p, (), most)


def nearest_first_cap(ranked: DataFrame, most: int) -> DataFrame:
    """The `most` nearest of each detection's ranked_candidates()."""
    return ranked.filter(F.col("place") <= most)
