"""Scene reports: normal form, geometry, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions import text

_PAIRS = "array<array<double>>"
DETECTION = f"confidence: double, center: struct<lon: double, lat: double>, length_m: double, width_m: double, heading_deg: double, heading_confidence: double, corners_pixel: {_PAIRS}, corners_lonlat: {_PAIRS}"
SHIP = f"id: int, conf: double, longitude: double, latitude: double, length_m: double, width_m: double, heading: double, heading_confidence: double, col_px: double, row_px: double, corners: {_PAIRS}"
#: Both dialects in one: a detector's report has detections, an older one has meta and ships.
REPORT = (
    f"scene string, acquisition_time string, backend string, footprint_lonlat {_PAIRS}, overview_bounds_lonlat {_PAIRS}, swath_lonlat {_PAIRS},"
    f" timings array<struct<stage: string, ms: double>>, detections array<struct<{DETECTION}>>,"
    f" meta struct<scene: string, acquired: string, model: string, ships: int>, ships array<struct<{SHIP}>>, bad string"
)
DEFAULT_MODEL = "yolov8s-obb-cpp"


def parse_reports(files: DataFrame) -> DataFrame:
    """name and r (REPORT) of files (name, content); files that are no JSON, and unsafe names, are skipped."""
    parsed = files.select("name", F.from_json("content", REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("r"))
    return parsed.filter(text.safe_name(F.col("name")) & F.col("r").isNotNull() & F.col("r.bad").isNull())


def _swapped(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.array(F.element_at(p, 2), F.element_at(p, 1)))


def _ship(d: Column, k: Column) -> Column:
    middle = text.centre(d["corners_pixel"])
    return F.struct(
        (k + 1).cast("int").alias("id"), d["confidence"].alias("conf"), d["center"]["lon"].alias("longitude"), d["center"]["lat"].alias("latitude"), d["length_m"].alias("length_m"), d["width_m"].alias("width_m"),
        d["heading_deg"].alias("heading"), d["heading_confidence"].alias("heading_confidence"), middle["x"].alias("col_px"), middle["y"].alias("row_px"), F.when(F.size(d["corners_lonlat"]) > 0, _swapped(d["corners_lonlat"])).alias("corners"),
    )


def normalize(reports: DataFrame) -> DataFrame:
    """name, meta, ships, r: every report in the older dialect's shape; a report of that dialect stays as it is."""
    new = F.col("r.detections").isNotNull()
    meta = F.struct(F.col("r.scene").alias("scene"), F.col("r.acquisition_time").alias("acquired"), F.coalesce("r.backend", F.lit(DEFAULT_MODEL)).alias("model"), F.size("r.detections").alias("ships"))
    return reports.select("name", F.when(new, meta).otherwise(F.col("r.meta")).alias("meta"), F.when(new, F.transform("r.detections", _ship)).otherwise(F.col("r.ships")).alias("ships"), "r")


def quad(pairs: Column) -> Column:
    """The first four lat-lon pairs of an array of lon-lat pairs; members that are no pairs are skipped; null for fewer."""
    good = _swapped(F.filter(pairs, lambda p: (F.size(p) >= 2) & F.element_at(p, 1).isNotNull() & F.element_at(p, 2).isNotNull()))
    return F.when(F.size(good) >= 4, F.slice(good, 1, 4))


def ships_box(ships: Column) -> Column:
    """The corners of the box around the ships that have a place; a side shorter than 0.0001 degrees grows by 0.0005
    each way; null without such ships."""
    placed = F.filter(ships, lambda s: s["latitude"].isNotNull() & s["longitude"].isNotNull())

    def side(axis: str) -> tuple[Column, Column]:
        values = F.transform(placed, lambda s: s[axis])
        low, high = F.array_min(values), F.array_max(values)
        more = F.when(high - low < 1e-4, 5e-4).otherwise(0.0)
        return low - more, high + more

    (south, north), (west, east) = side("latitude"), side("longitude")
    return F.when(F.size(placed) > 0, F.array(F.array(south, west), F.array(south, east), F.array(north, east), F.array(north, west)))


def footprint() -> Column:
    """Of a normalized report: its own, or else the box of its ships."""
    return F.coalesce(quad(F.col("r.footprint_lonlat")), ships_box(F.col("ships")))


def timings() -> Column:
    """The stages that have a name and a time; null for none."""
    good = F.filter("r.timings", lambda t: t["stage"].isNotNull() & t["ms"].isNotNull())
    return F.when(F.size(good) > 0, good)


def scene_list(normal: DataFrame) -> DataFrame:
    """name, label, corners, acquired of the scenes that have corners."""
    acquired = text.acquired_utc(F.col("meta.acquired"))
    rows = normal.select("name", text.scene_label(F.col("name"), acquired).alias("label"), footprint().alias("corners"), acquired.alias("acquired"))
    return rows.filter(F.col("corners").isNotNull())


def overlays(normal: DataFrame) -> DataFrame:
    """name, corners (of the overview, or else the footprint), swath, timings, has_sar (a detector's report)."""
    return normal.select("name", F.coalesce(quad(F.col("r.overview_bounds_lonlat")), footprint()).alias("corners"), quad(F.col("r.swath_lonlat")).alias("swath"), timings().alias("timings"), F.col("r.detections").isNotNull().alias("has_sar"))


def with_sar(normal: DataFrame, overviews: DataFrame) -> DataFrame:
    """name and has_sar of each scene: whether a detector's report says so, or an overview image (column name of overviews,
    with its extension) that holds anything lies ready."""
    ready = overviews.filter("bytes > 0").select(F.regexp_replace("name", r"\.[^.]+$", "").alias("name"), F.lit(True).alias("ready")).distinct()
    return normal.select("name", F.col("r.detections").isNotNull().alias("reported")).join(ready, "name", "left").select("name", (F.col("reported") | F.coalesce("ready", F.lit(False))).alias("has_sar"))


def positioned_ships(normal: DataFrame) -> DataFrame:
    """One row for each ship with a place: name, ship (its id, or else its place among the ships shown), s, detection_id,
    acquired. Matching and display use the same id."""
    placed = F.filter("ships", lambda s: s["latitude"].isNotNull() & s["longitude"].isNotNull())
    rows = normal.select("name", text.acquired_utc(F.col("meta.acquired")).alias("acquired"), F.posexplode(placed).alias("k", "s"))
    rows = rows.withColumn("ship", F.coalesce("s.id", F.col("k") + 1))
    return rows.select("name", "ship", "s", text.match_id(F.col("name"), F.col("ship")).alias("detection_id"), "acquired")


def vessels(normal: DataFrame, keep: DataFrame | None) -> DataFrame:
    """What the map shows of each ship. keep: detection_ids that are dark; None if nothing was matched: all are dark."""
    ships = positioned_ships(normal)
    if keep is None:
        ships = ships.withColumn("dark", F.lit(True))
    else:
        ships = ships.join(keep.select("detection_id", F.lit(True).alias("dark")), "detection_id", "left").withColumn("dark", F.coalesce("dark", F.lit(False)))
    s = lambda c: F.col(f"s.{c}")
    return ships.select(
        "name", text.display_id(F.col("name"), F.col("ship")).alias("id"), s("latitude").alias("lat"), s("longitude").alias("lon"), "dark", text.contact_name(F.col("dark"), F.col("ship")).alias("contact"), F.lit("").alias("mmsi"), F.lit("Unknown").alias("type"),
        s("length_m").alias("length_m"), s("heading").alias("heading_deg"), s("heading_confidence").alias("heading_confidence"), F.lit(None).cast("double").alias("speed_kn"), text.detected_at(F.col("acquired")).alias("detected_at"), s("conf").alias("confidence"), s("corners").alias("corners"),
    )


def totals(shown: DataFrame) -> DataFrame:
    """name, total and dark counts."""
    return shown.groupBy("name").agg(F.count("*").alias("total"), F.count_if("dark").alias("dark"))


def card_rows(shown: DataFrame) -> DataFrame:
    """name, id, label, value: the lines of a ship's card, without those that say nothing."""
    c = F.col
    unsure = F.when(c("heading_confidence") < 0.15, "  (direction uncertain)").otherwise("")
    pairs = {
        "Status": F.when(c("dark"), "Dark vessel (no AIS)").otherwise("AIS reported"),
        "Latitude": text.coordinate(c("lat"), "N", "S"),
        "Longitude": text.coordinate(c("lon"), "E", "W"),
        "MMSI": F.when(c("mmsi") == "", "—").otherwise(c("mmsi")),
        "Type": c("type"),
        "Length": F.when(c("length_m") != 0, F.concat(F.regexp_replace(c("length_m").cast("string"), r"\.0$", ""), F.lit(" m"))),
        "Heading": F.concat(text.half_up(c("heading_deg")).cast("string"), F.lit("°"), unsure),
        "Speed": F.concat(c("speed_kn").cast("string"), F.lit(" kn")),
        "Detected": c("detected_at"),
        "Confidence": F.concat(text.half_up(c("confidence") * 100).cast("string"), F.lit(" %")),
    }
    lines = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs.items()))
    return shown.select("name", "id", F.explode(F.filter(lines, lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("x")).select("name", "id", "x.label", "x.value")


def images_with_places(images: DataFrame, footprints: DataFrame) -> DataFrame:
    """name, corners of every image (left join); footprints: name, corners."""
    return images.join(footprints, "name", "left").select("name", "corners")


def explode_footprints(maps: DataFrame) -> DataFrame:
    """name, corners of a JSON map in column content; what cannot be read has no entry, and nor have null corners."""
    parsed = maps.select(F.explode(F.from_json("content", f"map<string, {_PAIRS}>")).alias("name", "corners"))
    return parsed.filter(F.col("corners").isNotNull())


def unprocessed(images: DataFrame, scenes: DataFrame) -> DataFrame:
    """Images whose scene (column name of scenes) is not there yet."""
    return images.withColumn("scene_id", text.scene_id_for_image(F.col("name"))).join(scenes.select(F.col("name").alias("scene_id")), "scene_id", "left_anti")


def forget(cached: DataFrame, names: DataFrame) -> DataFrame:
    """A scene cache after images were processed again: without their scenes, of either detector."""
    stems = names.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    gone = stems.select(F.col("stem").alias("name")).unionByName(stems.select(F.concat("stem", F.lit("__cpp")).alias("name")))
    return cached.join(gone, "name", "left_anti")
