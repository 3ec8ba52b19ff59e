"""Names, stamps and numbers as texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The regions in the order in which they are tried, as name, lowest and highest latitude, then longitude.
SEA_REGIONS = (
    ("Sea of Azov", 45.2, 47.4, 34.8, 39.6),
    ("Sea of Marmara", 40.2, 41.3, 26.5, 30.0),
    ("Black Sea", 40.9, 47.4, 27.3, 42.0),
    ("Aegean Sea", 35.0, 41.0, 22.5, 28.5),
    ("Ionian Sea", 35.8, 40.5, 15.5, 22.5),
    ("Adriatic Sea", 39.5, 45.9, 12.2, 20.0),
    ("Tyrrhenian Sea", 38.0, 44.0, 9.0, 16.0),
    ("Ligurian Sea", 42.8, 44.6, 7.0, 10.0),
    ("Balearic Sea", 37.8, 43.8, 0.0, 9.0),
    ("Alboran Sea", 34.8, 37.6, -6.0, 0.0),
    ("Algerian Basin", 35.0, 38.5, 0.0, 9.5),
    ("Levantine Sea", 30.5, 37.2, 28.0, 36.6),
    ("Libyan Sea", 30.0, 35.6, 15.0, 25.0),
    ("Strait of Sicily", 33.0, 38.0, 10.0, 15.0),
)
# Formats of names and stamps.
SENTINEL_NAME = r"^(S1[A-D])_([A-Z]{2})_([A-Z]{4})_[A-Z0-9]{4}_(\d{8})T(\d{6})_"
ISO_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?"
ARCHIVE_STAMP = "dd/MM/yyyy H:mm"
MISSIONS = ("S1A", "S1B", "S1C", "S1D")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def region_name(lat: Column, lon: Column) -> Column:
    """The first region that holds the point, borders included; null if none does."""
    return reduce(lambda rest, r: F.when(lat.between(r[1], r[2]) & lon.between(r[3], r[4]), r[0]).otherwise(rest), reversed(SEA_REGIONS), F.lit(None).cast("string"))


def short_coords(lat: Column, lon: Column) -> Column:
    side = lambda x, plus, minus: F.format_string("%.2f°%s", F.abs(x), F.when(x >= 0, plus).otherwise(minus))
    return F.concat_ws(" ", side(lat, "N", "S"), side(lon, "E", "W"))


def coordinate(x: Column, plus: str, minus: str) -> Column:
    """Six decimals and the side; empty for null."""
    return F.when(x.isNull(), "").otherwise(F.format_string("%.6f° %s", F.abs(x), F.when(x >= 0, plus).otherwise(minus)))


def day_month_year(ts: Column) -> Column:
    """Such as 7 Aug 2026, in English whatever the locale."""
    names = F.array(*(F.lit(m) for m in MONTHS))
    return F.format_string("%d %s %d", F.dayofmonth(ts), F.element_at(names, F.month(ts)), F.year(ts))


def stamp(ts: Column) -> Column:
    """Such as 7 Aug 2026 04:13."""
    return F.concat(day_month_year(ts), F.date_format(ts, " HH:mm"))


def sentinel_parts(name: Column) -> Column:
    """mission, mode, product and acquired of a product's name; null for other names."""
    part = lambda k: F.regexp_extract(name, SENTINEL_NAME, k)
    acquired = F.try_to_timestamp(F.concat(part(4), part(5)), F.lit("yyyyMMddHHmmss"))
    return F.when(name.rlike(SENTINEL_NAME), F.struct(part(1).alias("mission"), part(2).alias("mode"), part(3).alias("product"), acquired.alias("acquired")))


def when_text(ts: Column) -> Column:
    """Such as 7 Aug 2026, 04:13 UTC."""
    return F.concat(day_month_year(ts), F.date_format(ts, ", HH:mm"), F.lit(" UTC"))


def image_display_name(name: Column) -> Column:
    p = sentinel_parts(name)
    return F.when(p.isNotNull(), F.concat(F.lit("Sentinel-1"), F.substring(p["mission"], 3, 1), F.lit(" — "), when_text(p["acquired"]))).otherwise(name)


def place(corners: Column) -> Column:
    """The region of the corners' mean, or else its coordinates; null without corners."""
    c = centre(corners)
    return F.when(c.isNotNull(), F.coalesce(region_name(c["x"], c["y"]), short_coords(c["x"], c["y"])))


def centre(points: Column) -> Column:
    """x and y, the means of the points' first and second numbers; null for no points."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda total, p: total + F.element_at(p, k)) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean(1).alias("x"), mean(2).alias("y")))


def image_display_label(name: Column, corners: Column) -> Column:
    p = sentinel_parts(name)
    return F.coalesce(F.concat(place(corners), F.lit(" — "), F.coalesce(when_text(p["acquired"]), name)), image_display_name(name))


def scene_display_name(scene_id: Column, label: Column, corners: Column) -> Column:
    when = F.coalesce(when_text(sentinel_parts(scene_id)["acquired"]), label)
    return F.coalesce(F.concat(place(corners), F.lit(" — "), when), when)


def scene_id_for_image(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("__cpp"))


def image_kind(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".safe"), "SAFE").otherwise("TIF")


def acquired_utc(text: Column) -> Column:
    """The first ISO stamp in a text, read as UTC; an offset after it is not looked at. Without a stamp, an ISO date
    alone is read too; anything else is null."""
    found = F.regexp_extract(text, ISO_STAMP, 0)
    clean = F.regexp_replace(F.regexp_replace(found, "Z$", ""), " ", "T")
    return F.when(found != "", F.try_to_timestamp(clean)).when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.trim(text)))


def scene_label(scene_id: Column, acquired: Column) -> Column:
    mission = F.upper(F.substring(scene_id, 1, 3))
    return F.when(acquired.isNull(), scene_id).otherwise(F.concat_ws(" - ", F.when(mission.isin(*MISSIONS), mission), stamp(acquired)))


def detected_at(acquired: Column) -> Column:
    return F.date_format(acquired, "yyyy-MM-dd HH:mm 'UTC'")


def match_id(scene_id: Column, ship: Column) -> Column:
    return F.concat_ws("-", scene_id, ship.cast("string"))


def display_id(scene_id: Column, ship: Column) -> Column:
    return F.concat(scene_id, F.format_string("-%03d", ship))


def contact_name(dark: Column, ship: Column) -> Column:
    return F.concat(F.when(dark, "Dark contact ").otherwise("AIS-matched contact "), F.format_string("%02d", ship))


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upward also below zero."""
    return F.floor(x + 0.5)


def safe_name(name: Column) -> Column:
    """Whether a name may be used as a file's; a line feed at the end is not accepted."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_.\-]+\z"), F.lit(False))


def parse_archive_stamp(text: Column, zone: str = "UTC") -> Column:
    """The instant of an archive's day-first stamp, hours of one digit or two, in the archive's zone, whatever the
    session's zone."""
    wall = F.try_to_timestamp(F.concat(text, F.lit("+00:00")), F.lit(ARCHIVE_STAMP + "XXX"))
    return F.to_utc_timestamp(wall, zone)


def format_archive_stamp(ts: Column, zone: str = "UTC") -> Column:
    """The stamp of an instant in the archive's zone. The session's zone has no part in it, but for hours that it skips
    where its clocks go forward."""
    seconds = (F.unix_micros(F.from_utc_timestamp(ts, zone)).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    wall = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.date_format(wall, "dd/MM/yyyy HH:mm")


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


def lenient_long(text: Column) -> Column:
    """Also of numbers written with decimals, cut towards zero."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def is_json(text: Column) -> Column:
    """Whether a text is JSON."""
    return F.try_parse_json(text).isNotNull()


def url_component(name: Column) -> Column:
    """A name percent-encoded as a part of a URL's path: all but letters, digits and - . _ ~ (the form encoding differs in spaces, * and ~)."""
    form = F.url_encode(name)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(was), F.lit(now))
    return form
