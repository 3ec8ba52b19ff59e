"""Regions, coordinates and map geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import geo, text
from tidelens.plans.adapter import events
from tidelens.plans.registry import query

_POINTS = "points as (select event_id, -10.0::double + 0.7::double * (event_id % 80) as lon, 28.0::double + 0.3::double * (event_id % 70) as lat, cast(event_id % 360 as double) as heading, cast(event_id % 400 as double) as hull from events)"
_REGION = " ".join(f"when lat between {s} and {n} and lon between {w} and {e} then '{name}'" for name, s, n, w, e in text.SEA_REGIONS)
_SIDES = "printf('%.2f', abs(lat)) || '°' || case when lat >= 0 then 'N' else 'S' end || ' ' || printf('%.2f', abs(lon)) || '°' || case when lon >= 0 then 'E' else 'W' end"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr("event_id", "-10.0D + 0.7D * (event_id % 80) as lon", "28.0D + 0.3D * (event_id % 70) as lat", "cast(event_id % 360 as double) as heading", "cast(event_id % 400 as double) as hull")


@query(f"with {_POINTS} select event_id, coalesce(case {_REGION} end, '-') as region from points")
def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("event_id", F.coalesce(text.region_name(F.col("lat"), F.col("lon")), F.lit("-")).alias("region"))


@query(f"with {_POINTS} select event_id, {_SIDES} as short, printf('%.6f', abs(lat)) || '° ' || case when lat >= 0 then 'N' else 'S' end as latitude from points")
def coordinate_texts(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("event_id", text.short_coords(F.col("lat"), F.col("lon")).alias("short"), text.coordinate(F.col("lat"), "N", "S").alias("latitude"))


@query(f"with {_POINTS} select event_id, coalesce(case {_REGION} end, {_SIDES}) || ' — no stamp' as shown from points")
def scene_display_name(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    corners = F.array(F.array(lat, lon), F.array(lat, lon))
    return _points(spark, d).select("event_id", text.scene_display_name(F.lit("x"), F.lit("no stamp"), corners).alias("shown"))


def _to(lat: str, lon: str, bearing: str, metres: str) -> str:
    """SQL of a destination as two columns."""
    sine = f"(sin(radians({lat})) * cos(({metres}) / 6371008.8) + cos(radians({lat})) * sin(({metres}) / 6371008.8) * cos(radians({bearing})))"
    turn = f"degrees(atan2(sin(radians({bearing})) * sin(({metres}) / 6371008.8) * cos(radians({lat})), cos(({metres}) / 6371008.8) - sin(radians({lat})) * {sine}))"
    return f"degrees(asin({sine})) as to_lat, fmod({lon} + {turn} + 540, 360) - 180 as to_lon"


@query(f"with {_POINTS} select event_id, round(to_lat, 7) as to_lat, round(to_lon, 7) as to_lon from (select event_id, {_to('lat', 'lon', 'heading', 'hull * 1000')} from points) as p")
def destination_point(spark: SparkSession, d: str) -> DataFrame:
    to = geo.destination_point(F.col("lat"), F.col("lon"), F.col("heading"), F.col("hull") * 1000)
    return _points(spark, d).select("event_id", F.round(to["lat"], 7).alias("to_lat"), F.round(to["lon"], 7).alias("to_lon"))


@query(f"""with {_POINTS}, arrows as (select event_id, lat, lon, heading, greatest(900, 4 * case when hull = 0 then 150 else hull end) as long, event_id % 3 = 0 as dashed from points),
tips as (select *, {_to('lat', 'lon', 'heading', 'long')} from arrows)
select event_id, long as metres, dashed, round(to_lat, 7) as tip_lat, round(to_lon, 7) as tip_lon from tips""")
def heading_arrow(spark: SparkSession, d: str) -> DataFrame:
    sure = F.when(F.col("event_id") % 3 == 0, 0.1).when(F.col("event_id") % 3 == 1, 0.5)
    rows = _points(spark, d).withColumn("a", geo.heading_arrow(F.col("lat"), F.col("lon"), F.col("heading"), sure, F.col("hull")))
    return rows.select("event_id", geo.arrow_length_m(F.col("hull")).alias("metres"), F.col("a.dashed").alias("dashed"), F.round("a.tip.lat", 7).alias("tip_lat"), F.round("a.tip.lon", 7).alias("tip_lon"))


_MERC = "ln(tan(pi() / 4 + ({}) * pi() / 360))"


@query(f"""with {_POINTS} select event_id, round({_MERC.format("lat")}, 9) as y,
'polygon(' || printf('%.3f%% %.3f%%', 10.0, ({_MERC.format("lat - 0.1")} - {_MERC.format("lat")}) / ({_MERC.format("lat - 1")} - {_MERC.format("lat")}) * 100) || ', ' || printf('%.3f%% %.3f%%', 50.0, 0.0) || ', ' || printf('%.3f%% %.3f%%', 100.0, 100.0) || ')' as clip from points""")
def mercator_clip(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    bounds = F.array(F.array(lat, lon), F.array(lat, lon + 1), F.array(lat - 1, lon + 1), F.array(lat - 1, lon))
    swath = F.array(F.array(lat - 0.1, lon + 0.1), F.array(lat, lon + 0.5), F.array(lat - 1, lon + 1))
    return _points(spark, d).select("event_id", F.round(geo.mercator_y(lat), 9).alias("y"), geo.swath_clip(bounds, swath).alias("clip"))


@query("""with p as (select event_id, cast(event_id % 5 as double) as x0, 0.0::double as y0, 10.0 + event_id % 7 as x1, 1.0::double as y1, 12.0 + event_id % 3 as x2, 11.0::double as y2, 1.0::double as x3, 9.0 + event_id % 2 as y3 from events),
s as (select *, x1 - x2 as ux, x3 - x2 as vx, x0 - x1 + x2 - x3 as wx, y1 - y2 as uy, y3 - y2 as vy, y0 - y1 + y2 - y3 as wy from p),
t as (select *, abs(wx) < 1e-9 and abs(wy) < 1e-9 as flat, ux * vy - vx * uy as det from s),
r as (select *, case when flat then 0 else (wx * vy - vx * wy) / det end as g, case when flat then 0 else (ux * wy - wx * uy) / det end as h from t)
select event_id, round(x1 - x0 + g * x1, 6) + 0.0 as a, round(case when flat then x2 - x1 else x3 - x0 + h * x3 end, 6) + 0.0 as b, round(y1 - y0 + g * y1, 6) + 0.0 as d, round(case when flat then y2 - y1 else y3 - y0 + h * y3 end, 6) + 0.0 as e, round(g, 9) + 0.0 as g, round(h, 9) + 0.0 as h from r""")
def square_to_quad(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    x = [(n % 5).cast("double"), 10.0 + n % 7, 12.0 + n % 3, F.lit(1.0)]
    y = [F.lit(0.0), F.lit(1.0), F.lit(11.0), 9.0 + n % 2]
    rows = events(spark, d).select("event_id", geo.square_to_quad(x, y).alias("q"))
    return rows.select("event_id", *((F.round(F.col(f"q.{c}"), 9 if c in "gh" else 6) + 0.0).alias(c) for c in "abdegh"))


@query("select event_id, floor(value * 100 + 0.5) as percent, floor(0.5 - value) as below from events")
def half_up_rounding(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", text.half_up(F.col("value") * 100).cast("double").alias("percent"), text.half_up(-F.col("value")).cast("double").alias("below"))


def _at(lat: str, lon: str, bearing: str, metres: str, name: str) -> str:
    """SQL of a destination as two columns of a name."""
    return _to(lat, lon, bearing, metres).replace("as to_lat", f"as {name}_lat").replace("as to_lon", f"as {name}_lon")


@query(f"""with {_POINTS}, arrows as (select event_id, lat, lon, heading, greatest(900, 4 * case when hull = 0 then 150 else hull end) as long, event_id % 3 = 0 as dashed from points where event_id % 4 <> 0),
tips as (select *, {_to('lat', 'lon', 'heading', 'long')} from arrows),
ends as (select event_id, dashed, {_at('to_lat', 'to_lon', 'heading + 150', 'long * 0.28', 'right')}, {_at('to_lat', 'to_lon', 'heading - 150', 'long * 0.28', 'left')}, {_at('lat', 'lon', 'heading + 180', 'long * 0.55', 'back')} from tips)
select event_id, round(right_lat, 7) as right_lat, round(right_lon, 7) as right_lon, round(left_lat, 7) as left_lat, round(left_lon, 7) as left_lon, case when dashed then round(back_lat, 7) end as back_lat, case when dashed then round(back_lon, 7) end as back_lon from ends""")
def heading_arrow_barbs(spark: SparkSession, d: str) -> DataFrame:
    """The rest of an arrow: its barbs, and the line back of an unsure heading; every fourth ship has no heading, and no arrow."""
    sure = F.when(F.col("event_id") % 3 == 0, 0.1).when(F.col("event_id") % 3 == 1, 0.15)
    heading = F.when(F.col("event_id") % 4 != 0, F.col("heading"))
    rows = _points(spark, d).withColumn("a", geo.heading_arrow(F.col("lat"), F.col("lon"), heading, sure, F.col("hull"))).filter("a is not null")
    return rows.select("event_id", *(F.round(f"a.{end}.{axis}", 7).alias(f"{end}_{axis}") for end in ("right", "left", "back") for axis in ("lat", "lon")))


_WHEN = "strftime(ts, '%-d %b %Y, %H:%M') || ' UTC'"
_STAMPED = "'S1B_EW_GRDM_1SDH_' || strftime(ts, '%Y%m%dT%H%M%S') || '_'"


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("S1B_EW_GRDM_1SDH_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_"))
    return _points(spark, d).join(events(spark, d).select("event_id", "ts"), "event_id").withColumn("name", F.when(F.col("event_id") % 3 == 0, "odd name.tif").otherwise(name))


def _corners(some: str = "true"):
    lat, lon = F.col("lat"), F.col("lon")
    return F.when(F.expr(some), F.array(F.array(lat - 0.1, lon), F.array(lat + 0.1, lon)))


@query(f"with {_POINTS} select event_id, case when event_id % 5 <> 0 then coalesce(case {_REGION} end, {_SIDES}) || ' — ' else '' end || case when event_id % 3 = 0 then 'label' else {_WHEN} end as shown from points join events using (event_id)")
def scene_display_name_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with and without a stamp in their name, with and without corners."""
    return _stamped(spark, d).select("event_id", text.scene_display_name(F.col("name"), F.lit("label"), _corners("event_id % 5 <> 0")).alias("shown"))


@query(f"with {_POINTS} select event_id, case when event_id % 5 <> 0 then coalesce(case {_REGION} end, {_SIDES}) || ' — ' || case when event_id % 3 = 0 then 'odd name.tif' else {_WHEN} end when event_id % 3 = 0 then 'odd name.tif' else 'Sentinel-1B — ' || {_WHEN} end as shown from points join events using (event_id)")
def image_display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Images by place and time, or by mission where they have no corners."""
    return _stamped(spark, d).select("event_id", text.image_display_label(F.col("name"), _corners("event_id % 5 <> 0")).alias("shown"))


@query("select event_id, url_encode(event_type || ' é/+?' || event_id || '&~*x') as part from events")
def url_components(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", text.url_component(F.concat("event_type", F.lit(" é/+?"), F.col("event_id").cast("string"), F.lit("&~*x"))).alias("part"))


_SAID = "case event_id % 5 when 0 then props when 1 then '[[42.1, 27.2], null, \"é\"]' when 2 then '{\"open\": ' when 3 then '' else 'no json' end"


@query(f"select event_id, json_valid({_SAID}) as valid from events")
def json_checked(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are JSON, and others."""
    return events(spark, d).select("event_id", text.is_json(F.expr(_SAID)).alias("valid"))
