"""The collector flush by flush, with fixed batches."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pytest

from tidelens.operators import match
from tidelens.sources import sources
from tidelens.streaming import collector

LINES = "seq bigint, arrived timestamp, value string"


def report(mmsi, lat, **more):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi}, "Message": {"PositionReport": {"Latitude": lat, "Longitude": 27.2, "Sog": 102.3, "Cog": 360.0, "TrueHeading": 511, "NavigationalStatus": 0} | more}})


def static(mmsi, name, **more):
    return json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": mmsi}, "Message": {"ShipStaticData": {"Name": name, "CallSign": "", "ImoNumber": 9, "Type": 70, "Dimension": {"A": 100, "B": 20, "C": 10, "D": None}} | more}})


def at(second):
    return datetime(2026, 8, 1, 12, 0, second)


def test_flushes(spark, tmp_path):
    batches = [
        [(1, at(1), report(5, 42.1)), (2, at(7), report(5, 42.2, Sog=3.0)), (3, at(8), "{no json"), (4, at(8), json.dumps({"MessageType": "PositionReport", "Message": {}})), (5, at(9), static(5, " X  ")), (6, at(9), json.dumps({"MessageType": "Other", "MetaData": {"MMSI": 5}, "Message": {}}))],
        [(7, at(30), report(5, 49.9)), (8, at(31), report(6, 43.0)), (9, at(32), static(5, "Y")), (10, at(33), static(5, " ", ImoNumber=None))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    sink = collector.Collector(spark, str(tmp_path / "out"))
    for k in range(2):
        sink.flush(spark.read.parquet(str(tmp_path / f"in/{k}")), k)
    sink.flush(spark.read.parquet(str(tmp_path / "in/1")), 1)  # again, as after a failure
    assert sorted((r.mmsi, r.ts, r.lat, r.sog, r.cog, r.heading) for r in sink.positions().collect()) == [(5, at(0), 42.2, 3.0, None, None), (6, at(0), 43.0, None, None, None)]
    v = sink.vessels().first()
    assert (v.name, v.callsign, v.imo, v.length_m, v.width_m, v.first_seen, v.last_seen) == ("X", None, 9, 120.0, None, at(9), at(33))
    sink.close(at(59))
    c = sink.coverage().first()
    assert (c.messages, c.started_at, c.last_message_at, c.ended_at) == (10, at(1), at(33), at(59))


def test_ledger_of_two_runs(spark, tmp_path):
    """A restart is a session of its own, the time between is not covered, and a close outlives later flushes."""
    sink, day = collector.Collector(spark, str(tmp_path / "out"), idle_seconds=7200), lambda d, h=0: datetime(2026, 8, d, h)
    assert sink.coverage().count() == 0
    batch = lambda d: spark.createDataFrame([(1, day(d), report(5, 42.1))], LINES)
    sink.open(day(1))
    sink.flush(batch(1), 0)
    sink.close(day(1, 1))
    sink.close(day(1, 2))
    again = collector.Collector(spark, str(tmp_path / "out"), idle_seconds=7200)
    again.open(day(9))
    again.flush(batch(1), 0)  # done again, as after a failure: it stays with the session that wrote it
    again.flush(batch(9), 1)
    again.flush(batch(9), 1)
    assert sorted((r.started_at, r.last_message_at, r.ended_at, r.messages) for r in again.coverage().collect()) == [(day(1), day(1), day(1, 1), 1), (day(9), day(9), None, 1)]
    asked = spark.createDataFrame([("in", day(1, 1)), ("gap", day(5)), ("second", day(9))], "detection_id string, ts timestamp")
    assert sorted(r.detection_id for r in match.covered_by_ledger(asked, again.coverage()).collect()) == ["in", "second"]


def test_silence_ends_a_session(spark, tmp_path):
    """A message on 1 August and a close on 9 August: nobody is known to have listened on 5 August."""
    day = lambda d, h=0, m=0, s=0: datetime(2026, 8, d, h, m, s)
    sink = collector.Collector(spark, str(tmp_path / "out"))
    sink.open(day(1))
    sink.flush(spark.createDataFrame([(1, day(1, 0, 1), report(5, 42.1))], LINES), 0)
    sink.flush(spark.createDataFrame([(2, day(3), report(5, 42.1)), (3, day(3, 0, 2), report(5, 42.1)), (4, day(3, 0, 4, 1), "?")], LINES), 1)
    sink.close(day(9))
    want = [(day(1), day(1, 0, 1), day(1, 0, 3), 1), (day(3), day(3, 0, 2), day(3, 0, 4), 2), (day(3, 0, 4, 1), day(3, 0, 4, 1), day(3, 0, 6, 1), 1)]
    assert sorted((r.started_at, r.last_message_at, r.ended_at, r.messages) for r in sink.coverage().collect()) == want
    asked = spark.createDataFrame([("first", day(1, 0, 2)), ("gap", day(5)), ("third", day(3, 0, 3)), ("close", day(9))], "detection_id string, ts timestamp")
    assert sorted(r.detection_id for r in match.covered_by_ledger(asked, sink.coverage(), 0).collect()) == ["first", "third"]
    nobody = spark.createDataFrame([], "mmsi bigint, ts timestamp, lat double, lon double")
    found = match.match_detections(asked.selectExpr("*", "42.1D as lat", "27.2D as lon"), nobody, match.covered_by_ledger(asked, sink.coverage()))
    assert {r.detection_id: r.status for r in found.collect()} == {"first": "Dark", "third": "Dark", "gap": "UnknownNoCoverage", "close": "UnknownNoCoverage"}
    sink.open(day(20))
    assert sorted((r.started_at, r.ended_at) for r in sink.coverage().filter("last_message_at is null").collect()) == [(day(20), None)]
    sink.close(day(21))
    assert [r.ended_at for r in sink.coverage().filter("last_message_at is null").collect()] == [day(20, 0, 2)]


def lines_of(minutes, per=3):
    """A file for each flush: reports of two vessels, the second one's minutes reaching into the next flush."""
    return [[(100 * m + k, datetime(2026, 8, 1 + m // 1440, m // 60 % 24, m % 60, 10 * k), report(5 + k % 2, 40 + m + k / 10)) for k in range(per)] + [(100 * m + 50, datetime(2026, 8, 1 + m // 1440, m // 60 % 24, m % 60, 59), "?")] for m in minutes]


def test_a_flush_is_visible_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    sink = collector.Collector(spark, str(tmp_path / "out"))
    batches = [spark.createDataFrame(rows, LINES) for rows in lines_of(range(3))]
    sink.flush(batches[0], 0)
    seen = lambda c: (c.positions().count(), c.vessels().count(), c.coverage().agg({"messages": "sum"}).first()[0])
    before = seen(sink)
    monkeypatch.setattr(collector.Collector, "_commit", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.flush(batches[1], 1)
    monkeypatch.undo()
    assert seen(sink) == seen(collector.Collector(spark, sink.folder)) == before == (2, 0, 4)
    again = collector.Collector(spark, sink.folder)
    for number in (1, 2, 1, 0):
        again.flush(batches[number], number)
    assert seen(again) == (6, 0, 12)


def test_compaction(spark, tmp_path):
    """Many flushes leave few files; what they told stays, and so does what was done."""
    plain, folded = (collector.Collector(spark, str(tmp_path / f), compact_every=n) for f, n in (("plain", 10**6), ("folded", 3)))
    batches = lines_of([0, 1, 2, 1438, 1439, 1440, 1441])
    for sink in (plain, folded):
        for number, rows in enumerate(batches):
            rows = [*rows, (7, rows[0][1], static(5, f"name {number}" if number < 4 else " "))]
            sink.flush(spark.createDataFrame(rows, LINES), number)
        sink.flush(spark.createDataFrame(batches[0], LINES), 0)
    tables = lambda c: [sorted(map(str, t.collect())) for t in (c.positions(), c.vessels(), c.coverage().drop("id", "session"), c.status().drop("session"))]
    assert tables(plain) == tables(folded)
    assert plain.vessels().first().name == "name 3"
    assert len(list((tmp_path / "folded").glob("*/flush=*"))) == 3 and len(list((tmp_path / "folded/commits").glob("*.json"))) <= 3
    assert len(list((tmp_path / "folded/positions").glob("upto=*/day=*"))) == 2


def test_stream_state(spark, tmp_path):
    """The first flush of a minute keeps it, and the last report in that flush; old minutes leave the state; no flush reads the archive."""
    flushes = lines_of([0, 1]) + [[(900, datetime(2026, 8, 1, 0, 1, 55), report(5, 88.0)), (901, datetime(2026, 8, 1, 0, 2, 5), report(5, 77.0))]] + lines_of(range(10, 2881, 410))
    for k, rows in enumerate(flushes):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        time.sleep(0.02)
    raw = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = collector.Collector(spark, str(tmp_path / "out"))
    sink._table, table = lambda *a, **b: 1 / 0, sink._table
    q = sink.start(raw, str(tmp_path / "checkpoint"), every=None)
    q.awaitTermination()
    sink._table = table
    got = {(r.mmsi, r.ts): r.lat for r in sink.positions().collect()}
    assert len(got) == 2 * len(flushes) - 1 and got[5, datetime(2026, 8, 1, 0, 1)] == 41.2 and got[5, datetime(2026, 8, 1, 0, 2)] == 77.0
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert kept and max(kept) <= 7 and kept[-1] <= 4
    told = sink.status().first()
    assert (told.messages, told.rows_written, told.running, told.last_error) == (sum(map(len, flushes)), len(got), True, None)


def test_supervisor(spark, tmp_path):
    """A stream that fails twice comes up again from its checkpoint, and each line counts once."""
    for rows in lines_of(range(4)):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    raw = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink, write, left = collector.Collector(spark, str(tmp_path / "out")), collector.Collector._write, [2]

    def failing(self, fresh, lines, number, writer):
        if number >= 2 and left[0]:
            left[0] -= 1
            raise RuntimeError("the disk is on fire")
        write(self, fresh, lines, number, writer)

    sink._write = failing.__get__(sink)
    boss = collector.Supervisor(sink, lambda: sink.start(raw, str(tmp_path / "checkpoint"), every=None), retry_seconds=0.01)
    assert boss.desired == "stopped"
    boss.run()
    assert sink.positions().count() == 0
    boss.request("running")
    boss.run()
    assert left == [0] and sink.positions().count() == 8
    told = sink.status().orderBy("started_at").collect()
    assert [(r.messages, r.rows_written, "on fire" in (r.last_error or "")) for r in told] == [(8, 4, True), (0, 0, True), (8, 4, False)]
    assert not any(r.running for r in told)
    with pytest.raises(ValueError):
        boss.request("on holiday")


def test_stop_closes_the_session(spark, tmp_path):
    spark.createDataFrame(lines_of([0])[0], LINES).write.parquet(str(tmp_path / "in"))
    sink = collector.Collector(spark, str(tmp_path / "out"))
    q = sink.start(spark.readStream.schema(LINES).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"), every="1 second")
    q.processAllAvailable()
    sink.stop(q)
    assert not q.isActive and [r.running for r in sink.status().collect()] == [False] and sink.positions().count() == 2


def test_stream_and_status(spark, tmp_path):
    spark.createDataFrame([(1, at(1), report(5, 42.1))], LINES).write.parquet(str(tmp_path / "in"))
    sink = collector.Collector(spark, str(tmp_path / "out"))
    raw = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        q = sink.start(raw, str(tmp_path / "checkpoint"), every=None)
        q.awaitTermination()
    assert sink.positions().count() == 1 and collector.status(q)["running"] is False and collector.status(q)["error"] is None


def test_event_time(spark, tmp_path):
    line = json.loads(report(5, 42.1))
    rows = [(json.dumps(line | {"MetaData": {"MMSI": 5, "time_utc": f"2026-08-01 12:00:{s:02d}.5 +0000 UTC"}}),) for s in (7, 40)]
    spark.createDataFrame(rows, "value string").write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    q = collector.event_time_positions(raw).select("mmsi", "ts").writeStream.format("memory").queryName("by_event_time").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("by_event_time").collect()] == [(5, at(0))]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,ts,lat,lon,sog,cog,heading,nav_status\n1,31/07/2026 18:10,42.5,27.2,8.4,268,NULL,0\n1,05/08/2026 6:54,42.6,27.3,NULL,NULL,NULL,0\nNULL,05/08/2026 06:54,42.6,27.3,1,2,3,0\n5,garbage,42.6,27.3,1,2,3,0\n")
    rows = sources.open_positions(spark, "text_archive", path=str(tmp_path / "a.csv")).orderBy("ts", "mmsi").collect()
    assert [(r.mmsi, r.ts, r.sog) for r in rows] == [(1, datetime(2026, 7, 31, 18, 10), 8.4), (0, datetime(2026, 8, 5, 6, 54), 1.0), (1, datetime(2026, 8, 5, 6, 54), None)]
    (tmp_path / "p.json").write_text('{"ok": true, "rows": [{"mmsi": 1, "ts": "2026-08-05 06:54:00", "lat": 1.0, "lon": 2.0}, {"mmsi": 2, "ts": "?", "lat": 1.0, "lon": 2.0}]}')
    assert [r.mmsi for r in sources.open_positions(spark, "json_pages", path=str(tmp_path / "p.json")).collect()] == [1]
    with pytest.raises(ValueError):
        sources.open_positions(spark, "carrier pigeon")
    (tmp_path / "names").write_text(" a.tif \n\nb.SAFE\n")
    assert [r.name for r in sources.names(spark, str(tmp_path / "names")).collect()] == ["a.tif", "b.SAFE"]
    scenes = tmp_path / "scenes"
    scenes.mkdir()
    (scenes / "s.json").write_text("{}")
    (scenes / "s.png").write_bytes(b"x")
    (scenes / "t.png").write_bytes(b"")
    assert [(r.name, r.content) for r in sources.scene_files(spark, str(scenes)).collect()] == [("s", "{}")]
    assert [(r.name, r.bytes) for r in sources.overviews(spark, str(scenes / "*.png")).collect()] == [("s.png", 1)]


def test_lines_of_a_flush_are_in_many_files(spark, monkeypatch):
    """No task reads or writes a quarter of all lines: a flush has files enough."""
    from tidelens.plans import catalogue

    class Seen(Exception):
        pass

    def start(self, raw, checkpoint, **more):
        raise Seen(self.folder)

    monkeypatch.setattr(collector.Collector, "start", start)
    with pytest.raises(Seen) as seen:
        catalogue.queries()["collector_status"](spark, "/root/testdata/sf0.001")
    folder = str(seen.value).removesuffix("/out") + "/in"
    assert spark.read.parquet(folder).select("_metadata.file_path").distinct().count() > 64
