"""The live collector: messages in, positions, vessels and coverage out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidelens.operators.archive import insert_ignore, last_in_minute, last_record
from tidelens.sources.folders import delete, names_in, read_text, write_text

ENVELOPE = (
    "MessageType string, MetaData struct<MMSI: bigint, ShipName: string, time_utc: string>,"
    " Message struct<PositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: double, NavigationalStatus: int>,"
    " ShipStaticData: struct<Name: string, CallSign: string, ImoNumber: bigint, Type: int, Dimension: struct<A: double, B: double, C: double, D: double>>>"
)
POSITIONS = "mmsi bigint, ts timestamp, lat double, lon double, sog double, cog double, heading double, nav_status int"
VESSELS = "mmsi bigint, name string, callsign string, imo bigint, ship_type int, length_m double, width_m double, first_seen timestamp, last_seen timestamp"
LEDGER = "id string, session string, started_at timestamp, last_message_at timestamp, ended_at timestamp, bboxes string, messages bigint, host string"
RUNS = "session string, first timestamp, last timestamp, messages bigint"
#: Seconds without a message that end a session, as the live service has it.
IDLE_SECONDS = 120
# What the protocol sends for no value.
NO_SOG, NO_COG, NO_HEADING = 102.3, 360, 511


def messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds m, the envelope; lines that are no JSON and envelopes without MetaData are dropped without a word. The
    explode of one element keeps the optimizer from parsing a line again for each condition and column."""
    envelope = F.from_json(F.col(value), ENVELOPE, {"mode": "PERMISSIVE"})
    parsed = raw.select(*raw.columns, F.explode(F.array(envelope)).alias("m"))
    return parsed.filter(F.col("m.MetaData").isNotNull() & F.col("m.MetaData.MMSI").isNotNull()).drop(value)


def _unless(x: Column, none: Column) -> Column:
    return F.when(~none, x)


def positions_of(parsed: DataFrame, arrived: Column) -> DataFrame:
    """mmsi, ts (arrived), lat, lon, sog, cog, heading, nav_status, and the other columns of parsed. What the protocol
    sends for no speed, course or heading is null; its values for no place are kept."""
    r = "m.Message.PositionReport"
    rows = parsed.filter((F.col("m.MessageType") == "PositionReport") & F.col(r).isNotNull())
    sog, cog, heading = (F.col(f"{r}.{c}") for c in ("Sog", "Cog", "TrueHeading"))
    return rows.select(
        F.col("m.MetaData.MMSI").alias("mmsi"), arrived.alias("ts"), F.col(f"{r}.Latitude").alias("lat"), F.col(f"{r}.Longitude").alias("lon"),
        _unless(sog, sog >= NO_SOG).alias("sog"), _unless(cog, cog >= NO_COG).alias("cog"), _unless(heading, heading == NO_HEADING).alias("heading"), F.col(f"{r}.NavigationalStatus").alias("nav_status"), *(c for c in parsed.columns if c != "m"),
    )


def vessels_of(parsed: DataFrame, arrived: Column) -> DataFrame:
    """mmsi, name, callsign, imo, ship_type, length_m, width_m, seen_at, and the other columns of parsed."""
    s = "m.Message.ShipStaticData"
    rows = parsed.filter((F.col("m.MessageType") == "ShipStaticData") & F.col(s).isNotNull())
    side = lambda a, b: F.col(f"{s}.Dimension.{a}") + F.col(f"{s}.Dimension.{b}")
    return rows.select(
        F.col("m.MetaData.MMSI").alias("mmsi"), F.trim(f"{s}.Name").alias("name"), F.trim(f"{s}.CallSign").alias("callsign"), F.col(f"{s}.ImoNumber").alias("imo"), F.col(f"{s}.Type").alias("ship_type"),
        side("A", "B").alias("length_m"), side("C", "D").alias("width_m"), arrived.alias("seen_at"), *(c for c in parsed.columns if c != "m"),
    )


def event_time_positions(raw: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Reports by the time that their messages carry, one for each vessel and minute, late ones up to `late`. An
    extension: the collector itself goes by arrival."""
    at = F.try_to_timestamp(F.substring("m.MetaData.time_utc", 1, 19))
    rows = positions_of(messages(raw), at).filter("ts is not null").withColumn("ts", F.date_trunc("minute", F.col("ts")))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])


def sessions_of(reports: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """started, ended, messages: when somebody was listening, told from reports (ts) with longer gaps between them.

    Reports are first brought down to one row for each minute that has any, or each second for gaps below ten minutes; only those rows,
    whose number the time span bounds, are put in one order. Inside such a row there is no gap, as none is shorter than it.
    """
    if gap_minutes * 60 < 1:
        raise ValueError("a gap is a second or more")
    slot = "second" if gap_minutes < 10 else "minute"
    minutes = reports.groupBy(F.date_trunc(slot, F.col("ts")).alias("minute")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("messages"))
    order = Window.orderBy("minute")
    before = F.lag("ended").over(order)
    fresh = F.coalesce((F.unix_micros("started") - F.unix_micros(before) > int(gap_minutes * 60_000_000)).cast("int"), F.lit(1))
    return minutes.withColumn("session", fresh).withColumn("session", F.sum("session").over(order)).groupBy("session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("messages").alias("messages")).drop("session")


def live_sessions(rows: DataFrame, idle_seconds: float = IDLE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """host, started, ended and messages of each time of listening, out of a stream of messages (host, arrived), as soon as
    it is over: idle_seconds of silence end it, and `late` later it is told of. One row for each host is kept as state, whatever
    the number of messages. A message that comes just as the silence ends begins the next one."""
    window = F.session_window("arrived", f"{idle_seconds} seconds")
    told = rows.withWatermark("arrived", late).groupBy("host", window).agg(F.min("arrived").alias("started"), F.max("arrived").alias("last"), F.count("*").alias("messages"))
    return told.select("host", "started", F.col("session_window.end").alias("ended"), F.col("last").alias("last_message_at"), "messages")


def ledger_of(runs: DataFrame, sessions: DataFrame, idle_seconds: float | None) -> DataFrame:
    """The coverage ledger: one row for each time that somebody listened.

    runs: session, first, last and messages of intervals in which messages came. sessions: session, started_at (when it
    was opened, null if that is not known), closed_at (null while it runs), bboxes, host. A session listens from its
    opening to its close. With idle_seconds, so long a silence ends it: what comes later is a row of its own that begins
    with the next message, and a row ends idle_seconds after its last message, or after its opening, or with the close
    if that is earlier. The last row of a session that runs has no end.
    """
    opened = sessions.filter("started_at is not null").select("session", F.col("started_at").alias("first"), F.col("started_at").alias("last"), F.lit(0).cast("long").alias("messages"))
    # a message that is older than its session's opening was told of again, and opens nothing
    late = runs.join(sessions.select("session", "started_at"), "session", "left").withColumn("first", F.greatest("first", "started_at")).withColumn("last", F.greatest("last", "started_at")).drop("started_at")
    told = late.select("session", "first", "last", "messages").unionByName(opened)
    order = Window.partitionBy("session").orderBy("first", "last", "messages")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.lit(0) if idle_seconds is None else F.coalesce((F.unix_micros("first") - F.unix_micros(reach) > int(idle_seconds * 1e6)).cast("int"), F.lit(0))
    told = told.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = told.groupBy("session", "k").agg(F.min("first").alias("started_at"), F.max("last").alias("reach"), F.max(F.when(F.col("messages") > 0, F.col("last"))).alias("last_message_at"), F.sum("messages").alias("messages"))
    rows = rows.withColumn("next", F.lead("k").over(Window.partitionBy("session").orderBy("k"))).join(sessions.select("session", "closed_at", "bboxes", "host"), "session", "left")
    silent = F.lit(None).cast("timestamp") if idle_seconds is None else F.timestamp_micros(F.unix_micros("reach") + int(idle_seconds * 1e6))
    ended = F.when(F.col("next").isNotNull(), silent).when(F.col("closed_at").isNotNull(), F.greatest(F.least("closed_at", silent), F.col("started_at")))
    return rows.select(F.concat_ws("#", "session", F.col("k").cast("string")).alias("id"), "session", "started_at", "last_message_at", ended.alias("ended_at"), "bboxes", "messages", "host")


@dataclass
class Collector:
    """Where a collector keeps its tables, and how a flush gets there.

    A flush writes its reports (positions/flush=N), what it tells of vessels (vessels/flush=N) and when its messages came
    (runs/flush=N), and at last a small file in commits. Readers go by these files alone, so that a flush is visible
    whole or not at all, and one that was committed is not done again, whoever repeats it. Openings, closes and errors of
    sessions are such files too. compact() brings what many flushes wrote down to one table for each day that they touched.
    One collector at a time writes to a folder; any number may read.
    """

    spark: SparkSession
    folder: str
    host: str = "local"
    bboxes: str = "[]"
    keep_blank: bool = False
    session: str | None = None
    idle_seconds: float | None = IDLE_SECONDS
    compact_every: int = 200
    #: How far behind the newest arrival a line may arrive in a stream; see start().
    late: str = "10 minutes"
    _told: list[dict] | None = field(default=None, repr=False)

    # -- what was committed

    def _events(self, again: bool = False) -> list[dict]:
        """The commits by their number: few, as compacting folds those of flushes into one."""
        if self._told is None or again:
            found = [n for n in names_in(self.spark, f"{self.folder}/commits") if n.endswith(".json")]
            lines = self.spark.read.text([f"{self.folder}/commits/{n}" for n in found]).collect() if found else []
            told = sorted((json.loads(r.value) for r in lines), key=lambda e: e["n"])
            base = max((e["n"] for e in told if e["kind"] == "compact"), default=-1)
            self._told = [e for e in told if e["n"] >= base or e["kind"] not in ("flush", "compact")]
        return self._told

    def _commit(self, kind: str, **told) -> dict:
        events = self._events()
        event = {"n": max((e["n"] for e in events), default=-1) + 1, "kind": kind, **told}
        write_text(self.spark, f"{self.folder}/commits/{event['n']:012d}.json", json.dumps(event, default=lambda t: t.isoformat()))
        events.append(event)
        return event

    def _base(self, events: list[dict]) -> dict:
        return max((e for e in events if e["kind"] == "compact"), key=lambda e: e["n"], default={"n": -1, "days": {}, "done": {}, "rows": 0})

    def _table(self, name: str, schema: str, events: list[dict], days: tuple[str, str] | None = None) -> DataFrame:
        """What is committed of a table, with the number of the flush; days: only reports of these days are needed."""
        base = self._base(events)
        if name == "positions":
            folded = [f"{self.folder}/positions/upto={n}/day={d}" for d, n in base["days"].items() if days is None or days[0] <= d <= days[1]]
        else:
            folded = [f"{self.folder}/{name}/upto={base['n']}"] if base["n"] >= 0 else []
        flushes = [e["n"] for e in events if e["kind"] == "flush" and (days is None or (e["first"] is not None and e["first"][:10] <= days[1] and days[0] <= e["last"][:10]))]
        rows = self.spark.createDataFrame([], f"{schema}, flush bigint")
        if folded:
            rows = self.spark.read.schema(schema).parquet(*folded).withColumn("flush", F.lit(-1).cast("long"))
        if flushes:
            fresh = self.spark.read.schema(f"{schema}, flush bigint").option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/flush={n}" for n in flushes))
            rows = rows.unionByName(fresh) if folded else fresh
        return rows

    def positions(self) -> DataFrame:
        return self._table("positions", POSITIONS, self._events(again=True)).drop("flush")

    def vessels(self) -> DataFrame:
        """One row for each vessel: of each attribute the last value told, a blank text counting as none unless keep_blank."""
        rows = self._table("vessels", VESSELS, self._events(again=True))
        texts = {"name", "callsign"} if not self.keep_blank else set()

        def last(c: str) -> Column:
            there = F.col(c).isNotNull() & (F.trim(c) != "" if c in texts else F.lit(True))
            return F.max_by(F.when(there, F.col(c)), F.when(there, F.col("flush"))).alias(c)

        return rows.groupBy("mmsi").agg(*map(last, _ATTRIBUTES), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def _sessions(self, events: list[dict]) -> DataFrame:
        found: dict[str, dict] = {}
        for e in events:
            if e.get("session") is not None:
                own = found.setdefault(e["session"], {"session": e["session"], "started_at": None, "closed_at": None, "bboxes": e.get("bboxes", self.bboxes), "host": e.get("host", self.host)})
                if e["kind"] == "open":
                    own["started_at"] = e["at"]
                elif e["kind"] == "close" and own["closed_at"] is None:
                    own["closed_at"] = e["at"]
        rows = self.spark.createDataFrame(list(found.values()), "session string, started_at string, closed_at string, bboxes string, host string")
        return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "closed_at")})

    def coverage(self) -> DataFrame:
        """The ledger; see ledger_of(). What happens in one session changes no other, so times between two are not covered."""
        events = self._events(again=True)
        return ledger_of(self._table("runs", RUNS, events).drop("flush"), self._sessions(events), self.idle_seconds)

    def status(self) -> DataFrame:
        """One row for each session: id, started_at, last_message_at, ended_at, running, messages, rows_written and
        last_error; the last one is the collector's present state."""
        events = self._events(again=True)
        rows = self._table("runs", RUNS, events).groupBy("session").agg(F.max("last").alias("last_message_at"), F.sum("messages").alias("messages"))
        written: dict[str, int] = dict(self._base(events).get("written", {}))
        errors: dict[str, str] = {}
        for e in events:
            if e["kind"] == "flush":
                written[e["session"]] = written.get(e["session"], 0) + e["rows"]
            elif e["kind"] == "error":
                errors[e["session"]] = e["error"]
        more = self.spark.createDataFrame([(s, written.get(s, 0), errors.get(s)) for s in written.keys() | errors.keys()], "session string, rows_written bigint, last_error string")
        joined = self._sessions(events).join(rows, "session", "left").join(more, "session", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return joined.select("session", "started_at", "last_message_at", F.col("closed_at").alias("ended_at"), F.col("closed_at").isNull().alias("running"), zero("messages"), zero("rows_written"), "last_error")

    # -- sessions

    def open(self, started_at: datetime | None = None) -> str:
        """Begins a session of its own and returns its id."""
        self._events(again=True)
        self.session = f"s-{uuid.uuid4().hex}"
        self._commit("open", session=self.session, at=_instant(started_at), bboxes=self.bboxes, host=self.host)
        return self.session

    def close(self, ended_at: datetime | None = None) -> None:
        """The session's end; what comes later belongs to another. Without a session there is nothing to close."""
        if self.session is not None:
            self._commit("close", session=self.session, at=_instant(ended_at))
            self.session = None

    def failed(self, error: str) -> None:
        """Notes what ended the session, and closes it."""
        if self.session is not None:
            self._commit("error", session=self.session, at=_instant(None), error=error[:2000])
            self.close()

    # -- flushes

    def done(self, writer: str, number: int) -> bool:
        """Whether a flush was committed, in this session or an earlier one. A writer's numbers go up."""
        events = self._events()
        return number <= max((e["batch"] for e in events if e["kind"] == "flush" and e["writer"] == writer), default=self._base(events)["done"].get(writer, -1))

    def flush(self, batch: DataFrame, number: int, writer: str = "direct") -> None:
        """One flush: the last message of each vessel and minute, the last record of each vessel; what the archive has
        stays. batch: value, arrived, seq. Of the archive only the days are read that the batch's reports fall on. A flush
        that was committed is left as it is."""
        if self.done(writer, number):
            return
        batch = batch.persist()
        try:
            fresh = last_in_minute(positions_of(messages(batch.select("value", "arrived", "seq")), F.col("arrived")).drop("arrived"), "seq")
            first, last = fresh.agg(F.min("ts"), F.max("ts")).first()
            if first is not None:
                events = self._events()
                days = tuple(d.isoformat() for d in ((first - timedelta(1)).date(), (last + timedelta(1)).date()))  # whatever the zone
                known = self._table("positions", POSITIONS, events, days).filter(F.col("ts").between(F.lit(first), F.lit(last)))
                fresh = insert_ignore(known.drop("flush"), fresh)
            self._write(fresh, batch, number, writer)
        finally:
            batch.unpersist()

    def _write(self, fresh: DataFrame, lines: DataFrame, number: int, writer: str) -> None:
        """Writes a flush and commits it: reports that are new, and what the lines (value, arrived, seq) tell of vessels and of
        who listened. Messages count every line, also those that cannot be read."""
        self.session = self.session or f"s-{uuid.uuid4().hex}"
        n, of = max((e["n"] for e in self._events()), default=-1) + 1, {}
        for name in ("positions", "runs"):
            of[name] = Observation()
        told = fresh.select(*(c.split()[0] for c in POSITIONS.split(", "))).observe(of["positions"], F.count("*").alias("rows"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"))
        told.write.mode("overwrite").parquet(f"{self.folder}/positions/flush={n}")
        records = last_record(vessels_of(messages(lines.select("value", "arrived", "seq")), F.col("arrived")).drop("arrived"), "seq")
        records.select("mmsi", *_ATTRIBUTES, F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen")).write.mode("overwrite").parquet(f"{self.folder}/vessels/flush={n}")
        runs = sessions_of(lines.select(F.col("arrived").alias("ts")), (self.idle_seconds or IDLE_SECONDS) / 60)
        runs = runs.select(F.lit(self.session).alias("session"), F.col("started").alias("first"), F.col("ended").alias("last"), "messages").observe(of["runs"], F.sum("messages").alias("messages"))
        runs.write.mode("overwrite").parquet(f"{self.folder}/runs/flush={n}")
        self._commit("flush", session=self.session, writer=writer, batch=number, messages=of["runs"].get.get("messages") or 0, **({"rows": 0, "first": None, "last": None} | of["positions"].get))
        if sum(e["kind"] == "flush" for e in self._events()) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Folds all committed flushes: reports into tables of the days they fall on, vessels and runs into one table each. What was
        folded is deleted after the new tables are committed, so a reader that began before may have to begin again."""
        events = self._events(again=True)
        flushes, base = [e for e in events if e["kind"] == "flush"], self._base(events)
        if not flushes:
            return
        n = max(e["n"] for e in events) + 1
        upto = lambda name: f"{self.folder}/{name}/upto={n}"
        fresh = self.spark.read.schema(POSITIONS).parquet(*(f"{self.folder}/positions/flush={e['n']}" for e in flushes))
        touched = {r[0].isoformat() for r in fresh.select(F.col("ts").cast("date")).distinct().collect()}
        old = [f"{self.folder}/positions/upto={v}/day={d}" for d, v in base["days"].items() if d in touched]
        whole = fresh.unionByName(self.spark.read.schema(POSITIONS).parquet(*old)) if old else fresh
        # each day's reports lie together, by place in time, in as many files as they need
        whole.withColumn("day", F.col("ts").cast("date")).repartitionByRange("day", "ts").sortWithinPartitions("day", "ts", "mmsi").write.mode("overwrite").partitionBy("day").parquet(upto("positions"))
        self.vessels().write.mode("overwrite").parquet(upto("vessels"))
        self._joined_runs(self._table("runs", RUNS, events)).write.mode("overwrite").parquet(upto("runs"))
        done, written = dict(base["done"]), dict(base.get("written", {}))
        for e in flushes:
            done[e["writer"]] = max(done.get(e["writer"], -1), e["batch"])
            written[e["session"]] = written.get(e["session"], 0) + e["rows"]
        self._commit("compact", days=base["days"] | dict.fromkeys(touched, n), done=done, written=written)
        for e in flushes:
            for name in ("positions", "vessels", "runs"):
                delete(self.spark, f"{self.folder}/{name}/flush={e['n']}")
            delete(self.spark, f"{self.folder}/commits/{e['n']:012d}.json")
        for path in [*old, *(f"{self.folder}/{name}/upto={base['n']}" for name in ("vessels", "runs")), f"{self.folder}/commits/{base['n']:012d}.json"]:
            delete(self.spark, path)
        self._events(again=True)

    def _joined_runs(self, runs: DataFrame) -> DataFrame:
        """Runs with no longer silence between them than ends a session, as one."""
        order = Window.partitionBy("session").orderBy("first", "last")
        reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.coalesce((F.unix_micros("first") - F.unix_micros(reach) > int((self.idle_seconds or IDLE_SECONDS) * 1e6)).cast("int"), F.lit(1))
        numbered = runs.withColumn("k", fresh).withColumn("k", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy("session", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("messages").alias("messages")).drop("k")

    # -- streams

    def fresh_positions(self, rows: DataFrame) -> DataFrame:
        """Of a stream (value, arrived, seq): the last report of each vessel and minute in the flush that is the first to
        have one. Who was seen in which minute is kept as the stream's state and forgotten when the minute is `late` behind."""
        now = F.unix_micros(F.current_timestamp())  # the flush's time, the same when it is done again
        reports = positions_of(messages(rows), F.col("arrived")).withColumn("ts", F.date_trunc("minute", F.col("ts"))).withColumn("flushed", now).withWatermark("ts", self.late)
        rest = [c.split()[0] for c in POSITIONS.split(", ")[2:]]
        kept = reports.groupBy("mmsi", "ts").agg(F.max_by(F.struct(*rest, "flushed"), F.struct(-F.col("flushed"), "seq")).alias("r"))
        return kept.filter(F.col("r.flushed") == now).select("mmsi", "ts", *(f"r.{c}" for c in rest))

    def start(self, raw: DataFrame, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
        """Runs on a stream with column value, and arrived (else now) and seq (else arrival) if it has them. every: the
        time between flushes; None takes what is there and ends. Each start is a session of the ledger. Stop and start again
        with the same checkpoint.

        Vessels and minutes that were flushed are the stream's state, so a flush does not read the archive. The state of a
        minute is kept until arrivals are `late` beyond it; lines that arrive later than that, which only a column arrived of
        the stream's own can bring about, lose their reports.
        """
        self.open()
        rows = raw if "arrived" in raw.columns else raw.withColumn("arrived", F.current_timestamp())
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
        rows = rows.select("value", "arrived", "seq")
        fresh = self.fresh_positions(rows)
        lines = rows.select(F.lit(True).alias("line"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in POSITIONS.split(", ")), "value", "arrived", "seq")
        fresh = fresh.select(F.lit(False).alias("line"), *fresh.columns, F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp").alias("arrived"), F.lit(None).cast("long").alias("seq"))

        def take(batch: DataFrame, number: int) -> None:
            writer = json.loads(read_text(self.spark, f"{checkpoint}/metadata"))["id"]
            if self.done(writer, number):
                return
            batch = batch.persist()
            try:
                if batch.count():
                    self._write(batch.filter("not line"), batch.filter("line"), number, writer)
            finally:
                batch.unpersist()

        stream = fresh.unionByName(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(take)
        return (stream.trigger(availableNow=True) if every is None else stream.trigger(processingTime=every)).start()

    def stop(self, q: StreamingQuery, wait_seconds: float = 60) -> None:
        """Stops the stream and closes its session. A flush that is under way is waited for, up to wait_seconds; one that is broken
        off then is done again, once, by the next start with the same checkpoint."""
        until = time.monotonic() + wait_seconds
        while q.isActive and q.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)
        q.stop()
        self.close()


def _instant(at: datetime | None) -> str:
    """A time as text; one without a zone is the session's, as in Spark."""
    return (at or datetime.now(timezone.utc)).isoformat()


_ATTRIBUTES = tuple(c.split()[0] for c in VESSELS.split(", ")[1:-2])


class Supervisor:
    """Keeps a collector running as long as that is wanted: a stream that fails is noted in the status, and started again
    from its checkpoint after a while that doubles with each failure in a row, up to most_seconds."""

    def __init__(self, collector: Collector, start: Callable[[], StreamingQuery], retry_seconds: float = 5, most_seconds: float = 300) -> None:
        self.collector, self.start_stream, self.retry, self.most = collector, start, retry_seconds, most_seconds
        self.query: StreamingQuery | None = None

    @property
    def desired(self) -> str:
        """What was asked for last, by whomever: it is kept in the collector's folder."""
        return read_text(self.collector.spark, f"{self.collector.folder}/desired") or "stopped"

    def request(self, desired: str) -> None:
        if desired not in ("running", "stopped"):
            raise ValueError(f"a collector is running or stopped, not {desired!r}")
        write_text(self.collector.spark, f"{self.collector.folder}/desired", desired)

    def run(self, poll_seconds: float = 1) -> None:
        """Until `stopped` is asked for, or the stream ends by itself without a failure."""
        failures = 0
        while self.desired == "running":
            try:
                self.query = self.query or self.start_stream()
                if self.query.awaitTermination(poll_seconds):
                    self.collector.close()
                    return
                if self.query.lastProgress is not None:
                    failures = 0
            except Exception as e:  # noqa: BLE001
                self.collector.failed(str(e))
                self.query = None
                time.sleep(min(self.most, self.retry * 2**failures))
                failures += 1
        if self.query is not None:
            self.collector.stop(self.query)
            self.query = None


def status(q: StreamingQuery) -> dict:
    """What a running stream tells: whether it runs, its state, and the lines of its last flush."""
    last = q.lastProgress
    return {"running": q.isActive, "message": q.status["message"], "messages": None if last is None else last["numInputRows"], "error": None if q.exception() is None else str(q.exception())}
