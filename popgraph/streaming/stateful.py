"""Stateful streams: trackers that follow events of a key in the order of event time, over micro-batches too.

Events wait in a list state, ``PACK`` of them an entry since each entry is a message of its
own to the state store, until the watermark has passed them; an event-time timer wakes the
key then. A key that has had no event for ``expire`` is
forgotten by a timer as well. These operators need the RocksDB state store; ``session``
gives a session that has it, in which the stream is to be built.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from popgraph.operators.panel import EVENT_STATES, phase_of

EXPIRE = "365 days"
#: State of a key beside its own values: the latest event and when the key is to be forgotten, in milliseconds.
_CLOCK = "seen long, forget long"
_WAITING = "pack binary"
PACK = 4096


def _packed(rows: list[tuple]) -> list[tuple]:
    """Entries of the list state that hold ``rows``."""
    return [(pickle.dumps(rows[k : k + PACK]),) for k in range(0, len(rows), PACK)]


def _plain(values: pd.Series) -> list:
    """Python values, None for nulls."""
    return [None if v is None or v != v else v for v in values.tolist()] if values.hasnans else values.tolist()


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that stateful operators need, and the settings of ``spark`` for shuffles and times."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class InOrder(StatefulProcessor):
    """Gives events (ts, id, kind, number) of a key to ``step`` in the order of (ts, id), once the watermark has passed them.

    ``fields``: DDL of the values kept, ``start``: these values for a new key; ``step``
    takes the values and an event and returns the new values and an output row or None;
    ``columns``: names of the output after the key.
    """

    fields = ""
    start: tuple = ()
    columns: tuple[str, ...] = ()

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def step(self, values: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getValueState("values", f"{self.fields}, {_CLOCK}")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for f in rows:
            micros = f["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            new += list(zip(micros.tolist(), *(_plain(f[c]) for c in ("id", "kind", "number")), strict=True))
        if new:
            self.waiting.appendList(_packed(new))
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
            *values, seen, forget = self.values.get() or (*self.start, 0, 0)
            seen = max(seen, max(r[0] for r in new) // 1000)
            if not forget:
                forget = seen + self.expire_ms
                self.handle.registerTimer(forget)
            self.values.update((*values, seen, forget))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.values.get()
        if held is None:
            return iter([])
        rows = sorted((r for (pack,) in self.waiting.get() for r in pickle.loads(pack)), key=lambda r: (r[0], r[1] is not None, r[1]))
        due = [r for r in rows if r[0] < now * 1000]
        *values, seen, forget = held
        out = []
        for r in due:
            values, said = self.step(tuple(values), r)
            if said is not None:
                out.append((key[0], *said))
        if due:
            rest = rows[len(due) :]
            if rest:
                self.waiting.put(_packed(rest))
                self.handle.registerTimer(max(rest[0][0] // 1000 + 1, now + 1))
            else:
                self.waiting.clear()
        if seen + self.expire_ms <= now and len(due) == len(rows):
            self.values.clear()
        else:
            if forget <= now:
                forget = max(seen + self.expire_ms, now + 1)
                self.handle.registerTimer(forget)
            self.values.update((*values, seen, forget))
        return iter([pd.DataFrame(out, columns=list(self.columns))]) if out else iter([])

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, span: str) -> int:
    return int(spark.sql(f"SELECT timestampdiff(MILLISECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {span})").first()[0])


def in_order(events: DataFrame, delay: str, key: Column, ts: Column, ident: Column, kind: Column, number: Column, processor: type[InOrder], shape: str, expire: str = EXPIRE, args: tuple = ()) -> DataFrame:
    """Outputs of ``processor`` (columns ``shape``) over a stream; events later than ``delay`` are dropped."""
    e = events.withColumn("_ts", ts.cast("timestamp")).withWatermark("_ts", delay)
    e = e.select(key.alias("key"), F.col("_ts").alias("ts"), ident.cast("long").alias("id"), kind.cast("string").alias("kind"), number.cast("double").alias("number"))
    made = processor(_milliseconds(events.sparkSession, expire), *args)
    return e.groupBy("key").transformWithStateInPandas(made, shape, "append", "EventTime")


class _Tracker(InOrder):
    fields, start = "last string, run int", ("S", 0)
    columns = ("agent_id", "event_id", "ts", "from_state", "to_state", "events_in_state")

    def step(self, values, event):
        (last, run), (ts, ident, kind, _) = values, event
        now = EVENT_STATES.get(kind, last)
        if now != last:
            return (now, 1), (ident, pd.Timestamp(ts, unit="us"), last, now, run)
        return (last, run + 1), None


TRACKED = "agent_id long, event_id long, ts timestamp, from_state string, to_state string, events_in_state int"


def state_tracker(events: DataFrame, delay: str = "1 day", expire: str = EXPIRE) -> DataFrame:
    """Transitions per entity in order of (ts, event_id); an entity forgotten after ``expire`` without events starts again as susceptible."""
    return in_order(events, delay, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type"), F.col("value"), _Tracker, TRACKED, expire)


class _Accumulator(InOrder):
    fields, start = "total double", (0.0,)
    columns = ("agent_id", "event_id", "total")

    def __init__(self, expire_ms: int, threshold: float):
        super().__init__(expire_ms)
        self.threshold = threshold

    def step(self, values, event):
        total = values[0] + (event[3] or 0.0)
        return ((0.0,), (event[1], total)) if total >= self.threshold else ((total,), None)


FIRED = "agent_id long, event_id long, total double"


def accumulator(events: DataFrame, threshold: float = 150.0, delay: str = "1 day", expire: str = EXPIRE) -> DataFrame:
    """(agent_id, event_id, total): where the summed values reach ``threshold`` and start again, in the order of ``state_tracker``; null values add nothing."""
    return in_order(events, delay, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type"), F.col("value"), _Accumulator, FIRED, expire, (threshold,))


class _Phases(InOrder):
    """Days come as events: ``number`` is the share active and ``id`` the active count."""

    fields, start = "history array<long>", ([],)
    columns = ("population", "day", "active", "phase")

    def step(self, values, event):
        ts, active, _, share = event
        history = [*(values[0] if values[0] is not None else []), active][-14:]
        before = history[-3] if len(history) > 2 else None
        return (history,), (pd.Timestamp(ts, unit="us").date(), active, phase_of(share, active, before))


PHASED = "population long, day date, active long, phase string"


def phase_tracker(days: DataFrame, delay: str = "1 day", expire: str = EXPIRE) -> DataFrame:
    """(population, day, active, phase) of every finished day, with 14 days of state per population.

    ``days``: population (an id), size, day, active; one row a day. They may come in any
    order and any number a batch: a day waits until the watermark has passed it.
    """
    share = F.when(F.col("size") > 0, F.col("active") / F.col("size")).otherwise(0.0)
    return in_order(days, delay, F.col("population"), F.col("day"), F.col("active"), F.lit(""), share, _Phases, PHASED, expire)


def finished_days(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(population, size, day, active) of closed days from a stream of (population, ts, state): one row an entity and day."""
    w = F.window("ts", "1 day").alias("w")
    active = F.count_if(F.col("state").isin("E", "I"))
    closed = events.withWatermark("ts", delay).groupBy(w, "population").agg(F.count(F.lit(1)).alias("size"), active.alias("active"))
    return closed.select("population", "size", F.window_time("w").alias("_time"), "active")


def phases_of_events(events: DataFrame, delay: str = "1 day", expire: str = EXPIRE) -> DataFrame:
    """Phases of the days that ``finished_days`` closes: two stateful operators in a row."""
    days = finished_days(events, delay)
    made = _Phases(_milliseconds(events.sparkSession, expire))
    share = F.when(F.col("size") > 0, F.col("active") / F.col("size")).otherwise(0.0)
    rows = days.select(F.col("population").alias("key"), F.col("_time").alias("ts"), F.col("active").alias("id"), F.lit("").alias("kind"), share.alias("number"))
    return rows.groupBy("key").transformWithStateInPandas(made, PHASED, "append", "EventTime")


class _Source(InOrder):
    """The earliest link into an infected (key): ``id`` is the source."""

    fields, start = "source long", (None,)
    columns = ("infected", "source", "ts")

    def step(self, values, event):
        if values[0] is not None:
            return values, None
        return (event[1],), (event[1], pd.Timestamp(event[0], unit="us"))


class _Tree(StatefulProcessor):
    """Infected of a source (key) in a map state, each once, and their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.infected = handle.getMapState("infected", "id long", "ts timestamp")
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.number.get()[0] if self.number.exists() else 0
        out = []
        # a source's links of one batch
        for r in pd.concat(list(rows)).sort_values(["ts", "infected"]).itertuples():
            if not self.infected.containsKey((r.infected,)):
                n += 1
                self.infected.updateValue((r.infected,), (r.ts.to_pydatetime(),))
                out.append((key[0], r.infected, r.ts, n))
        self.number.update((n,))
        return iter([pd.DataFrame(out, columns=["source", "infected", "ts", "n"])]) if out else iter([])

    def close(self) -> None:
        pass


def infection_sources(links: DataFrame, delay: str = "1 day", expire: str = EXPIRE) -> DataFrame:
    """(infected, source, ts): of all links (source, infected, ts) into an infected the earliest, by source among equals; repeats give nothing."""
    return in_order(links, delay, F.col("infected"), F.col("ts"), F.col("source"), F.lit(""), F.lit(0.0), _Source, "infected long, source long, ts timestamp", expire)


def infection_tree(sources: DataFrame) -> DataFrame:
    """(source, infected, ts, n) from a stream of (infected, source, ts): each infected of a source once, ``n`` counts them."""
    return sources.groupBy("source").transformWithStateInPandas(_Tree(), "source long, infected long, ts timestamp, n long", "append", "None")
