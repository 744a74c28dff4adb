"""Stream operators with keyed state and event-time timers: delayed delivery (R6) and alerts that end by time (A4).

State lies in the session's RocksDB state store, so what is held need not fit in memory, and comes back
from the checkpoint after a restart.  The clock of a query is the greatest event time seen.  A row must
never be dropped for being late, so the watermark itself is set far back (``LAG``) and the handlers add
that lag again.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepool.operators import alerts as al

# the processors travel whole: the process that prepares them on the driver does not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: how far the watermark stays behind the clock: rows older than that alone would be dropped
LAG = dt.timedelta(days=10_000)
LAG_MS = int(LAG.total_seconds()) * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful(writer):
    """Start a stream writer whose plan has timers: with the state store they need.  The query keeps the
    setting for its life; the session gets its own back."""
    conf = writer._spark.conf
    old = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        if old is None:
            conf.unset(STORE)
        else:
            conf.set(STORE, old)


def on_clock(df: DataFrame, ts: str) -> DataFrame:
    """``df`` on the clock of its column ``ts`` (a TIMESTAMP); a null time does not move it."""
    return df.withWatermark(ts, f"{LAG.days} days")


def _clock_ms(timer_values) -> int | None:
    """The clock in milliseconds; None before the first batch has ended."""
    wm = timer_values.getCurrentWatermarkInMs()
    return wm + LAG_MS if wm > 0 else None


class _Timed(StatefulProcessor):
    def _wake(self, at_ms: int | None) -> None:
        """One timer, at the clock time given; none with None."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(max(1, at_ms - LAG_MS))

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- R6

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


class _Deliver(_Timed):
    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def _release(self, rows, clock: int | None) -> Iterator[Row]:
        stay, first = [], None
        for r in rows:
            due_ms = -(-r[-1] // 1000)
            if clock is not None and due_ms <= clock:
                yield Row(**dict(zip(self.schema.names, r, strict=True)))
            else:
                stay.append(tuple(r))
                first = due_ms if first is None else min(first, due_ms)
        if stay:
            self.held.put(stay)
        else:
            self.held.clear()
        self._wake(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = list(self.held.get()) if self.held.exists() else []
        yield from self._release([*old, *[tuple(r)[2:] for r in rows]], _clock_ms(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(list(self.held.get()) if self.held.exists() else [], _clock_ms(timerValues))


def delayed_delivery(messages: DataFrame, event_time: str = "event_time", deliver_at: str | None = None,
                     deliver_after_s: str | None = None, slot_seconds: int = 3600, spread: int = 8) -> DataFrame:
    """R6 live: every message once, when the stream's clock reaches its due time: the column ``deliver_at``, or
    ``event_time`` plus ``deliver_after_s`` seconds; ``due_at`` is added.

    Messages whose time has come pass at once, others are held in state until their timer.  State
    is per slot of ``slot_seconds`` of due times and one of ``spread`` parts of it, so a hot key's
    messages lie in many small groups, and a group leaves the state with its last message.  The
    clock is the greatest event time of the batches before; equal to the batch form (``deliverable``)
    at that time.  A message without a due time is due at once.
    """
    due = F.col(deliver_at) if deliver_at else F.col(event_time)
    if deliver_after_s:
        due = F.col(event_time) + F.make_dt_interval(secs=F.col(deliver_after_s).cast("decimal(18,6)"))
    names = messages.columns
    rows = messages.withColumn(event_time, F.col(event_time).cast("timestamp")).withColumn("due_at", due.cast("timestamp"))
    rows = rows.withColumn("_due_us", F.coalesce(F.unix_micros("due_at"), F.lit(0)))
    # maps, lists and structs are held as their JSON text
    nested = [f for f in messages.schema.fields if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    for f in nested:
        rows = rows.withColumn(f.name, F.to_json(F.struct(F.col(f.name).alias("v")), _JSON))
    rows = on_clock(rows, event_time).select(
        F.expr(f"_due_us div {int(slot_seconds) * 1_000_000}").alias("_slot"),
        F.pmod(F.xxhash64(*names), F.lit(int(spread))).cast("int").alias("_part"), *names, "due_at", "_due_us")
    own = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(*names, "due_at", "_due_us").schema.fields])
    out = rows.groupBy("_slot", "_part").transformWithState(
        statefulProcessor=_Deliver(own), outputStructType=own, outputMode="Append", timeMode="EventTime").drop("_due_us")
    for f in nested:
        out = out.withColumn(f.name, F.from_json(f.name, T.StructType([T.StructField("v", f.dataType)]), _JSON)["v"])
    return out


# ---------------------------------------------------------------- A4

_EPOCH, _US = dt.datetime.fromtimestamp(0, dt.UTC), dt.timedelta(microseconds=1)


def _series_of(rule_id: T.DataType) -> T.StructType:
    """The state of the series of one label set: a row per rule, and the one timer."""
    one = T.StructType([T.StructField("rule_id", rule_id), T.StructField("for_us", T.LongType()),
                        T.StructField("active_us", T.LongType()), T.StructField("true_us", T.LongType()),
                        T.StructField("value", T.DoubleType()), T.StructField("last_us", T.LongType()),
                        T.StructField("last_cond", T.BooleanType()), T.StructField("closed_us", T.LongType())])
    return T.StructType([T.StructField("rules", T.ArrayType(one)), T.StructField("timer_ms", T.LongType())])


class _Alerts(_Timed):
    """The (rule, labels) series of one label set.  Every call on the state is a message to the JVM and back, so they share a
    value and a timer: per batch a label set costs one read, one write and one change of its timer, however many rules it has."""

    def __init__(self, out: T.StructType, n_labels: int, rules: list[tuple], step_us: int, delay_us: int, idle_us: int):
        self.names, self.n_labels, self.schema = out.names, n_labels, _series_of(out["rule_id"].dataType)
        self.rules, self.step, self.delay, self.idle = rules, step_us, delay_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", self.schema)

    def _clock_us(self, timer_values) -> int | None:
        ms = _clock_ms(timer_values)
        return None if ms is None else ms * 1000 - self.delay

    def _row(self, key, rule, active, resolved, value, state) -> Row:
        at = lambda us: None if us is None else dt.datetime.fromtimestamp(us // 1_000_000, dt.UTC) + dt.timedelta(microseconds=us % 1_000_000)
        return Row(**dict(zip(self.names, (rule, *key[:self.n_labels], at(active), at(resolved), value, state), strict=True)))

    def _held(self) -> tuple[dict, int | None]:
        """(state by rule, the timer that is set)."""
        got = self.series.get()
        return ({}, None) if got is None else ({r[0]: tuple(r)[1:] for r in got[0]}, got[1])

    def _hold(self, held: dict, timer: int | None, fired: int | None = None) -> None:
        """Writes the state, and sets the timer at the first time at which one of the series needs it.  ``fired`` is removed by Spark."""
        # an island ends when no sample came within a step of its last; then the idle series is forgotten
        ends = [true + self.step if active is not None else last + self.idle for _, active, true, _, last, _, _ in held.values()]
        first = max(1, (min(ends) + self.delay) // 1000 + 1 - LAG_MS) if ends else None
        if held:
            self.series.update(([(rule, *one) for rule, one in held.items()], first))
        else:
            self.series.clear()
        if first != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = self._clock_us(timerValues)
        held, timer = self._held()
        of_rule = {}
        for r in rows:
            rule, for_us = self.rules[r["rule"]]
            us = None if r["ts"] is None else (r["ts"] - _EPOCH) // _US
            of_rule.setdefault(rule, []).append((us, bool(r["cond"]), float(r["value"]), for_us))
        for rule, got in of_rule.items():
            _, active, true, value, last, cond, closed = held.get(rule, (None, None, None, None, None, False, None))
            got.sort()
            need = got[0][3]
            for us, now, v, _ in got:
                floor = max([x for x in (last, closed) if x is not None], default=None)
                if (floor is not None and us <= floor) or (last is None and clock is not None and us < clock - self.idle):
                    yield self._row(key, rule, us, None, v, "LATE_SAMPLE")
                    continue
                if active is not None and not (now and cond and us - last <= self.step):
                    if true - active >= need:
                        yield self._row(key, rule, active, us if us - true <= self.step else true + self.step, value, "RESOLVED")
                    else:
                        yield self._row(key, rule, active, None, value, "INACTIVE")
                    active = None
                if now:
                    if active is None:
                        active = us
                    true, value = us, v
                last, cond = us, now
            if active is not None:
                yield self._row(key, rule, active, None, value, "FIRING" if true - active >= need else "PENDING")
            if last is not None:
                held[rule] = (need, active, true, value, last, cond, closed)
        if held:
            self._hold(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = self._clock_us(timerValues)
        held, timer = self._held()
        if not held or clock is None:
            return
        kept = {}
        for rule, (need, active, true, value, last, cond, closed) in held.items():
            if active is not None and clock > true + self.step:
                closed = true + self.step
                if true - active >= need:
                    yield self._row(key, rule, active, closed, value, "RESOLVED")
                else:
                    yield self._row(key, rule, active, None, value, "INACTIVE")
                active, cond = None, False
            if active is not None or clock <= last + self.idle:
                kept[rule] = (need, active, true, value, last, cond, closed)
        self._hold(kept, timer, expiredTimerInfo.getExpiryTimeInMs())


def timed_alerts(samples: DataFrame, rules: list[dict], step_seconds: int, labels: list[str] | None = None,
                 delay_seconds: int = 0, idle_seconds: int | None = None) -> DataFrame:
    """A4 with timers: as ``streams.stream_alerts``, and an island also ends when the stream's clock (the greatest
    sample time over all series, less ``delay_seconds``) has passed its last sample by more than a step, though no
    later sample of its series comes.  The last row per (rule_id, labels, active_at), INACTIVE dropped, equals A2
    evaluated as of that clock.

    A series without a sample for ``idle_seconds`` (a day unless given, a step at least) leaves the state.  A sample at or before the
    last processed time of its series, within an island's end that a timer has declared, or, where
    the series is not known, more than ``idle_seconds`` behind the clock, comes out as LATE_SAMPLE.
    """
    labels = labels or []
    valid = al.valid_rules(rules)
    idle = max(int(step_seconds), 86_400 if idle_seconds is None else int(idle_seconds))
    # without labels a rule is a group, so that the rules are spread over tasks
    key = labels or ["rule_id"]
    judged = F.array(*[F.struct(
        F.lit(r["metric"]).alias("metric"), F.lit(i).alias("rule"), F.lit(r["rule_id"]).alias("rule_id"),
        F.coalesce(F.expr(r["expression"]), F.lit(False)).alias("cond")) for i, r in enumerate(valid)])
    rows = on_clock(samples.withColumn("ts", F.col("ts").cast("timestamp")), "ts").select(
        "metric", *labels, "ts", F.col("value").cast("double").alias("value"), F.explode(judged).alias("rule")).where(
        "rule.metric = metric").select("rule.rule_id", *labels, "ts", "value", "rule.rule", "rule.cond")
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.select("rule_id", *labels).schema.fields],
                        T.StructField("active_at", T.TimestampType()), T.StructField("resolved_at", T.TimestampType()),
                        T.StructField("value", T.DoubleType()), T.StructField("state", T.StringType())])
    # a row names its rule by its place, which costs the worker less to read than the rule's id and parameters
    return rows.select(*key, "ts", "value", "rule", "cond").groupBy(*key).transformWithState(
        statefulProcessor=_Alerts(out, len(labels), [(r["rule_id"], int(r.get("for_duration_s", 0)) * 1_000_000) for r in valid],
                                  int(step_seconds) * 1_000_000, int(delay_seconds) * 1_000_000, idle * 1_000_000),
        outputStructType=out, outputMode="Update", timeMode="EventTime")
