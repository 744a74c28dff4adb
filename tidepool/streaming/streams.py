"""Structured Streaming forms of the batch jobs.

Sources are file streams here (no broker jar is installed); a Kafka-style source plugs in by
``format``/``options``.  Sinks write through ``foreachBatch`` to paths keyed by the query's id and the batch id, so a
retried micro-batch overwrites its own output and no other query's.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidepool.operators import alerts as al
from tidepool.operators import metrics as mt
from tidepool.operators import views as vw
from tidepool.sources import ingest, loading


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need ``TIMESTAMP`` (parquet fixtures hold ``TIMESTAMP_NTZ``); session time is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, options: dict | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path)


# ---------------------------------------------------------------- R1 ingest

def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint; a new checkpoint is a new query."""
    return json.loads(loading._read_text(spark, os.path.join(checkpoint, "metadata")))["id"]


def ingest_batch(batch: DataFrame, batch_id: int, sink: str, dead_letter: str, query: str = "direct") -> None:
    """R1 micro-batch: validate (L1), valid rows routed by type (L5), rejects with reason.

    Output paths carry the query's id and the batch id: a replayed batch replaces its own files,
    and a second query on the same sink adds to it."""
    own = os.path.join(f"query_id={query}", f"batch_id={batch_id}")
    v = ingest.validate_events(batch).persist()
    try:
        good = v.where(F.col("reject_reason").isNull()).drop("reject_reason")
        good.write.mode("overwrite").partitionBy("data_type").parquet(os.path.join(sink, own))
        bad = v.where(F.col("reject_reason").isNotNull())
        bad.write.mode("overwrite").parquet(os.path.join(dead_letter, own))
    finally:
        v.unpersist()


def ingest_stream(src: DataFrame, sink: str, dead_letter: str, checkpoint: str, trigger_once: bool = True):
    """Queue -> validate -> route -> table, continuously (checkpointed, replay-safe)."""
    w = src.writeStream.foreachBatch(lambda df, bid: ingest_batch(
        df, bid, sink, dead_letter, query_id(df.sparkSession, checkpoint))) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


# ---------------------------------------------------------------- R2 dedup

def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """R2: each key (producer sequence id) once, state bounded by the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def dedup_batch(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """R2 batch twin: of the rows of a key the least by ``order`` stays (any one without it; a
    mergeable minimum, so a hot key is combined before the shuffle)."""
    if not order:
        return df.dropDuplicates(keys)
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


# ---------------------------------------------------------------- R3 late data

def split_late(batch: DataFrame, batch_id: int, ts: str, delay_seconds: int, state_path: str, on_time_path: str,
               late_path: str, query: str = "direct") -> None:
    """R3 in ``foreachBatch`` before any stateful step: rows older than (high-water mark -
    delay) go to the late side table, counted and kept, never dropped.  The high-water mark
    is a one-row table per query and batch id (the query's latest committed one is used).  Outputs
    are keyed by query and batch, so a replayed batch replaces its own rows and a second query on
    the same tables adds to them."""
    spark = batch.sparkSession
    hw, own = None, os.path.join(f"query_id={query}", f"batch_id={batch_id}")
    if loading._exists(spark, os.path.join(state_path, f"query_id={query}")):
        marks = spark.read.schema("high_water timestamp, query_id string, batch_id long").parquet(state_path)
        hw = marks.where((F.col("query_id") == query) & (F.col("batch_id") < batch_id)).agg(F.max("high_water")).first()[0]
    b = batch.persist()
    try:
        limit = None if hw is None else hw - pd.Timedelta(seconds=delay_seconds)
        late = F.lit(False) if limit is None else F.col(ts) < F.lit(limit)
        b.where(~late).write.mode("overwrite").parquet(os.path.join(on_time_path, own))
        b.where(late).write.mode("overwrite").parquet(os.path.join(late_path, own))
        new_hw = b.agg(F.max(ts).alias("m")).first()["m"]
        top = max([x for x in (hw, new_hw) if x is not None], default=None)
        spark.createDataFrame([(top,)], "high_water timestamp").write.mode("overwrite").parquet(os.path.join(state_path, own))
    finally:
        b.unpersist()


def split_late_stream(src: DataFrame, ts: str, delay_seconds: int, state_path: str, on_time_path: str, late_path: str, checkpoint: str):
    """R3 as a running query (checkpointed, replay-safe)."""
    return src.writeStream.foreachBatch(lambda df, bid: split_late(
        df, bid, ts, delay_seconds, state_path, on_time_path, late_path, query_id(df.sparkSession, checkpoint))) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- R4 windows

def live_histogram(df: DataFrame, col: str, ts: str, length: str, slide: str | None = None, bounds=mt.DEFAULT_BOUNDS,
                   labels: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """The histogram (M3) of each closed window, live: (window_start, window_end, labels, le, bucket_count, sum, count).
    The state of a window and label set is one count per bound, whatever its rows."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    rows = df.withWatermark(ts, delay).withColumn("_w", w)
    h = mt.histogram(rows, col, bounds, ["_w", *(labels or [])])
    return h.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(labels or []),
                    "le", "bucket_count", "sum", "count")


def live_summary(df: DataFrame, col: str, ts: str, length: str, slide: str | None = None, objectives=None,
                 labels: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """The summary (M4; with ``slide`` M5) of each closed window, live: (window_start, window_end, labels, quantile,
    value, sum, count).  The state of a window and label set is one quantile sketch of bounded size; ranks
    lie within the objectives' errors as in :func:`metrics.sketch_states`."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    rows = df.withWatermark(ts, delay).withColumn("_w", w)
    own = ["_w", *(labels or [])]
    q = mt.sketch_quantiles(mt.sketch_states(rows, col, own, objectives), own, objectives)
    return q.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(labels or []),
                    "quantile", "value", "sum", "count")


def windowed_counts(df: DataFrame, ts: str, length: str, slide: str | None = None, by: list[str] | None = None,
                    delay: str = "1 hour", value: str | None = None) -> DataFrame:
    """Tumbling (or sliding) window counts with a watermark, for append mode."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    return df.withWatermark(ts, delay).groupBy(w.alias("window"), *(by or [])).agg(*aggs)


# ---------------------------------------------------------------- R5 per-key order

def ordered_per_key(batch: DataFrame, key: str, seq: str, partitions: int | None = None) -> DataFrame:
    """All messages of a key in one partition, in sequence order (key-shared delivery)."""
    r = batch.repartition(partitions, F.col(key)) if partitions else batch.repartition(F.col(key))
    return r.sortWithinPartitions(key, seq)


# ---------------------------------------------------------------- R6, R7

def deliverable(df: DataFrame, as_of, event_time: str = "event_time", deliver_at: str | None = "deliver_at",
                deliver_after_s: str | None = None) -> DataFrame:
    """R6 batch: messages due at ``as_of`` (deliver-at, or event time + deliver-after)."""
    due = F.col(deliver_at) if deliver_at else F.col(event_time)
    if deliver_after_s:
        due = F.col(event_time) + F.make_dt_interval(secs=F.col(deliver_after_s).cast("decimal(18,6)"))
    return df.withColumn("due_at", due).where(F.col("due_at") <= F.lit(as_of).cast(df.schema[event_time].dataType))


def retry_split(df: DataFrame, attempts: str = "attempts", max_attempts: int = 3, failed_at: str | None = None,
                delay_s: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(redeliver, dead letter): rows that reached ``max_attempts`` go to the dead letter.  With
    ``failed_at`` (the time of the failed delivery) the others are due ``delay_s`` seconds after
    it: their ``due_at`` goes to :func:`deliverable`.  A row without attempts has made none."""
    dead = F.coalesce(F.col(attempts), F.lit(0)) >= F.lit(max_attempts)
    again = df.where(~dead)
    if failed_at:
        again = again.withColumn("due_at", F.col(failed_at) + F.make_dt_interval(secs=F.lit(delay_s).cast("decimal(18,6)")))
    return again, df.where(dead)


# ---------------------------------------------------------------- R8 publish

def to_messages(df: DataFrame, key: str, cols: list[str], event_time: str | None = None,
                properties: dict | None = None) -> DataFrame:
    """Payload (JSON of the columns), key, properties and event time as message columns."""
    props = F.create_map(*[x for k, v in (properties or {}).items() for x in (F.lit(k), F.lit(v))]) if properties \
        else F.create_map().cast("map<string,string>")
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(c) for c in cols])).alias("value"),
                     props.alias("properties"),
                     (F.col(event_time) if event_time else F.current_timestamp()).alias("event_time"))


def publish(msgs: DataFrame, path: str, checkpoint: str, fmt: str = "json", options: dict | None = None):
    """R8 sink: files here; a broker sink by ``fmt``/``options`` (e.g. a Kafka topic)."""
    w = msgs.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    return w.trigger(availableNow=True).start()


# ---------------------------------------------------------------- V4

def view_refresh_batch(batch: DataFrame, batch_id: int, root: str, name: str, keys: list[str],
                       measures: list[vw.Measure], query: str = "direct") -> None:
    """V4: fold one micro-batch into the incremental view; a query's replayed batch is skipped.

    Every version stores the last batch of each query that is folded into it, and the publish is
    the single commit point: a replay after a crash anywhere before the publish folds the batch
    again into the previous version; a replay after it finds its batch recorded and does nothing.
    A new checkpoint is a new query, whose batches count from 0 beside the others'."""
    spark = batch.sparkSession
    done = vw.progress(spark, root, name)
    if done.get(query, -1) >= batch_id:
        return
    vw.refresh_incremental(spark, root, name, batch, keys, measures, done={**done, query: batch_id})


def view_refresh_stream(src: DataFrame, root: str, name: str, keys: list[str], measures: list[vw.Measure],
                        checkpoint: str):
    return src.writeStream.foreachBatch(lambda df, bid: view_refresh_batch(
        df, bid, root, name, keys, measures, query_id(df.sparkSession, checkpoint))) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- A4 stream alerts

ALERT_STATE = "active_us long, last_true_us long, last_value double, last_us long, last_cond boolean"
ALERT_OUT = "active_at timestamp, resolved_at timestamp, value double, state string"


def _alert_fn(step_us: int, names: list[str]):
    def fn(key, pdfs, state):
        if state.exists:
            active, last_true, last_val, last_us, last_cond = state.get
        else:
            active = last_true = last_us = None
            last_val, last_cond = None, False
        out = []

        def emit(st, resolved=None):
            out.append((*key, pd.Timestamp(active, unit="us"), None if resolved is None else pd.Timestamp(resolved, unit="us"),
                        last_val, st))

        rows = pd.concat(list(pdfs)).sort_values("us")
        need = int(rows["for_us"].iloc[0])
        for us, cond, val in zip(rows["us"].tolist(), rows["cond"].tolist(), rows["value"].tolist()):
            if last_us is not None and us <= last_us:
                # a sample at or before the series' last processed time: reported, not folded in
                out.append((*key, pd.Timestamp(us, unit="us"), None, float(val), "LATE_SAMPLE"))
                continue
            if active is not None:
                # any next sample ends an island unless it continues it
                continues = bool(cond) and last_cond and (us - last_us <= step_us)
                if not continues:
                    if last_true - active >= need:
                        emit("RESOLVED", us if us - last_true <= step_us else last_true + step_us)
                    else:
                        emit("INACTIVE")  # retracts a PENDING row sent at an earlier batch end
                    active = None
            if cond:
                if active is None:
                    active = us
                last_true, last_val = us, float(val)
            last_us, last_cond = us, bool(cond)
        if active is not None:
            emit("FIRING" if last_true - active >= need else "PENDING")
        state.update((active, last_true, last_val, last_us, last_cond))
        if out:
            yield pd.DataFrame(out, columns=[*names, "active_at", "resolved_at", "value", "state"])
    return fn


def stream_alerts(samples: DataFrame, rules: list[dict], step_seconds: int, labels: list[str] | None = None) -> DataFrame:
    """A4: the A2 state machine, live.  Input: a stream of sampled series points
    (metric, labels, ts, value) - windowed aggregates, not raw rows.  Output (update mode): the
    current state of every island touched by a micro-batch (INACTIVE retracts a pending
    island that ended before firing); the last row per (rule_id, labels, active_at), INACTIVE
    dropped, equals A2 on the same samples.  State is per (rule, labels) series, and all rules
    are judged in one read of the stream.  A sample at or before the last processed time of its
    series comes out as LATE_SAMPLE (counted, not lost) and leaves the state alone.  As in A2
    an island is open until a later sample of its series ends it."""
    labels = labels or []
    valid = al.valid_rules(rules)
    judged = F.array(*[F.struct(
        F.lit(r["metric"]).alias("metric"), F.lit(r["rule_id"]).alias("rule_id"),
        F.lit(int(r.get("for_duration_s", 0)) * 1_000_000).cast("long").alias("for_us"),
        F.coalesce(F.expr(r["expression"]), F.lit(False)).alias("cond")) for r in valid])
    rows = samples.select("metric", *labels, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value",
                          F.explode(judged).alias("rule")).where("rule.metric = metric").select(
        "rule.rule_id", *labels, "us", "value", "rule.for_us", "rule.cond")
    key = ["rule_id", *labels]
    out = "".join(f"`{n}` {t}, " for n, t in rows.select(*key).dtypes) + ALERT_OUT
    return rows.groupBy(*key).applyInPandasWithState(
        _alert_fn(int(step_seconds) * 1_000_000, key), out, ALERT_STATE, "update", GroupStateTimeout.NoTimeout)
