"""Alert rules over metric series (A1-A3).

A rule is a SQL boolean over the sampled series columns (``value`` and the labels) that must
hold for ``for_duration`` before it fires.  Evaluation is gaps-and-islands on the sampled
series: a true sample starts or extends an island; a false sample, or a gap longer than the
sampling step, ends it.  Islands that lasted ``for_duration`` are FIRING (still open) or
RESOLVED (ended); an open island that has not lasted long enough is PENDING.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")
RULE_COLUMNS = ("rule_id", "name", "metric", "expression", "for_duration_s", "severity")


def check_rules(rules: DataFrame) -> DataFrame:
    """A1: name, expression and severity are required (first failing check wins)."""
    def empty(c):
        return F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = (F.when(empty("name"), F.lit("name is required"))
              .when(empty("expression"), F.lit("expression is required"))
              .when(empty("severity"), F.lit("severity is required")))
    return rules.withColumn("invalid_reason", reason)


def sample_series(points: DataFrame, step: str = "1 hour", name="name", value="value", ts="ts",
                  labels: list[str] | None = None) -> DataFrame:
    """The sampled series: mean value per (metric, labels, step bucket)."""
    labels = labels or []
    return points.groupBy(F.col(name).alias("metric"), *labels,
                          F.date_trunc(_trunc_unit(step), F.col(ts)).cast(points.schema[ts].dataType).alias("ts")) \
        .agg(F.avg(value).alias("value"))


def _trunc_unit(step: str) -> str:
    return {"1 hour": "hour", "1 day": "day", "1 minute": "minute"}[step]


def valid_rules(rules: list[dict]) -> list[dict]:
    """The rules that pass A1's checks; none at all is refused."""
    valid = [r for r in rules if all((r.get(c) or "").strip() for c in ("name", "expression", "severity"))]
    if not valid:
        raise ValueError("no valid rule")
    return valid


def evaluate_alerts(series: DataFrame, rules: list[dict], step_seconds: int, labels: list[str] | None = None,
                    as_of=None) -> DataFrame:
    """A2: alert instances per (rule, labels) series.

    ``rules`` is the (small) rule configuration; each valid rule becomes one predicate and the
    rules are evaluated over one scan of the series (union of per-rule projections).
    The evaluation time is the last sample of each series: an island still true there is open.
    With ``as_of`` (a time, or a one-row frame of one) it is that time: an island whose last true sample lies more than
    a step before it has ended.
    """
    labels = labels or []
    valid = valid_rules(rules)
    spark = series.sparkSession
    # the rule table is configuration (bounded by the number of rules): broadcast it and
    # evaluate every rule in one scan of the series; the condition is a CASE over rule ids
    rule_df = spark.createDataFrame(
        [(r["rule_id"], r["name"], r["severity"], int(r.get("for_duration_s", 0)), r["metric"]) for r in valid],
        "rule_id string, rule_name string, severity string, for_s int, metric string")
    cond = F.when(F.lit(False), F.lit(False))
    for r in valid:
        cond = cond.when(F.col("rule_id") == F.lit(r["rule_id"]), F.coalesce(F.expr(r["expression"]), F.lit(False)))
    s = series.join(F.broadcast(rule_df), "metric").select(
        "rule_id", "rule_name", "severity", "for_s", *labels, "ts", "value", cond.alias("cond"))
    key = ["rule_id", *labels]
    # the sampled series has at most one row per step, so a series is bounded by time/step
    w = Window.partitionBy(*key).orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    prev_t, prev_c = F.lag(micros).over(w), F.lag("cond").over(w)
    gap = micros - prev_t > F.lit(int(step_seconds) * 1_000_000)
    starts = F.col("cond") & (prev_c.isNull() | ~prev_c | gap)
    s = s.withColumn("_start", starts.cast("int")).withColumn("_next_t", F.lead(micros).over(w)) \
        .withColumn("_next_c", F.lead("cond").over(w))
    s = s.withColumn("_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = s.where("cond")
    isl = t.groupBy(*key, "_island").agg(
        F.first("rule_name").alias("rule_name"), F.first("severity").alias("severity"), F.first("for_s").alias("for_s"),
        F.min("ts").alias("active_at"), F.max("ts").alias("last_true_at"),
        F.max_by("value", "ts").alias("value"), F.max_by("_next_t", "ts").alias("_next_t"),
        F.max_by("_next_c", "ts").alias("_next_c"))
    last_true = F.unix_micros(F.col("last_true_at").cast("timestamp"))
    step_us = F.lit(int(step_seconds) * 1_000_000)
    ended = F.col("_next_t").isNotNull()
    if as_of is not None:
        isl = isl.crossJoin(F.broadcast(as_of.toDF("_as_of"))) if isinstance(as_of, DataFrame) else isl.withColumn("_as_of", F.lit(as_of))
        ended = ended | (last_true + step_us < F.unix_micros(F.col("_as_of").cast("timestamp")))
    ended_at_us = F.when(F.col("_next_t").isNotNull() & (F.col("_next_t") - last_true <= step_us), F.col("_next_t")) \
        .otherwise(last_true + step_us)
    lasted = (last_true - F.unix_micros(F.col("active_at").cast("timestamp"))) >= F.col("for_s").cast("bigint") * 1_000_000
    state = F.when(ended & lasted, F.lit("RESOLVED")).when(ended, F.lit(None)).when(lasted, F.lit("FIRING")).otherwise(F.lit("PENDING"))
    out = isl.select(*key, "rule_name", "severity", "active_at",
                     F.when(ended & lasted, F.timestamp_micros(ended_at_us).cast("timestamp_ntz")).alias("resolved_at"),
                     "value", state.alias("state"))
    return out.where(F.col("state").isNotNull())


def active_alerts(alerts: DataFrame, page: int = 1, size: int = 10, order=None) -> DataFrame:
    """A3: FIRING or PENDING only, paged over a total order."""
    from tidepool.plans.sqlapi import paginate
    act = alerts.where(F.col("state").isin("FIRING", "PENDING"))
    fixed = ("rule_id", "rule_name", "severity", "active_at", "resolved_at", "value", "state")
    labels = [f.name for f in alerts.schema.fields if f.name not in fixed and not f.dataType.simpleString().startswith("map")]
    return paginate(act, page, size, order or [("active_at", "DESC"), ("rule_id", "ASC"), *[(c, "ASC") for c in labels]])
