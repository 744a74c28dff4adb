"""Mappings from the driver tables to the model inputs (FIXTURES.md section 4).

Each function reads whole tables and derives the model rows with column expressions, so
the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.search import SearchTable
from tidepool.session import load

# The rule that marks bad raw events in the events fixture
# (event_id % 50 -> 0 empty source, 1 empty type, 2 NULL timestamp, 3 NULL data).
BAD_MODULUS = 50


def search_tables(spark: SparkSession, sf_dir: str, with_part: bool = False) -> list[SearchTable]:
    tabs = [
        SearchTable("documents", load(spark, sf_dir, "documents"), ["text"]),
        SearchTable("conversations", load(spark, sf_dir, "conversations"), ["text"], tiebreak=("turn",)),
        SearchTable("benchmark", load(spark, sf_dir, "benchmark"), ["text"]),
    ]
    if with_part:
        tabs.append(SearchTable("part", load(spark, sf_dir, "part"), ["p_name"], id_col="p_partkey"))
    return tabs


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> raw events, with the bad rows of the fixture rule."""
    e = load(spark, sf_dir, "events")
    r = F.col("event_id") % BAD_MODULUS
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(r == 0, F.lit("")).otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("data_source_id"),
        F.when(r == 1, F.lit("")).otherwise(F.col("event_type")).alias("data_type"),
        F.when(r == 2, F.lit(None)).otherwise(F.col("ts")).alias("ts"),
        F.when(r == 3, F.lit(None)).otherwise(F.col("props")).alias("data"),
        F.lit(None).cast("binary").alias("raw_payload"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 2000).cast("decimal(18,6)"))).alias("received_at"),
        F.col("event_id"),
        F.col("value"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> metric points: name = event_type, labels {user: user_id}."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("name"),
        F.col("value"),
        F.col("user_id").cast("string").alias("user"),
        F.col("ts"),
        F.col("event_id"),
    )


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("component_name"),
        F.lit("user").alias("component_type"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("checked_at"),
        F.col("event_id"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> query log: group = event_type, start = ts, duration = value seconds, scan_rows = props.k."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("group_name"),
        F.col("ts").alias("start_ts"),
        F.col("value").alias("duration_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("scan_rows"),
        F.col("user_id"),
    )


# Task states given to event types in the task-transition fixture.
TASK_STATE_OF_EVENT = {
    "signup": "PENDING",
    "view": "RUNNING",
    "purchase": "SUCCESS",
    "error": "FAILED",
    "click": "CANCELLED",
}


def task_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    m = F.create_map(*[x for k, v in TASK_STATE_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    return e.select(
        F.col("user_id").alias("task_id"),
        m[F.col("event_type")].alias("state"),
        F.col("ts"),
        F.col("event_id"),
    )
