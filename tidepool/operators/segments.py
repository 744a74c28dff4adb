"""An inverted index that grows (T18): append-only segments, delete marks, and a manifest.

    root/postings/segment=<s>/bucket=<b>   postings (index.build_inverted_index), sorted by token
    root/rows/segment=<s>                  a row per (row, field): its key and length
    root/marks/mark=<m>                    keys whose rows in older segments are deleted
    root/manifests/<txn>                   which segments and marks are live
    root/_CURRENT/<version>                the version pointers (loading.publish's commit)

Segments and marks get rising numbers; a mark deletes its keys from the segments before it, so a row can
come back later.  Every change writes new files and then commits a manifest; of two writers with one
base the second takes the new one as its base and commits again, as appends and marks do not depend on each
other; a merge whose inputs have changed is refused.  Readers see one manifest.  Readers' plans hold the
live segments as literals, so the others' folders, and the buckets without the looked-up tokens, are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import index as ix
from tidepool.operators.relational import broadcast_if_small
from tidepool.operators.search import SearchTable
from tidepool.session import spread_for_write
from tidepool.sources import loading

KEY = ["source_table", "id", "tie"]
EMPTY = {"segments": {}, "marks": [], "next": 1}


def manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, {segments: number -> rows, marks: numbers, next, buckets, parser})."""
    version, txn = loading.current_version(spark, root)
    return version, EMPTY if txn is None else json.loads(loading._read_text(spark, os.path.join(root, "manifests", txn)))


def _commit(spark: SparkSession, root: str, change: Callable[[dict], dict], tries: int = 20) -> dict:
    """Apply ``change`` to the newest manifest until it is committed on the version it was made from."""
    for _ in range(tries):
        version, now = manifest(spark, root)
        new, txn = change(json.loads(json.dumps(now))), uuid.uuid4().hex
        loading._write_text(spark, os.path.join(root, "manifests", txn), json.dumps(new))
        if loading._create_once(spark, os.path.join(root, "_CURRENT", f"{version + 1:020d}"), txn):
            return new
    raise loading.StaleVersion(f"{root}: other writers committed {tries} versions meanwhile")


def _reserve(spark: SparkSession, root: str, count: int = 1) -> int:
    """The first of ``count`` numbers that no other writer gets."""
    return _commit(spark, root, lambda m: {**m, "next": m["next"] + count})["next"] - count


def _write_segment(spark: SparkSession, root: str, number: int, postings: DataFrame, lengths: DataFrame, buckets: int) -> int:
    own = f"segment={number}"
    p = postings.withColumn("bucket", ix.token_bucket(F.col("token"), buckets))
    spread_for_write(p, ["bucket"]).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(
        os.path.join(root, "postings", own))
    lengths.write.parquet(os.path.join(root, "rows", own))
    rows = spark.read.parquet(os.path.join(root, "rows", own))
    twice = rows.groupBy("field", *KEY).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"table {twice[0]['source_table']}: id {twice[0]['id']} with tie {twice[0]['tie']} is not unique")
    return rows.count()


def append(spark: SparkSession, root: str, tables: list[SearchTable], buckets: int = ix.TOKEN_BUCKETS, parser: str = "standard",
           replace: bool = False) -> int:
    """Index the rows of ``tables`` as one new segment; with ``replace`` rows of the same keys in older segments are
    deleted by the same commit.  The first append sets the bucket count and the parser of the index, which later
    ones must share; keys that an older segment holds are refused unless they are replaced."""
    _, now = manifest(spark, root)
    layout = {"buckets": now.get("buckets", int(buckets)), "parser": now.get("parser", parser)}
    if layout["parser"] != parser:
        raise ValueError(f"the index was built with parser {layout['parser']!r}, not {parser!r}")
    postings, lengths = ix.build_inverted_index(tables, parser)
    number = _reserve(spark, root, 2)  # the mark comes before its segment
    n = _write_segment(spark, root, number + 1, postings, lengths, layout["buckets"])
    keys = spark.read.parquet(os.path.join(root, "rows", f"segment={number + 1}")).select(*KEY).distinct()
    if replace:
        keys.write.parquet(os.path.join(root, "marks", f"mark={number}"))

    def change(m: dict) -> dict:
        if not replace and m["segments"]:
            there = read_rows(spark, root, m).select(*KEY).join(keys, KEY, "left_semi").limit(1).collect()
            if there:
                raise ValueError(f"table {there[0]['source_table']}: id {there[0]['id']} is indexed already; append with replace")
        return {**m, **layout, "segments": {**m["segments"], str(number + 1): n}, "marks": [*m["marks"], number] if replace else m["marks"]}
    _commit(spark, root, change)
    return number + 1


def delete(spark: SparkSession, root: str, keys: DataFrame) -> int:
    """Delete the rows of (source_table, id, tie) from all segments there are."""
    number = _reserve(spark, root)
    keys.select(*KEY).distinct().write.parquet(os.path.join(root, "marks", f"mark={number}"))
    _commit(spark, root, lambda m: {**m, "marks": [*m["marks"], number]})
    return number


def _alive(spark: SparkSession, root: str, df: DataFrame, m: dict) -> DataFrame:
    """Rows (with segment) of live segments that no later mark deletes."""
    df = df.where(F.col("segment").isin([int(s) for s in m["segments"]]))
    marks = [x for x in m["marks"] if any(int(s) < x for s in m["segments"])]
    if not marks:
        return df
    paths = [os.path.join(root, "marks", f"mark={x}") for x in marks]
    gone = spark.read.option("basePath", os.path.join(root, "marks")).parquet(*paths)
    # the last mark of a key decides for all older segments
    gone = broadcast_if_small(gone.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max("mark").alias("_mark")))
    same = F.lit(True)
    for k in KEY:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return df.join(gone, same & (F.col("segment") < F.col("_mark")), "left_anti")


def _segment_frame(spark: SparkSession, root: str, part: str) -> DataFrame:
    return spark.read.option("basePath", os.path.join(root, part)).parquet(os.path.join(root, part))


def read_rows(spark: SparkSession, root: str, m: dict | None = None) -> DataFrame:
    """(source_table, field, id, tie, length, segment) of the live rows."""
    m = m or manifest(spark, root)[1]
    return _alive(spark, root, _segment_frame(spark, root, "rows"), m)


def read_postings(spark: SparkSession, root: str, m: dict | None = None) -> DataFrame:
    """The live postings, for ``index.lookup``, ``search_index``, ``bm25`` and ``boolean.search_postings``."""
    m = m or manifest(spark, root)[1]
    if not m["segments"]:
        raise FileNotFoundError(f"no segment under {root}")
    return ix._with_layout(_alive(spark, root, _segment_frame(spark, root, "postings"), m), "bucket",
                           {"buckets": m["buckets"], "parser": m["parser"]})


def read_stats(spark: SparkSession, root: str, m: dict | None = None) -> DataFrame:
    """(source_table, field, n_docs, avgdl) of the live rows."""
    return ix.field_stats(read_rows(spark, root, m))


def small_segments(m: dict, fan_in: int = 8) -> list[int]:
    """Segments worth merging: of those within a factor of ``fan_in`` in rows, ``fan_in`` or more, the smallest such tier."""
    tiers: dict[int, list[int]] = {}
    for s, n in m["segments"].items():
        tier = 0
        while n >= fan_in ** (tier + 1):
            tier += 1
        tiers.setdefault(tier, []).append(int(s))
    return next((sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= fan_in), [])


def merge(spark: SparkSession, root: str, segments: list[int] | None = None) -> int | None:
    """Write the live rows of ``segments`` (all by default) as one segment in their place.  Marks that no live segment
    is older than are dropped.  Refused if one of the inputs was merged by another writer meanwhile."""
    _, m = manifest(spark, root)
    inputs = sorted(int(s) for s in (m["segments"] if segments is None else segments))
    if not inputs:
        return None
    part = {**m, "segments": {str(s): m["segments"][str(s)] for s in inputs}}
    number = _reserve(spark, root)
    postings, rows = read_postings(spark, root, part), read_rows(spark, root, part)
    n = _write_segment(spark, root, number, postings.drop("segment", "bucket"), rows.drop("segment"), m["buckets"])
    def change(now: dict) -> dict:
        if any(str(s) not in now["segments"] for s in inputs):
            raise loading.StaleVersion(f"{root}: a segment to merge was merged meanwhile")
        kept = {s: k for s, k in now["segments"].items() if int(s) not in inputs}
        # a mark of a lower number, set meanwhile, would miss the merged rows
        if any(x < number and x not in m["marks"] for x in now["marks"]):
            raise loading.StaleVersion(f"{root}: rows of the segments to merge were deleted meanwhile")
        live = {**kept, str(number): n}
        return {**now, "segments": live, "marks": [x for x in now["marks"] if any(int(s) < x for s in live)]}
    _commit(spark, root, change)
    return number


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the folders of segments and marks that the newest manifest does not hold.  Only when no reader of an
    older manifest and no writer is at work."""
    _, m = manifest(spark, root)
    live = {"postings": {f"segment={s}" for s in m["segments"]}, "rows": {f"segment={s}" for s in m["segments"]},
            "marks": {f"mark={x}" for x in m["marks"]}}
    for part, names in live.items():
        fs, p, _ = loading._fs(spark, os.path.join(root, part))
        for st in fs.listStatus(p) if fs.exists(p) else []:
            if st.getPath().getName() not in names:
                fs.delete(st.getPath(), True)
