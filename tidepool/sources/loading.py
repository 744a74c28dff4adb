"""Table loads (L6-L11, L17-L21): delimited and JSON files with per-row rejects, load
predicates, filter ratio, load report, labelled loads, staged publish, time-partitioned
and bucketed writes, and plain scans.

Files are read with every column as a string plus a corrupt-record column; each column is
then ``try_cast`` to its target type, so a bad value rejects only its own row (also inside
a JSON array, where Spark's own reader would mark the whole file corrupt).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import spread_for_write

CORRUPT = "_corrupt_record"
REASON = "_reject_reason"


def _string_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields]
                        + [T.StructField(CORRUPT, T.StringType(), True)])


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast every string column to its type; the first column that fails names the reason."""
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed row"))
    casts = []
    for f in schema.fields:
        src = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            typed = src
        else:
            typed = F.trim(src).try_cast(f.dataType) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) \
                else F.from_json(src, f.dataType)
        bad = src.isNotNull() & typed.isNull()
        if not f.nullable:
            bad = bad | src.isNull()
        reason = reason.when(bad, F.lit(f"bad value in {f.name}"))
        casts.append(typed.alias(f.name))
    return raw.select(*casts, reason.alias(REASON))


def load_csv(spark: SparkSession, path: str, schema: T.StructType, column_separator: str = ",",
             row_delimiter: str | None = None, header: bool = False) -> DataFrame:
    """Delimited load; multi-character separators and row delimiters are allowed.

    Short and long rows (wrong field count) are flagged as malformed, per row.
    """
    reader = (spark.read.schema(_string_schema(schema)).option("sep", column_separator)
              .option("header", str(header).lower()).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true"))
    if row_delimiter:
        reader = reader.option("lineSep", row_delimiter)
    return _typed(reader.csv(path), schema)


def load_json(spark: SparkSession, path: str, schema: T.StructType, strip_outer_array: bool = False) -> DataFrame:
    """JSON lines, or files holding one outer array of objects (``strip_outer_array``)."""
    reader = (spark.read.schema(_string_schema(schema)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT))
    if strip_outer_array:
        reader = reader.option("multiLine", "true")
    return _typed(reader.json(path), schema)


def map_columns(df: DataFrame, exprs: list[str]) -> DataFrame:
    """Column list / derived columns at load time (SQL expressions)."""
    return df.selectExpr(*exprs)


def load_where(df: DataFrame, pred) -> DataFrame:
    """Mark rows the load predicate does not select (``_unselected``); they are not bad rows."""
    p = F.expr(pred) if isinstance(pred, str) else pred
    bad = F.col(REASON).isNotNull() if REASON in df.columns else F.lit(False)
    return df.withColumn("_unselected", ~bad & ~F.coalesce(p, F.lit(False)))


def load_counts(df: DataFrame) -> DataFrame:
    """L11 as a query: total / loaded / filtered (bad) / unselected rows, one aggregate."""
    bad = F.col(REASON).isNotNull() if REASON in df.columns else F.lit(False)
    uns = F.col("_unselected") if "_unselected" in df.columns else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~bad & ~uns).alias("loaded_rows"),
        F.count_if(bad).alias("filtered_rows"),
        F.count_if(uns).alias("unselected_rows"),
    )


class LoadRejected(Exception):
    pass


def check_filter_ratio(counts: dict, max_filter_ratio: float = 0.0) -> None:
    """Fail when bad / (total - unselected) > ratio (default 0: any bad row fails)."""
    denom = counts["total_rows"] - counts["unselected_rows"]
    ratio = (counts["filtered_rows"] / denom) if denom else 0.0
    if ratio > max_filter_ratio:
        raise LoadRejected(f"filter ratio {ratio:.4f} exceeds {max_filter_ratio}")


@dataclass
class LoadReport:
    """What a load did."""

    label: str
    status: str
    total_rows: int = 0
    loaded_rows: int = 0
    filtered_rows: int = 0
    unselected_rows: int = 0
    loaded_bytes: int = 0
    started_at: float = 0.0
    finished_at: float = 0.0
    path: str | None = None
    extra: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file through the cluster file system (atomic rename from a temp name)."""
    fs, p, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(path + f".tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(tmp, p):
        raise RuntimeError(f"could not publish {path}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p, _ = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def _split_observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The good, selected rows of a load, and the counts of all of them, gathered while they are written."""
    bad = F.col(REASON).isNotNull() if REASON in df.columns else F.lit(False)
    uns = F.col("_unselected") if "_unselected" in df.columns else F.lit(False)
    obs = Observation(f"load-{uuid.uuid4().hex}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("filtered_rows"),
                          F.count_if(uns).alias("unselected_rows"))
    return observed.where(~bad & ~uns).drop(*[c for c in (REASON, "_unselected") if c in df.columns]), obs


def _counted(obs: Observation, df: DataFrame) -> dict[str, int]:
    try:
        counts = {k: int(v) for k, v in obs.get.items()}
    except Exception:  # noqa: BLE001 - where the plan is folded away (no row can be good) nothing is observed
        counts = load_counts(df).first().asDict()
    return {**counts, "loaded_rows": counts["total_rows"] - counts["filtered_rows"] - counts["unselected_rows"]}


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def _hidden(name: str) -> bool:
    return name.startswith((".", "_")) and "=" not in name


def _move_into(spark: SparkSession, src: str, dst: str) -> None:
    """Rename what a writer left under ``src`` to the same places under ``dst``: whole folders where ``dst`` has none."""
    fs, s, jvm = _fs(spark, src)
    path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(dst))
    for st in fs.listStatus(s):
        name = st.getPath().getName()
        if _hidden(name):
            continue
        to = os.path.join(dst, name)
        if st.isDirectory() and fs.exists(path(to)):
            _move_into(spark, os.path.join(src, name), to)
        elif not fs.rename(st.getPath(), path(to)):
            raise RuntimeError(f"could not move {st.getPath()} to {to}")


def write_load(df: DataFrame, path: str, label: str, max_filter_ratio: float = 0.0, mode: str = "append",
               partition_by: list[str] | None = None) -> LoadReport:
    """One load in one pass: the good rows are written aside while an ``Observation`` counts them all; then
    the ratio is checked, and only a load that passes is moved to ``path`` (renames, no copies)."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    spark = df.sparkSession
    started = time.time()
    good, obs = _split_observed(df)
    aside = os.path.join(path, f"_aside-{uuid.uuid4().hex}")
    w = good.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(aside)
        counts = _counted(obs, df)
        check_filter_ratio(counts, max_filter_ratio)
        size = _bytes(spark, aside)
        if mode == "overwrite":
            fs, p, _ = _fs(spark, path)
            for st in fs.listStatus(p):
                if not _hidden(st.getPath().getName()):
                    fs.delete(st.getPath(), True)
        _move_into(spark, aside, path)
    finally:
        _delete(spark, aside)
    return LoadReport(label=label, status="PUBLISHED", started_at=started, finished_at=time.time(), path=path,
                      loaded_bytes=size, **counts)


# ---------------------------------------------------------------- labelled, staged loads

def _label_path(root: str, label: str) -> str:
    return os.path.join(root, "_labels", f"{label}.json")


def write_layout(spark: SparkSession, path: str, layout: dict) -> None:
    """What a reader must know of a stored table (bucket count, keys, parser), beside its files."""
    _write_text(spark, os.path.join(path, "_layout"), json.dumps(layout))


def drop_layout(spark: SparkSession, path: str) -> None:
    """Before a stored table is replaced: without a layout nothing reads a half-written one."""
    fs, p, _ = _fs(spark, os.path.join(path, "_layout"))
    fs.delete(p, False)


def read_layout(spark: SparkSession, path: str) -> dict:
    raw = _read_text(spark, os.path.join(path, "_layout"))
    if raw is None:
        raise ValueError(f"no layout is stored at {path}: it cannot be read safely")
    return json.loads(raw)


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` only if it does not exist, whole or not at all: written aside and renamed
    without overwriting (one step on a cluster file system; on a local disk a check and a rename)."""
    fs, p, jvm = _fs(spark, path)
    if fs.exists(p):
        return False
    tmp = jvm.org.apache.hadoop.fs.Path(path + f".tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    q = fs.makeQualified(p)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(q.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(tmp), q, none)
    except Exception:  # noqa: BLE001 - only a file that exists means someone else was first
        fs.delete(tmp, False)
        if not fs.exists(p):
            raise
        return False
    return _read_text(spark, path) == text


def _claim_path(root: str, label: str) -> str:
    return _label_path(root, label) + ".claim"


def release_label(spark: SparkSession, root: str, label: str) -> None:
    """Give up the claim of a load that died, so that its label can be loaded again; what it may have written is
    replaced by the next load.  A label that is loaded is refused."""
    if _exists(spark, _label_path(root, label)):
        raise ValueError(f"label {label!r} is loaded")
    _delete(spark, _claim_path(root, label))


def load_once(df: DataFrame, root: str, label: str, lease_s: float = 86_400.0, **kw) -> LoadReport:
    """A repeated label is a no-op that answers the earlier load's report.

    The label is claimed first with an atomic create, so two concurrent loads of one label
    cannot both write; the report is recorded after the data.  A claim without a report is a load that
    is running or died: it is refused until its lease of ``lease_s`` seconds has run out or the label is
    released (:func:`release_label`).  A load that lost its claim meanwhile writes nothing."""
    spark = df.sparkSession
    done, claim = _label_path(root, label), _claim_path(root, label)

    def earlier() -> LoadReport | None:
        prev = _read_text(spark, done)
        if prev is None:
            return None
        rep = LoadReport(**json.loads(prev))
        rep.extra = {**rep.extra, "repeated": True}
        return rep

    if (rep := earlier()) is not None:
        return rep
    held = _read_text(spark, claim)
    if held and held.startswith("{") and json.loads(held)["until"] < time.time():
        release_label(spark, root, label)
    own = json.dumps({"owner": uuid.uuid4().hex, "until": time.time() + lease_s})
    if not _create_once(spark, claim, own):
        raise RuntimeError(f"label {label!r} is being loaded (or a load died); release it first")
    if (rep := earlier()) is not None:  # loaded between the first look and the claim
        return rep
    aside = os.path.join(root, f"_aside-{uuid.uuid4().hex}")
    try:
        rep = write_load(df.withColumn("_load_label", F.lit(label)), aside, label, partition_by=["_load_label"], **kw)
        if _read_text(spark, claim) != own:
            raise RuntimeError(f"the claim of label {label!r} was lost; nothing was loaded")
        fs, p, jvm = _fs(spark, aside)
        for st in fs.listStatus(p):  # the label's one partition, if it has rows
            _delete(spark, os.path.join(root, "data", st.getPath().getName()))
        _move_into(spark, aside, os.path.join(root, "data"))
        rep.path = os.path.join(root, "data")
        _write_text(spark, done, json.dumps(rep.__dict__))
        return rep
    except Exception:
        if _read_text(spark, claim) == own:
            _delete(spark, claim)
        raise
    finally:
        _delete(spark, aside)


class StaleVersion(RuntimeError):
    """Another version was published since this one was begun."""


@dataclass
class Stage:
    root: str
    txn: str
    path: str
    state: str = "STAGED"
    report: LoadReport | None = None
    #: the version that was current when this one was begun
    base: int = 0


def stage(df: DataFrame, root: str, txn: str | None = None, max_filter_ratio: float = 0.0, base: int | None = None) -> Stage:
    """L18 begin, one pass: the good rows are written to a staging version while an
    ``Observation`` counts total / bad / unselected rows on the same scan; the ratio (L10)
    is checked afterwards and a failing load is abandoned before anyone can publish it.
    ``base`` is the version that ``df`` was made from, by default the current one."""
    spark = df.sparkSession
    txn = txn or uuid.uuid4().hex
    base = current_version(spark, root)[0] if base is None else base
    path = os.path.join(root, "_versions", txn)
    good, obs = _split_observed(df)
    good.write.mode("errorifexists").parquet(path)
    counts = _counted(obs, df)
    st = Stage(root, txn, path, base=base)
    try:
        check_filter_ratio(counts, max_filter_ratio)
    except LoadRejected:
        abandon(spark, st)
        raise
    st.report = LoadReport(label=txn, status="STAGED", path=path, loaded_bytes=_bytes(spark, path), **counts)
    return st


def publish(spark: SparkSession, st: Stage, audits=()) -> Stage:
    """L18 commit: run audits on the staged rows, then create the pointer entry of the version after the
    one the stage began from.  That create is the commit: of two writers with one base the first wins, the
    other is abandoned and refused (:class:`StaleVersion`)."""
    if st.state == "ABANDONED":
        raise ValueError(f"transaction {st.txn} was abandoned")
    staged = spark.read.parquet(st.path)
    for audit in audits:
        audit(staged)
    if current_version(spark, st.root)[0] != st.base or not _create_once(spark, os.path.join(st.root, "_CURRENT", f"{st.base + 1:020d}"), st.txn):
        abandon(spark, st)
        raise StaleVersion(f"{st.root}: another version was published since version {st.base}; begin again from it")
    st.state = "PUBLISHED"
    return st


def abandon(spark: SparkSession, st: Stage) -> Stage:
    """L18 abort: mark the staging version abandoned; abandoning twice is not an error."""
    if st.state == "PUBLISHED":
        raise ValueError(f"transaction {st.txn} is already published")
    if st.state != "ABANDONED":
        marker = os.path.join(st.path, "_ABANDONED")
        if not _exists(spark, marker):
            _write_text(spark, marker, st.txn)
    st.state = "ABANDONED"
    return st


def current_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, transaction) of the newest published version; (0, None) before the first."""
    fs, p, _ = _fs(spark, os.path.join(root, "_CURRENT"))
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    names = [n for n in names if ".tmp-" not in n]
    if not names:
        return 0, None
    last = max(names)
    # entries of the older form hold the transaction in their name
    return int(last.split("-", 1)[0]), last.split("-", 1)[1] if "-" in last else _read_text(spark, os.path.join(root, "_CURRENT", last))


def current_txn(spark: SparkSession, root: str) -> str | None:
    """The transaction of the newest published version, or None."""
    return current_version(spark, root)[1]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """Readers resolve the pointer once per query."""
    txn = current_txn(spark, root)
    if txn is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(os.path.join(root, "_versions", txn))


# ---------------------------------------------------------------- layout

def time_partition(ts: str, unit: str = "day") -> Column:
    if unit == "day":
        return F.to_date(F.col(ts))
    if unit == "hour":
        return F.date_format(F.col(ts), "yyyy-MM-dd-HH")
    raise ValueError("unit must be day or hour")


def write_by_time(df: DataFrame, path: str, ts: str, unit: str = "day", mode: str = "overwrite") -> None:
    """Partitioned by a derived day (``d``) or hour (``h``) column."""
    name = "d" if unit == "day" else "h"
    out = df.withColumn(name, time_partition(ts, unit))
    spread_for_write(out, [name]).write.mode(mode).partitionBy(name).parquet(path)


def read_time_range(spark: SparkSession, path: str, ts: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """L19 pruned read: a range on ``ts`` alone prunes nothing, so the matching predicate on
    the partition column is added (``PartitionFilters`` in the plan)."""
    df = spark.read.parquet(path)
    t = F.col(ts)
    pred = (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))
    if unit == "day":
        pred = pred & (F.col("d") >= F.to_date(F.lit(start))) & (F.col("d") <= F.to_date(F.lit(end)))
    else:
        pred = pred & (F.col("h") >= F.date_format(F.lit(start).cast("timestamp_ntz"), "yyyy-MM-dd-HH")) & \
            (F.col("h") <= F.date_format(F.lit(end).cast("timestamp_ntz"), "yyyy-MM-dd-HH"))
    return df.where(pred)


def write_bucketed(df: DataFrame, table: str, cols: list[str], n: int, sort: list[str] | None = None,
                   mode: str = "overwrite") -> None:
    """Bucketed catalog table so joins and aggregates on ``cols`` skip the shuffle."""
    w = df.write.mode(mode).bucketBy(n, *cols)
    if sort:
        w = w.sortBy(*sort)
    w.saveAsTable(table)


def bucket_skew(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """L20 report: rows per bucket (Spark's own bucket function ``pmod(hash(k), n)``)."""
    b = F.pmod(F.hash(*[F.col(c) for c in cols]), F.lit(n))
    return df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def scan(df: DataFrame, cols: list[str] | None = None, limit: int | None = None, offset: int = 0,
         order_by: list | None = None) -> DataFrame:
    """``SELECT cols ... LIMIT n OFFSET m`` over a stated order (a bare limit is arbitrary)."""
    out = df.select(*cols) if cols else df
    if limit is not None or offset:
        if not order_by:
            raise ValueError("limit/offset needs an order")
        from tidepool.plans.sqlapi import order_columns
        out = out.orderBy(*order_columns(order_by))
        if offset:
            out = out.offset(int(offset))
        if limit is not None:
            out = out.limit(int(limit))
    return out


def observe_load(df: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """L11 live form: the same counts gathered during the write itself."""
    bad = F.col(REASON).isNotNull() if REASON in df.columns else F.lit(False)
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("filtered_rows")), obs
