"""Cross-table full-text search (T7-T17, T21, T23) by scan.

Every table is read once: the match predicate, time range and equality filters are one
``where``; the rows are projected to the common hit schema and the tables are combined
with ``unionByName``.  Ordering and paging run after the union, over a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import text as tx
from tidepool.plans import sqlapi

HIT_COLUMNS = ("source_table", "id", "score", "document", "hit_fields", "ts", "tie")
DEFAULT_ORDER = (("score", "DESC"), ("source_table", "ASC"), ("id", "ASC"), ("tie", "ASC"))


@dataclass
class SearchTable:
    """One searchable table: its rows, the fields to search, and how a hit is named."""

    name: str
    df: DataFrame
    fields: list[str] | None = None     # None -> all string columns (T23)
    id_col: str | None = None            # None -> the id rule (T10)
    tiebreak: tuple[str, ...] = ()       # extra columns that make (table, id, tie) unique
    ts_col: str | None = None            # time column for T13 and the hit timestamp


@dataclass
class SearchReport:
    skipped: list = field(default_factory=list)


def searchable_fields(df: DataFrame) -> list[str]:
    """With no fields given, every string column is searchable."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def hit_id_column(df: DataFrame) -> str | None:
    """The column named ``id`` or ending in ``_id`` (case-insensitive); the last wins."""
    found = None
    for name in df.columns:
        low = name.lower()
        if low == "id" or low.endswith("_id"):
            found = name
    return found


def _hit_id(t: SearchTable) -> Column:
    name = t.id_col or hit_id_column(t.df)
    if name is None:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def _tie(t: SearchTable) -> Column:
    if not t.tiebreak:
        return F.lit("")
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in t.tiebreak])


def row_filter(t: SearchTable, time_range=None, filters=None) -> Column:
    """Half-open time range on the table's time column AND equality (or list)
    filters; both reach the parquet scan as pushed filters."""
    pred = F.lit(True)
    if time_range is not None:
        if t.ts_col is None:
            raise ValueError(f"table {t.name} has no time column for the time range")
        start, end = time_range
        ts = F.col(t.ts_col)
        if start is not None:
            pred = pred & (ts >= F.lit(start))
        if end is not None:
            pred = pred & (ts < F.lit(end))
    for k, v in (filters or {}).items():
        if isinstance(v, (list, tuple, set)):
            pred = pred & F.col(k).isin(list(v))
        else:
            pred = pred & (F.col(k) == F.lit(v))
    return pred


def table_filter(t: SearchTable, fields, toks, mode, parser, time_range=None, filters=None) -> Column:
    """The where-clause of one table: (field1 OR field2 ...) AND time range AND filters."""
    return tx.match_fields(fields, toks, mode, parser) & row_filter(t, time_range, filters)


def _score(fields, toks, parser, score: str) -> Column:
    if score == "const":
        return F.lit(1.0).cast("double")
    if score == "tf":
        return reduce(lambda a, b: a + b, [tx.token_count(f, toks, parser) for f in fields]).cast("double")
    raise ValueError("score must be 'const' or 'tf' for scan search; bm25 needs the index (index.search_index)")


def table_hits(t: SearchTable, keywords: str, toks, mode="any", parser="standard", time_range=None,
               filters=None, score="const", document=True) -> DataFrame:
    fields = t.fields or searchable_fields(t.df)
    if not fields:
        raise ValueError(f"table {t.name} has no searchable field")
    missing = [f for f in fields if f not in t.df.columns]
    if missing:
        raise ValueError(f"table {t.name} has no column(s) {missing}")
    rows = t.df.where(table_filter(t, fields, toks, mode, parser, time_range, filters))
    doc = F.to_json(F.struct(*[F.col(c) for c in t.df.columns])) if document else F.lit(None).cast("string")
    return rows.select(
        F.lit(t.name).alias("source_table"),
        _hit_id(t).alias("id"),
        _score(fields, toks, parser, score).alias("score"),
        doc.alias("document"),
        tx.hit_fields(fields, keywords).alias("hit_fields"),
        (F.col(t.ts_col).cast("timestamp_ntz") if t.ts_col else F.lit(None).cast("timestamp_ntz")).alias("ts"),
        _tie(t).alias("tie"),
    )


def search(tables: list[SearchTable], keywords: str, *, recall_priority: bool = True, parser: str = "standard",
           time_range=None, filters=None, score: str = "const", document: bool = True, on_error: str = "raise", report: SearchReport | None = None) -> DataFrame:
    """Hits of every table, tagged with the table, in one plan.

    ``recall_priority`` True -> any keyword token (T4), False -> all tokens in one field (T5).
    ``on_error='skip'`` leaves out tables that fail to resolve and lists them in ``report``.
    """
    if not tables:
        raise ValueError("at least one table must be given")
    if on_error == "skip" and report is None:
        raise ValueError("on_error='skip' needs a report, or tables would go missing unseen")
    toks = tx.keyword_tokens(keywords, parser)
    mode = "any" if recall_priority else "all"
    parts = []
    for t in tables:
        try:
            parts.append(table_hits(t, keywords, toks, mode, parser, time_range, filters, score, document))
        except (AnalysisException, ValueError) as e:
            if on_error != "skip":
                raise
            if report is not None:
                report.skipped.append((t.name, str(e)))
    if not parts:
        raise ValueError("no table could be searched")
    return reduce(lambda a, b: a.unionByName(b), parts)


def top_hits_per_table(hits: DataFrame, k: int, sort=None) -> DataFrame:
    """T17 as a report: each table's first ``k`` hits in the hit order (a search itself leaves none out)."""
    w = Window.partitionBy("source_table").orderBy(*sqlapi.order_columns(order_hits(sort)))
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= int(k)).drop("_k")


def order_hits(sort=None) -> list:
    """caller's sort fields, then the fixed tie-break (table, id, tie) for a total order."""
    sort = list(sort or DEFAULT_ORDER[:1])
    names = {s[0] if isinstance(s, (tuple, list)) else s for s in sort}
    for k in ("source_table", "id", "tie"):
        if k not in names:
            sort.append((k, "ASC"))
    return sort


def _hits(tables, keywords, index=None, **kw) -> DataFrame:
    if index is None:
        return search(tables, keywords, **kw)
    from tidepool.operators.index import search_with_index
    if kw.get("score", "const") != "const":
        raise ValueError("the index path supports the const score; use index.bm25 for ranking")
    return search_with_index(tables, index, keywords, kw.get("recall_priority", True), kw.get("parser", "standard"),
                             kw.get("document", False), time_range=kw.get("time_range"), filters=kw.get("filters"))


def search_page(tables, keywords, page=1, size=10, sort=None, max_size=None, index=None, **kw) -> DataFrame:
    """The page is cut after merging and global ordering.  With ``index`` (postings of a
    written inverted index) the hits come from token lookups instead of scanning the texts."""
    return sqlapi.paginate(_hits(tables, keywords, index, **kw), page, size, order_hits(sort), max_size)


def search_fetch(tables, keywords, page=1, size=10, sort=None, max_size=None, index=None, **kw) -> sqlapi.Page:
    """T16 with ``total_hits`` counted before the cut, in the same pass."""
    return sqlapi.fetch_page(_hits(tables, keywords, index, **kw), page, size, order_hits(sort), max_size)


def search_long(tables: list[SearchTable], keywords: str, *, recall_priority: bool = True,
                parser: str = "standard") -> DataFrame:
    """One row per (table, field) hit with the matched content.

    Each table is scanned once: its fields are unpivoted to (field, value) rows with
    ``explode(array(struct))`` and matched row by row, instead of one scan per field.
    """
    toks = tx.keyword_tokens(keywords, parser)
    one = tx.match_any if recall_priority else tx.match_all
    parts = []
    for t in tables:
        fields = t.fields or searchable_fields(t.df)
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("content")) for f in fields])
        long = t.df.select(_hit_id(t).alias("id"), _tie(t).alias("tie"), F.explode(pairs).alias("p"))
        parts.append(
            long.where(one(F.col("p.content"), toks, parser)).select(
                F.lit(t.name).alias("source_table"), "id", "tie", F.col("p.field").alias("field"),
                F.col("p.content").alias("content"), tx.snippet(F.col("p.content"), keywords).alias("snippet"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def log_search(df: DataFrame, *, ts_col: str, level_col: str, message_col: str, levels=None, time_range=None,
               k: int, keywords: str | None = None, tiebreak: str | None = None, parser: str = "standard") -> DataFrame:
    """Newest first, level and time filter, optional text; the limit is the feature (top-k)."""
    pred = F.lit(True)
    if levels:
        pred = pred & F.col(level_col).isin(list(levels))
    if time_range is not None:
        start, end = time_range
        if start is not None:
            pred = pred & (F.col(ts_col) >= F.lit(start))
        if end is not None:
            pred = pred & (F.col(ts_col) < F.lit(end))
    if keywords:
        pred = pred & tx.match_any(message_col, keywords, parser)
    order = [F.col(ts_col).desc_nulls_last()]
    if tiebreak:
        order.append(F.col(tiebreak).desc_nulls_last())
    return df.where(pred).orderBy(*order).limit(int(k))
