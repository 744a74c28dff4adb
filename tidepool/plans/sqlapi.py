"""SQL door and result paging.

``run_sql`` hands text and named parameters to Spark SQL (Catalyst plans it); paging always
runs over a total order so that pages never overlap or skip rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100
DIRECTIONS = ("ASC", "DESC")


def run_sql(spark: SparkSession, sql: str, params: dict | None = None, database: str | None = None,
            allow_duplicate_names: bool = False) -> DataFrame:
    """Run SQL text with named parameters (``:name``; tables via ``IDENTIFIER(:t)``)."""
    if sql is None or not sql.strip():
        raise ValueError("SQL must not be empty")
    if database:
        spark.catalog.setCurrentDatabase(database)
    df = spark.sql(sql, args=params) if params else spark.sql(sql)
    if not allow_duplicate_names:
        seen = set()
        for c in df.columns:
            if c.lower() in seen:
                raise ValueError(f"duplicate output column {c!r}; alias it")
            seen.add(c.lower())
    return df


def normalize_page(page: int | None, size: int | None, max_size: int | None = None) -> tuple[int, int]:
    """Page counts from 1 (below -> 1); size below 1 -> 10; above ``max_size`` is refused."""
    page = 1 if page is None or page < 1 else int(page)
    size = DEFAULT_PAGE_SIZE if size is None or size < 1 else int(size)
    if max_size is not None and size > max_size:
        raise ValueError(f"page size {size} is above the limit {max_size}")
    return page, size


def _order_col(field, direction: str = "ASC", nulls: str = "last") -> Column:
    d = direction.upper()
    if d not in DIRECTIONS:
        raise ValueError(f"sort direction must be ASC or DESC, got {direction!r}")
    c = F.col(field) if isinstance(field, str) else field
    if d == "ASC":
        return c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first()
    return c.desc_nulls_last() if nulls == "last" else c.desc_nulls_first()


def order_columns(fields, nulls: str = "last") -> list[Column]:
    """``[(field, 'ASC'|'DESC'), ...]`` or plain names -> sort columns with explicit null order."""
    out = []
    for f in fields:
        if isinstance(f, (tuple, list)):
            out.append(_order_col(f[0], f[1] if len(f) > 1 else "ASC", nulls))
        else:
            out.append(_order_col(f, "ASC", nulls))
    return out


def sort_by(df: DataFrame, fields, nulls: str = "last") -> DataFrame:
    """S3: multi-field sort; any direction other than ASC/DESC is refused."""
    return df.orderBy(*order_columns(fields, nulls))


def paginate(df: DataFrame, page: int | None, size: int | None, order_by, max_size: int | None = None) -> DataFrame:
    """Rows of one page.  ``order_by`` must be a total order (add a unique tie-break).

    ``orderBy().offset().limit()`` plans as a per-partition top-(offset+size) heap merged
    on one task, so no full sort of the input happens.
    """
    if not order_by:
        raise ValueError("paging needs an order")
    page, size = normalize_page(page, size, max_size)
    ordered = df.orderBy(*order_columns(order_by))
    off = (page - 1) * size
    return (ordered.offset(off) if off else ordered).limit(size)


def page_after(df: DataFrame, order_by, after: tuple | None, size: int) -> DataFrame:
    """Keyset paging: the ``size`` rows that follow the row whose order values are ``after``.

    Deep pages cost the same as the first one (a filter plus a top-``size``), unlike
    ``offset``, whose per-partition heaps grow with the offset.  ``order_by`` must be a total
    order without NULLs in its columns."""
    cols = order_columns(order_by)
    if after is not None:
        specs = [(f[0], (f[1] if len(f) > 1 else "ASC").upper()) if isinstance(f, (tuple, list)) else (f, "ASC")
                 for f in order_by]
        if len(after) != len(specs):
            raise ValueError("after needs one value per order column")
        # (a, b, c) > (x, y, z) in the order's directions, as an OR of prefix-equal comparisons
        pred = F.lit(False)
        for i, (name, d) in enumerate(specs):
            term = (F.col(name) > F.lit(after[i])) if d == "ASC" else (F.col(name) < F.lit(after[i]))
            for j in range(i):
                term = (F.col(specs[j][0]) == F.lit(after[j])) & term
            pred = pred | term
        df = df.where(pred)
    return df.orderBy(*cols).limit(int(size))


@dataclass
class Page:
    rows: list
    total: int
    page: int
    size: int

    @property
    def total_pages(self) -> int:
        return total_pages_value(self.total, self.size)


def fetch_page(df: DataFrame, page: int | None, size: int | None, order_by, max_size: int | None = None) -> Page:
    """S2 with the total: one pass; the total is counted by an ``Observation`` on the same scan
    that feeds the top-k, so the input is read once."""
    page, size = normalize_page(page, size, max_size)
    obs = Observation("page_total")
    observed = df.observe(obs, F.count(F.lit(1)).alias("total"))
    rows = paginate(observed, page, size, order_by).collect()
    return Page(rows=rows, total=int(obs.get["total"]), page=page, size=size)


def total_pages_value(total: int, size: int) -> int:
    size = DEFAULT_PAGE_SIZE if size is None or size < 1 else size
    return -(-int(total) // int(size))


def total_pages(total_col, size: int) -> Column:
    """``ceil(total / size)`` as a column expression."""
    c = F.col(total_col) if isinstance(total_col, str) else total_col
    return F.ceil(c / F.lit(size)).cast("bigint")
