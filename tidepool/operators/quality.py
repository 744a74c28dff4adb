"""Schema and data-quality operators.

Schema facts come from the DataFrame schema on the driver (metadata, no data); every data
fact is one aggregate over the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.types import model_type_name, parse_type_name

# The e-mail pattern and the clean-up rules of the text helpers.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
TAG_PATTERN = r"<[^>]*>"
DEFAULT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def column_inventory(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    """Table, column, model type, nullable, rows, nulls, NDV - one aggregate per table.
    NDV is a HyperLogLog estimate by default (bounded memory); ``exact=True`` counts
    distinct values (one Expand per column - for checks and small tables)."""
    if not tables:
        raise ValueError("at least one table must be given")
    parts = []
    for name, df in tables.items():
        fields = df.schema.fields
        ndv = F.count_distinct if exact else F.approx_count_distinct
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, f in enumerate(fields):
            aggs += [F.count_if(F.col(f.name).isNull()).alias(f"_z{i}"), ndv(F.col(f.name)).alias(f"_n{i}")]
        wide = df.agg(*aggs)
        items = [F.struct(F.lit(f.name).alias("column_name"), F.lit(model_type_name(f.dataType)).alias("model_type"),
                          F.lit(f.nullable).alias("nullable"), F.col(f"_z{i}").cast("bigint").alias("nulls"),
                          F.col(f"_n{i}").cast("bigint").alias("ndv")) for i, f in enumerate(fields)]
        parts.append(wide.select(F.lit(name).alias("table_name"), F.col("_rows").alias("rows"),
                                 F.explode(F.array(*items)).alias("_c")).select("table_name", "_c.*", "rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_schema(df: DataFrame, spec: list[dict], table: str = "t") -> DataFrame:
    """Missing / extra columns, type mismatch (driver, from the schema), NOT NULL
    violations and duplicate primary keys (data, one aggregate + one grouped count).

    ``spec``: [{"name", "type" (model text), "nullable": bool, "pk": bool}], at least one field.
    Rows: check, column_name, detail, violations.
    """
    if not spec:
        raise ValueError("a schema spec needs at least one field")
    spark = df.sparkSession
    have = {f.name: f for f in df.schema.fields}
    meta_rows = []
    for s in spec:
        if s["name"] not in have:
            meta_rows.append(("missing_column", s["name"], s.get("type", ""), 1))
            continue
        want_name, want = parse_type_name(s.get("type", ""))
        got = have[s["name"]].dataType
        if want_name != "UNKNOWN" and model_type_name(got) != model_type_name(want):
            meta_rows.append(("type_mismatch", s["name"], f"{want_name} vs {model_type_name(got)}", 1))
    for n in have:
        if n not in {s["name"] for s in spec}:
            meta_rows.append(("extra_column", n, model_type_name(have[n].dataType), 1))
    schema = "check string, column_name string, detail string, violations bigint"
    meta = spark.createDataFrame(meta_rows, schema)
    present = [s for s in spec if s["name"] in have]
    nn = [s["name"] for s in present if s.get("nullable") is False or s.get("pk")]
    parts = [meta]
    if nn:
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nn])
        items = [F.struct(F.lit("not_null").alias("check"), F.lit(c).alias("column_name"), F.lit("").alias("detail"),
                          F.col(c).cast("bigint").alias("violations")) for c in nn]
        parts.append(wide.select(F.explode(F.array(*items)).alias("_r")).select("_r.*"))
    pk = [s["name"] for s in present if s.get("pk")]
    if pk:
        dup = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1) \
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("violations"))
        parts.append(dup.select(F.lit("duplicate_key").alias("check"), F.lit(",".join(pk)).alias("column_name"),
                                F.lit("").alias("detail"), "violations"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def email_candidates(text: Column) -> Column:
    """Whitespace-delimited words holding an '@'."""
    return F.regexp_extract_all(text, F.lit(r"([^ \t\n\r]+@[^ \t\n\r]+)"), 1)


def is_valid_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def email_audit(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """D3: valid / invalid address counts among the '@' words of a text column."""
    ex = df.select(*(by or []), F.explode(email_candidates(F.col(col))).alias("candidate"))
    return ex.groupBy(*(by or []), is_valid_email(F.col("candidate")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def sanitize_text(c: Column) -> Column:
    """Drop ``<...>`` tags, then double every single quote."""
    return F.replace(F.regexp_replace(c, TAG_PATTERN, ""), F.lit("'"), F.lit("''"))


def time_text_audit(df: DataFrame, col: str, fmt: str = DEFAULT_TIME_FORMAT) -> DataFrame:
    """How many texts parse with the default format and format back to the same text."""
    parsed = F.try_to_timestamp(F.col(col), F.lit(fmt))
    ok = parsed.isNotNull()
    round_trip = F.date_format(parsed, fmt) == F.col(col)
    return df.agg(F.count(F.lit(1)).alias("texts"), F.count_if(ok).alias("parsed"),
                  F.count_if(~ok | F.col(col).isNull()).alias("unparsed"),
                  F.count_if(ok & round_trip).alias("round_trip"))


def unique_values(c: Column) -> Column:
    """Order-keeping de-duplication of a list."""
    return F.array_distinct(c)


def contains_value(c: Column, v) -> Column:
    """List membership."""
    return F.array_contains(c, v)


def payload_flatten(df: DataFrame, col: str, schema: T.StructType | str, prefix: str = "") -> DataFrame:
    """Dynamic JSON payload -> columns (fields absent from the payload are NULL)."""
    parsed = F.from_json(F.col(col), schema)
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return df.select("*", *[parsed[f.name].alias(prefix + f.name) for f in st.fields])


def payload_pack(df: DataFrame, cols: list[str], out: str = "payload") -> DataFrame:
    """D7 reverse: columns -> JSON payload text."""
    return df.withColumn(out, F.to_json(F.struct(*[F.col(c) for c in cols])))
