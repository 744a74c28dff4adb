"""Type names of the table model <-> Spark types (section 1.2 of the blueprint)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The type names of the table model, in their declared order.
TYPE_NAMES = (
    "UNKNOWN", "BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT", "LARGEINT", "FLOAT", "DOUBLE", "DECIMAL",
    "DATE", "DATETIME", "CHAR", "VARCHAR", "STRING", "JSON", "ARRAY", "MAP", "STRUCT", "BINARY",
)

_SIMPLE = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "LARGEINT": T.DecimalType(38, 0), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "STRING": T.StringType(),
    "JSON": T.StringType(), "BINARY": T.BinaryType(),
}


def parse_type_name(raw: str) -> tuple[str, T.DataType]:
    """Raw type text (``VARCHAR(255)``, ``DECIMAL(10,2)``, ``ARRAY<INT>``) -> (model name, Spark type).
    Unknown names map to ``UNKNOWN`` with a string type."""
    s = (raw or "").strip().upper()
    m = re.fullmatch(r"([A-Z]+)\s*(\((.*)\))?\s*(<.*>)?", s)
    if not m:
        return "UNKNOWN", T.StringType()
    name, args, inner = m.group(1), m.group(3), m.group(4)
    if name in ("CHAR", "VARCHAR"):
        return name, T.StringType()
    if name == "DECIMAL":
        p, sc = 10, 0
        if args:
            parts = [int(x) for x in args.split(",")]
            p = parts[0]
            sc = parts[1] if len(parts) > 1 else 0
        if p > 38:
            return "DECIMAL", T.DecimalType(38, min(sc, 38))
        return "DECIMAL", T.DecimalType(p, sc)
    if name in ("ARRAY", "MAP", "STRUCT"):
        try:
            return name, T._parse_datatype_string(s.lower())
        except Exception:  # noqa: BLE001
            return name, T.StringType()
    if name in _SIMPLE:
        return ("INT" if name == "INTEGER" else name), _SIMPLE[name]
    return "UNKNOWN", T.StringType()


def model_type_name(dt: T.DataType) -> str:
    """Spark type -> model type name (used by the column inventory)."""
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, T.ByteType):
        return "TINYINT"
    if isinstance(dt, T.ShortType):
        return "SMALLINT"
    if isinstance(dt, T.IntegerType):
        return "INT"
    if isinstance(dt, T.LongType):
        return "BIGINT"
    if isinstance(dt, T.DecimalType):
        return "LARGEINT" if dt.precision == 38 and dt.scale == 0 else "DECIMAL"
    if isinstance(dt, T.FloatType):
        return "FLOAT"
    if isinstance(dt, T.DoubleType):
        return "DOUBLE"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(dt, T.StringType):
        return "STRING"
    if isinstance(dt, T.BinaryType):
        return "BINARY"
    if isinstance(dt, T.ArrayType):
        return "ARRAY"
    if isinstance(dt, T.MapType):
        return "MAP"
    if isinstance(dt, T.StructType):
        return "STRUCT"
    return "UNKNOWN"
