"""Declared column types, modes and fields (E7, E12) and their Spark types.

A declared schema is a list of ``Field``; it maps to a ``StructType`` whose
field metadata carries the description (``comment``), default expression and
rounding mode, so they travel with the DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical type names and their accepted aliases (compared
# case-insensitively); anything else is UNKNOWN.
TYPE_ALIASES = {
    "INT64": "INT64", "INT": "INT64", "INTEGER": "INT64", "BIGINT": "INT64",
    "SMALLINT": "INT64", "TINYINT": "INT64", "BYTEINT": "INT64",
    "FLOAT64": "FLOAT64", "FLOAT": "FLOAT64",
    "BOOL": "BOOL", "BOOLEAN": "BOOL",
    "STRING": "STRING", "BYTES": "BYTES", "DATE": "DATE", "TIME": "TIME",
    "DATETIME": "DATETIME", "TIMESTAMP": "TIMESTAMP",
    "NUMERIC": "NUMERIC", "DECIMAL": "NUMERIC",
    "BIGNUMERIC": "BIGNUMERIC", "BIGDECIMAL": "BIGNUMERIC",
    "JSON": "JSON", "GEOGRAPHY": "GEOGRAPHY",
    "STRUCT": "STRUCT", "RECORD": "STRUCT",
}
MODES = ("NULLABLE", "REQUIRED", "REPEATED")
# Column name prefixes reserved by the warehouse (case-insensitive).
RESERVED_PREFIXES = ("_TABLE_", "_FILE_", "_PARTITION", "_ROW_TIMESTAMP", "_COLIDENTIFIER")
ROUNDING_MODES = ("ROUND_HALF_AWAY_FROM_ZERO", "ROUND_HALF_EVEN")
ALTER_ACTIONS = ("insert", "rename", "delete")

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,299}$")


class SchemaError(ValueError):
    pass


def normalize_type(name: str) -> str:
    return TYPE_ALIASES.get(name.strip().upper(), "UNKNOWN")


@dataclass
class Field:
    name: str
    type: str = "STRING"
    mode: str = "NULLABLE"
    description: str | None = None
    default_value_expression: str | None = None
    rounding_mode: str | None = None
    fields: list["Field"] = field(default_factory=list)
    alter: str | None = None          # insert | rename | delete
    alter_from: str | None = None     # old name of a rename

    def __post_init__(self):
        self.mode = self.mode.upper()
        self.canonical = normalize_type(self.type)

    @property
    def repeated(self) -> bool:
        return self.mode == "REPEATED"


def spark_type(f: Field) -> T.DataType:
    """Spark type of a declared field (REPEATED wraps it in an array)."""
    c = f.canonical
    if c == "STRUCT":
        if not f.fields:
            raise SchemaError(f"STRUCT field {f.name!r} needs at least one sub-field")
        base: T.DataType = T.StructType([struct_field(x) for x in f.fields])
    else:
        base = {
            "INT64": T.LongType(), "FLOAT64": T.DoubleType(), "BOOL": T.BooleanType(),
            "STRING": T.StringType(), "BYTES": T.BinaryType(), "DATE": T.DateType(),
            "TIME": T.TimeType() if hasattr(T, "TimeType") else T.StringType(),
            "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(),
            "NUMERIC": T.DecimalType(38, 9), "BIGNUMERIC": T.DecimalType(38, 18),
            "JSON": T.StringType(), "GEOGRAPHY": T.StringType(),
        }.get(c)
        if base is None:
            raise SchemaError(f"field {f.name!r}: unknown type {f.type!r}")
    return T.ArrayType(base, True) if f.repeated else base


def metadata(f: Field) -> dict:
    m = {}
    if f.description is not None:
        m["comment"] = f.description
    if f.default_value_expression is not None:
        m["default"] = f.default_value_expression
    if f.rounding_mode is not None:
        m["rounding_mode"] = f.rounding_mode
    if f.canonical in ("JSON", "GEOGRAPHY"):
        m["declared_type"] = f.canonical
    return m


def struct_field(f: Field) -> T.StructField:
    return T.StructField(f.name, spark_type(f), f.mode != "REQUIRED", metadata(f))


def to_struct(fields: list[Field]) -> T.StructType:
    return T.StructType([struct_field(f) for f in fields])


def canonical_of(dt: T.DataType) -> str:
    """Canonical declared type of a Spark type (for drift reports)."""
    if isinstance(dt, T.ArrayType):
        return canonical_of(dt.elementType)
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INT64"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "FLOAT64"
    if isinstance(dt, T.DecimalType):
        return "BIGNUMERIC" if dt.scale > 9 else "NUMERIC"
    return {
        T.BooleanType: "BOOL", T.StringType: "STRING", T.BinaryType: "BYTES",
        T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "TIMESTAMP",
        T.StructType: "STRUCT",
    }.get(type(dt), "TIME" if type(dt).__name__ == "TimeType" else "UNKNOWN")


def declared_type(f: T.StructField) -> str:
    """Canonical type of a column; JSON and GEOGRAPHY, stored as strings, are
    told from strings by the metadata that ``struct_field`` gives them."""
    return (f.metadata or {}).get("declared_type") or canonical_of(f.dataType)


def validate_fields(fields: list[Field], existing: list[str] | None = None,
                    first_create: bool = False) -> None:
    """Declaration rules (no Spark work): names, reserved prefixes,
    duplicates (case-insensitive), types, modes, alter annotations."""
    seen: set[str] = set()
    have = {c.lower() for c in (existing or [])}
    for f in fields:
        if not _NAME.match(f.name):
            raise SchemaError(f"invalid column name {f.name!r}")
        if any(f.name.upper().startswith(p) for p in RESERVED_PREFIXES):
            raise SchemaError(f"column name {f.name!r} uses a reserved prefix")
        if f.name.lower() in seen:
            raise SchemaError(f"duplicate column name {f.name!r}")
        seen.add(f.name.lower())
        if f.canonical == "UNKNOWN":
            raise SchemaError(f"column {f.name!r}: unknown type {f.type!r}")
        if f.mode not in MODES:
            raise SchemaError(f"column {f.name!r}: mode must be one of {MODES}")
        if f.rounding_mode is not None:
            if f.rounding_mode not in ROUNDING_MODES:
                raise SchemaError(f"column {f.name!r}: rounding mode must be one of {ROUNDING_MODES}")
            if f.canonical not in ("NUMERIC", "BIGNUMERIC"):
                raise SchemaError(f"column {f.name!r}: rounding mode needs NUMERIC or BIGNUMERIC")
        if f.alter is not None and f.alter not in ALTER_ACTIONS:
            raise SchemaError(f"column {f.name!r}: alter must be one of {ALTER_ACTIONS}")
        if (f.alter == "rename") != (f.alter_from is not None):
            raise SchemaError(f"column {f.name!r}: alter_from goes with alter='rename' only")
        if first_create and f.alter in ("rename", "delete"):
            raise SchemaError(f"column {f.name!r}: cannot {f.alter} when the table is first created")
        if f.alter == "insert" and f.mode == "REQUIRED":
            raise SchemaError(f"column {f.name!r}: an added column cannot be REQUIRED")
        if existing is not None and f.alter is None and f.name.lower() not in have:
            raise SchemaError(f"column {f.name!r} is not in the table; annotate it alter='insert'")
        if f.canonical == "STRUCT":
            if not f.fields:
                raise SchemaError(f"STRUCT column {f.name!r} needs at least one sub-field")
            validate_fields(f.fields)
        elif f.fields:
            raise SchemaError(f"column {f.name!r}: only STRUCT columns have sub-fields")


def cast_to(c: Column, dt: T.DataType, safe: bool = False) -> Column:
    """Cast a column to a (possibly nested) declared type; ``safe`` gives NULL
    instead of an error for values that do not convert."""
    if safe:
        return c.try_cast(dt)
    return c.cast(dt)


def align(df: DataFrame, fields: list[Field], safe: bool = False) -> DataFrame:
    """Project ``df`` onto a declared schema -- columns matched by name
    case-insensitively, cast to the declared (nested) types, descriptions
    attached as metadata.  Missing columns are an error."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in fields:
        if f.name.lower() not in have:
            raise SchemaError(f"column {f.name!r} missing; have {df.columns}")
        sf = struct_field(f)
        cols.append(cast_to(F.col(have[f.name.lower()]), sf.dataType, safe)
                    .alias(f.name, metadata=sf.metadata))
    return df.select(*cols)
