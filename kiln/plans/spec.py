"""Small frozen specs that drive the operators: target standard, mappings, clean rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: standard type names -> Spark SQL types -------------------
_TYPE_NAMES = {
    "INTEGER": "int",
    "INT": "int",
    "INT4": "int",
    "SMALLINT": "smallint",
    "INT2": "smallint",
    "TINYINT": "tinyint",
    "BIGINT": "bigint",
    "INT8": "bigint",
    "REAL": "float",
    "FLOAT4": "float",
    "FLOAT": "double",
    "FLOAT8": "double",
    "DOUBLE": "double",
    "DOUBLE PRECISION": "double",
    "TEXT": "string",
    "STRING": "string",
    "VARCHAR": "string",
    "CHAR": "string",
    "CHARACTER": "string",
    "CHARACTER VARYING": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
    "TIMESTAMPTZ": "timestamp",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
    "TIMESTAMP WITHOUT TIME ZONE": "timestamp_ntz",
    "TIME": "string",
    "UUID": "string",
    "JSON": "string",
    "CLOB": "string",
    "BYTEA": "binary",
    "BLOB": "binary",
    "BINARY": "binary",
    "VARBINARY": "binary",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
}
# --- end of fixed values ------------------------------------------------------

_SIZED = re.compile(r"^([A-Z][A-Z0-9_]*(?: [A-Z]+)*?) ?(?:\( ?(\d+) ?(?:, ?(\d+) ?)?\))?(?: ([A-Z ]+))?$")
#: NUMERIC without precision holds any number of digits: as many whole digits as places after the point.
UNBOUNDED_NUMERIC = "decimal(38,18)"


def parse_field_type(text: str) -> tuple[str, bool]:
    """``'VARCHAR(40) NOT NULL'`` -> ``('VARCHAR(40)', False)``; any letter case."""
    raw = (text or "").strip()
    nullable = re.search(r"(?i)not\s+null", raw) is None
    clean = re.sub(r"(?i)\s*not\s+null\s*", " ", raw).strip()
    return clean, nullable


def spark_type(type_text: str) -> str:
    """Type string, in any letter case -> Spark SQL type name used in ``cast``.

    Standard names come first, then anything Spark itself reads as a type (``array<int>``); other text raises. An
    empty type is text.
    """
    clean, _ = parse_field_type(type_text)
    base, length, scale = _parts(clean)
    if not base:
        return "string"
    if base in ("NUMERIC", "DECIMAL", "DEC", "NUMBER"):
        return f"decimal({length},{scale or 0})" if length else UNBOUNDED_NUMERIC
    if base in _TYPE_NAMES:
        return _TYPE_NAMES[base]
    try:
        return T._parse_datatype_string(clean).simpleString()
    except Exception as e:
        raise ValueError(f"unknown type: {type_text}") from e


def _parts(clean: str) -> tuple[str, str | None, str | None]:
    """Base name (with words after the size, as in TIMESTAMP(3) WITH TIME ZONE), length and scale."""
    m = _SIZED.match(" ".join(clean.upper().split()))
    if not m:
        return clean.upper(), None, None
    return " ".join(x for x in (m.group(1), m.group(4)) if x), m.group(2), m.group(3)


def max_length(type_text: str) -> int | None:
    """Length bound of VARCHAR(n)/CHAR(n), else None (becomes an optional QC check)."""
    base, length, _ = _parts(parse_field_type(type_text)[0])
    return int(length) if length and base in ("VARCHAR", "CHAR", "CHARACTER", "CHARACTER VARYING") else None


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str = "TEXT"
    nullable: bool = True
    description: str = ""
    constraints: tuple[str, ...] = ()

    @property
    def spark_type(self) -> str:
        return spark_type(self.data_type)


@dataclass(frozen=True)
class Standard:
    table: str
    fields: tuple[Field, ...]
    description: str = ""

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(f.name, T._parse_datatype_string(f.spark_type), f.nullable) for f in self.fields]
        )


@dataclass(frozen=True)
class Mapping:
    """One target field and where it comes from.

    kind: ``direct`` (source column), ``transform`` (SQL expression),
    ``merge`` (several source columns: ``coalesce`` or ``concat``),
    ``missing`` (typed NULL).
    """

    target: str
    kind: str = "direct"
    source_table: str | None = None
    source_field: str | None = None
    expr: str | None = None
    sources: tuple[str, ...] = ()
    merge_how: str = "coalesce"
    separator: str = " "
    confidence: float = 1.0


@dataclass(frozen=True)
class CleanRule:
    """Ordered rules for one field: trim, upper, lower, cast, coalesce, standardize_date.

    ``deduplicate`` is table-level and handled by :class:`Dedup`.
    """

    field: str
    rules: tuple[str, ...]
    cast_type: str | None = None
    default: object | None = None
    date_formats: tuple[str, ...] = ()
    on_error: str = "raise"


@dataclass(frozen=True)
class Dedup:
    """Keep one row per key: the greatest ``order_by`` (``keep='last'``) or the least."""

    keys: tuple[str, ...]
    order_by: tuple[str, ...]
    keep: str = "last"


@dataclass(frozen=True)
class QCRules:
    table: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    custom: tuple[tuple[str, str], ...] = field(default_factory=tuple)  # (name, predicate that must hold)
