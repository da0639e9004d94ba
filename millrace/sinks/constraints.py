"""NOT NULL, DEFAULT and VARCHAR lengths of a target, enforced in the plan that writes a load.

Tables of files keep no such rules, so they are a table property. A load that breaks one fails while it is
prepared, before anything of its run is published.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTY = "millrace.constraints"
_COLUMN = re.compile(r"\s*`?([\w]+)`?\s+(.+?)\s*", re.DOTALL)
_NOT_NULL = re.compile(r"\s+NOT\s+NULL\b", re.IGNORECASE)
_DEFAULT = re.compile(r"\s+DEFAULT\s+('(?:[^']|'')*'|\S+(?:\(.*\))?)", re.IGNORECASE)
_LENGTH = re.compile(r"VARCHAR\s*\(\s*(\d+)\s*\)", re.IGNORECASE)


def _items(ddl: str) -> list[str]:
    """The column list cut at commas outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(ddl):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "(<":
            depth += 1
        elif not quoted and c in ")>":
            depth -= 1
        elif not quoted and c == "," and depth == 0:
            out.append(ddl[start:k])
            start = k + 1
    return [x for x in [*out, ddl[start:]] if x.strip()]


def parse(ddl: str) -> tuple[str, dict[str, Any]]:
    """A column list without its constraints, and these: not_null, defaults (SQL text), lengths."""
    plain, rules = [], {"not_null": [], "defaults": {}, "lengths": {}}
    for item in _items(ddl):
        name, kind = _COLUMN.fullmatch(item).groups()
        if _NOT_NULL.search(kind):
            rules["not_null"].append(name)
            kind = _NOT_NULL.sub("", kind)
        if default := _DEFAULT.search(kind):
            if default[1].upper() != "NULL":
                rules["defaults"][name] = default[1]
            kind = _DEFAULT.sub("", kind)
        if length := _LENGTH.search(kind):
            rules["lengths"][name] = int(length[1])
            kind = _LENGTH.sub("STRING", kind)
        plain.append(f"`{name}` {kind.strip()}")
    return ", ".join(plain), rules if any(rules.values()) else {}


def properties(rules: Mapping[str, Any], more: Mapping[str, Any] | None = None) -> str:
    """The clause of CREATE TABLE that keeps the rules, and further properties as JSON."""
    kept = ({PROPERTY: rules} if rules else {}) | (more or {})
    texts = {k: json.dumps(v).replace("\\", "\\\\").replace("'", "\\'") for k, v in kept.items()}
    return f"TBLPROPERTIES ({', '.join(f"'{k}' = '{t}'" for k, t in texts.items())})" if kept else ""


def kept_property(spark: SparkSession, table: str, name: str) -> Any:
    """A property that ``properties`` has kept; None if the table was created without."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == name).collect()
    return json.loads(rows[0]["value"]) if rows else None


def declared(spark: SparkSession, table: str) -> dict[str, Any]:
    """The rules of a table; none if it was created without."""
    return kept_property(spark, table, PROPERTY) or {}


def conform(df: DataFrame, schema: T.StructType, rules: Mapping[str, Any] | None = None) -> DataFrame:
    """Project and cast to the target's columns.

    Without rules a missing column becomes NULL and further columns are left out. With rules, a
    missing column takes its default, a missing or NULL value of a NOT NULL column and a text longer than its
    column fail, and a column that the target lacks is refused. As in SQL, an explicit NULL is
    not replaced by the default.
    """
    rules = rules or {}
    defaults, lengths, required = (rules.get(k) or {} for k in ("defaults", "lengths", "not_null"))
    if rules:
        unknown = [c for c in df.columns if c not in schema.fieldNames()]
        if unknown:
            raise ValueError(f"columns that the target lacks: {', '.join(unknown)}")
        absent = [c for c in required if c not in df.columns and c not in defaults]
        if absent:
            raise ValueError(f"required columns without a value: {', '.join(absent)}")

    def value(field: T.StructField) -> Column:
        name, kind = field.name, field.dataType
        if name in df.columns:
            out = F.col(f"`{name}`").cast(kind)
        else:
            out = (F.expr(defaults[name]) if name in defaults else F.lit(None)).cast(kind)
        if name in required:
            out = F.coalesce(out, F.raise_error(F.lit(f"NULL in required column {name}")).cast(kind))
        if name in lengths:
            error = F.raise_error(F.lit(f"text of {name} is longer than {lengths[name]}")).cast(kind)
            out = F.when(F.length(out) > lengths[name], error).otherwise(out)
        return out.alias(name)

    return df.select(*[value(f) for f in schema])
