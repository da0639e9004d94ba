"""Column steps: one projection each, so Catalyst folds a chain of them into one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import cases, images, text, times

# Cast names of the step vocabulary and their Spark types.
CAST_TYPES = {"int": "bigint", "str": "string", "float": "double", "bool": "boolean"}
STRING_OPERATIONS = {"strip": text.strip, "lowercase": F.lower}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep and order ``columns``; one that is missing becomes a NULL string column."""
    if not columns:
        raise ValueError("select_columns needs at least one column")
    present = set(df.columns)
    return df.select(
        *[
            F.col(f"`{c}`") if c in present else F.lit(None).cast("string").alias(c)
            for c in columns
        ]
    )


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop ``columns``; absent ones are ignored."""
    if not columns:
        raise ValueError("drop_columns needs at least one column")
    return df.drop(*columns)


def rename_columns(df: DataFrame, mappings: Mapping[str, str]) -> DataFrame:
    """Rename old to new; absent columns are ignored."""
    return df.withColumnsRenamed(dict(mappings))


def derive_domain(
    df: DataFrame, source_field: str, target_field: str, default: str | None = None
) -> DataFrame:
    """The domain of an e-mail address; ``default`` (or NULL) when there is none."""
    domain = text.email_domain(F.col(source_field))
    if default is not None:
        domain = F.coalesce(domain, F.lit(default))
    return df.withColumn(target_field, domain)


def derive_column(df: DataFrame, target_field: str, expression: str | Column) -> DataFrame:
    """One expression over the row, as Spark SQL text or a Column."""
    return df.withColumn(target_field, cases.condition(expression))


def derive_lag_days(df: DataFrame, target_field: str, start: str, end: str) -> DataFrame:
    """Fractional days from ``start`` to ``end``."""
    return df.withColumn(target_field, times.days_between(F.col(start), F.col(end)))


def derive_flag(df: DataFrame, target_field: str, any_of: Sequence[str | Column]) -> DataFrame:
    """True where any predicate holds; NULL counts as not holding."""
    flag = F.lit(False)
    for predicate in any_of:
        flag = flag | cases.holds(predicate)
    return df.withColumn(target_field, flag)


def conditional_column(
    df: DataFrame,
    target_field: str,
    conditions: Sequence[tuple[str | Column, Any]],
    default: Any = None,
) -> DataFrame:
    """Ordered when/then pairs: the first match wins, NULL input falls to the default."""
    return df.withColumn(target_field, cases.first_match(conditions, default))


def bucket_column(
    df: DataFrame,
    target_field: str,
    source_field: str,
    buckets: Sequence[tuple[float | None, float | None, str]],
) -> DataFrame:
    """Label closed ranges; a value in no range, or NULL, gives NULL."""
    return df.withColumn(target_field, cases.range_label(F.col(source_field), buckets))


def clean_strings(
    df: DataFrame, columns: Sequence[str], operations: Sequence[str] = ("strip", "lowercase")
) -> DataFrame:
    """Apply ``operations`` in order to ``columns``; NULL stays NULL, absent ones are ignored."""
    cleaned = {}
    for name in columns:
        if name in df.columns:
            value = F.col(name)
            for operation in operations:
                value = STRING_OPERATIONS[operation](value)
            cleaned[name] = value
    return df.withColumns(cleaned) if cleaned else df


def parse_dates(df: DataFrame, columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Text to timestamp. ``errors: coerce`` turns bad text into NULL, else it fails the job."""
    parsed = {}
    for name, options in columns.items():
        if name not in df.columns:
            continue
        pattern = times.spark_pattern(options["format"])
        if options.get("errors", "raise") == "coerce":
            parsed[name] = F.try_to_timestamp(F.col(name), F.lit(pattern))
        else:
            parsed[name] = F.to_timestamp(F.col(name), pattern)
    return df.withColumns(parsed) if parsed else df


def cast_types(df: DataFrame, mappings: Mapping[str, str], errors: str = "raise") -> DataFrame:
    """Cast columns; NULL stays NULL. A malformed value raises, or is NULL with ``coerce``."""
    cast = {}
    for name, target in mappings.items():
        spark_type = CAST_TYPES.get(target, target)
        column = F.col(name)
        cast[name] = column.try_cast(spark_type) if errors == "coerce" else column.cast(spark_type)
    return df.withColumns(cast)


def cast_template(df: DataFrame, mappings: Mapping[str, str]) -> DataFrame:
    """``date…`` to a date, ``decimal…`` to a double rounded to two places; others are ignored."""
    cast = {}
    for name, target in mappings.items():
        if "date" in target:
            cast[name] = F.to_date(F.col(name))
        elif "decimal" in target:
            cast[name] = F.round(F.col(name).cast("double"), 2)
    return df.withColumns(cast) if cast else df


def fill_nulls(df: DataFrame, mappings: Mapping[str, Any]) -> DataFrame:
    """Replace NULL by a default per column; absent columns are ignored.

    ``coalesce`` with the column's own type, because ``fillna`` skips a default whose
    type differs from the column's.
    """
    types = dict(df.dtypes)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(types[name]))
        for name, value in mappings.items()
        if name in types
    }
    return df.withColumns(filled) if filled else df


def static_columns(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Constant columns. Dates such as the load date are parameters, so reruns agree."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def parse_image(df: DataFrame, record: str = images.RECORD_PATH) -> DataFrame:
    """Flatten an event image: type, user, identity, time, project context, all font entries.

    Unreadable times come out NULL and are caught by the required-field check.
    """
    return df.select(
        *[c for c in df.columns if c not in ("eventID", record.split(".")[0])],
        F.col("eventID").alias("event_id"),
        images.text_attribute(record, "eventName").alias("event_type"),
        images.text_attribute(record, "userEmail").alias("user"),
        images.text_attribute(record, "mtfid").alias("mtf_id"),
        F.try_to_timestamp(images.text_attribute(record, "timestamp")).alias("timestamp"),
        images.text_attribute(record, "projectId").alias("project_id"),
        images.text_attribute(record, "projectName").alias("project_name"),
        images.text_attribute(record, "projectType").alias("project_type"),
        images.text_attribute(record, "assetType").alias("asset_type"),
        images.list_union(record).alias("fonts"),
    )


def explode_fonts(df: DataFrame, fonts: str = "fonts", entry: str = "font_entry") -> DataFrame:
    """One row per list entry; a record without entries gives none."""
    return df.select(*[c for c in df.columns if c != fonts], F.explode(fonts).alias(entry))


def parse_packed(
    df: DataFrame, source_field: str, delimiter: str, output_fields: Mapping[str, int]
) -> DataFrame:
    """Fields of a delimited string by index; a short string gives NULL."""
    return df.withColumns(
        {
            name: text.packed_field(F.col(source_field), delimiter, index)
            for name, index in output_fields.items()
        }
    )


def event_dates(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """The grouping keys event_date, year and month."""
    return df.withColumns(
        {
            "event_date": F.to_date(timestamp),
            "year": F.year(timestamp),
            "month": F.month(timestamp),
        }
    )
