"""Time expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime codes and the Spark pattern letters that mean the same.
STRPTIME_CODES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
    "%z": "xx",
}


def spark_pattern(strptime_format: str) -> str:
    """Translate ``%Y-%m-%d``-style formats; a format without ``%`` is already Spark's."""
    if "%" not in strptime_format:
        return strptime_format

    def replace(match: re.Match) -> str:
        token = match.group(0)
        if token == "%%":
            return "%"
        if token.startswith("%"):
            if token not in STRPTIME_CODES:
                raise ValueError(f"unsupported date code {token}")
            return STRPTIME_CODES[token]
        return f"'{token}'"

    return re.sub(r"%.|[A-Za-z]+", replace, strptime_format)


def seconds_between(start: Column, end: Column) -> Column:
    """Fractional seconds from ``start`` to ``end``, from exact integer microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days; NULL if either end is NULL."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400e6)
