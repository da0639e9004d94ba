"""Lookup tables: the declared key and return columns, one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from millrace.operators.enrich import join_lookups, unique_lookup
from millrace.session import materialize


def lookup(table: DataFrame, keys: Sequence[str], returns: Sequence[str]) -> DataFrame:
    """One table, reduced to its keys and return columns."""
    return unique_lookup(table.select(*dict.fromkeys([*keys, *returns])), keys, returns)


def joined_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    keys: Sequence[str],
    returns: Sequence[str],
) -> DataFrame:
    """Two tables joined first, then reduced to one row per key."""
    return lookup(join_lookups(left, right, on), keys, returns)


def snapshot(reduced: DataFrame) -> DataFrame:
    """A lookup as a table of its own in the shared folder, for the length of a run.

    The source is read once, a retried task sees the same rows, the planner knows the
    size, and AQE can split a hot key of the other side.
    """
    return materialize(reduced, "lookup")
