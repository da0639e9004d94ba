"""Enrichment: equi-joins to a lookup that holds one row per key.

No join here carries a broadcast hint. Catalyst broadcasts a lookup whose size it
knows to be below ``spark.sql.autoBroadcastJoinThreshold``, AQE does so on the size
measured at run time, and above it the join is shuffled. A hot key on the fact side
(or a mass of NULLs in a left join) then sits in one partition, which AQE splits over
several tasks: the lookup has one row per key, so only its few rows are repeated.

AQE can do that only when the lookup is a table of its own: an aggregate in the same
stage as the join hides its shuffle. A lookup that may outgrow a broadcast is therefore
reduced once and written (``sources.lookups.snapshot``), which also reads a database only
once per run and tells the planner the lookup's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

_PREFIX = "__lookup_"


def unique_lookup(
    lookup: DataFrame,
    keys: Sequence[str],
    returns: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per key, so that a join cannot fan out; rows with a NULL key cannot match.

    The survivor is the least by ``order_by`` and then by the returned columns, a NULL last. It
    is an aggregate, so copies of a hot key are reduced before the shuffle.
    """
    present = lookup.dropna(how="any", subset=list(keys)).groupBy(*keys)
    if len(returns) == 1 and not order_by:
        return present.agg(F.min(returns[0]).alias(returns[0]))
    ordered = [x for c in returns if c not in order_by for x in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))]
    ranked = F.struct(*order_by, *ordered)
    return present.agg(F.min(ranked).alias("__row")).select(
        *keys, *[F.col(f"__row.{c}").alias(c) for c in returns]
    )


def single_value(lookup: DataFrame, key: str, value, returns: str) -> Column:
    """The looked-up value of a constant key, as a scalar subquery: run once, no join.

    NULL when the lookup lacks the key.
    """
    return lookup.where(F.col(key) == F.lit(value)).agg(F.min(returns)).scalar()


def join_lookups(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Inner join of two lookups, done before either is used."""
    condition = [left[a] == right[b] for a, b in on.items()]
    drop = [right[b] for a, b in on.items() if a == b]
    joined = left.join(right, condition, "inner")
    return joined.drop(*drop) if drop else joined


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    on_miss: str = "keep",
    found: str | None = None,
) -> DataFrame:
    """Add lookup columns. ``on``: column -> lookup key; ``take``: target -> lookup column.

    ``on_miss`` is ``keep`` (NULLs) or ``skip`` (drop the row). ``found`` names a boolean
    column that tells a hit from a miss, for callers that count misses.
    """
    if on_miss not in ("keep", "skip"):
        raise ValueError(f"on_miss must be keep or skip, not {on_miss}")
    keys = {column: f"{_PREFIX}key_{i}" for i, column in enumerate(on)}
    side = lookup.select(
        *[F.col(key).alias(keys[column]) for column, key in on.items()],
        *[F.col(source).alias(f"{_PREFIX}{target}") for target, source in take.items()],
        F.lit(True).alias(f"{_PREFIX}hit"),
    )
    condition = [F.col(column) == F.col(key) for column, key in keys.items()]
    joined = df.join(side, condition, "inner" if on_miss == "skip" else "left")
    kept = [F.col(c) for c in df.columns if c not in take and c != found]
    added = [F.col(f"{_PREFIX}{target}").alias(target) for target in take]
    if found:
        added.append(F.col(f"{_PREFIX}hit").isNotNull().alias(found))
    return joined.select(*kept, *added)


def either_key(
    lookup: DataFrame, keys: Sequence[str], returns: Sequence[str], key_name: str = "lookup_key"
) -> DataFrame:
    """A lookup that may be found under any of several key columns, as one key column.

    An earlier key column wins. One equi-join on the result replaces a join with OR,
    which Spark could only run as a nested loop.
    """
    parts = None
    for rank, key in enumerate(keys):
        part = lookup.select(
            F.col(key).alias(key_name),
            F.lit(rank).alias("__rank"),
            *[F.col(c).alias(f"__r_{c}") for c in returns],
        )
        parts = part if parts is None else parts.unionByName(part)
    return unique_lookup(
        parts, [key_name], [f"__r_{c}" for c in returns], order_by=["__rank"]
    ).select(key_name, *[F.col(f"__r_{c}").alias(c) for c in returns])


def enrich_either_key(
    df: DataFrame,
    lookup: DataFrame,
    source_field: str,
    keys: Sequence[str],
    take: Mapping[str, str],
    on_miss: str = "skip",
    found: str | None = None,
) -> DataFrame:
    """Find ``source_field`` under any of the lookup's ``keys``: ``either_key``, written once so
    that a hot key of ``df`` can be split, and ``enrich``."""
    single = materialize(either_key(lookup, keys, list(dict.fromkeys(take.values()))), "lookup")
    return enrich(df, single, {source_field: "lookup_key"}, take, on_miss, found)


def enrich_fallback_key(
    df: DataFrame,
    attempts: Sequence[tuple[str, DataFrame, str]],
    take: Mapping[str, str],
    on_miss: str = "keep",
    found: str | None = None,
) -> DataFrame:
    """Try ``(column, lookup, lookup key)`` in order; the first hit gives all columns.

    Each lookup holds one row per key and is a table of its own (``sources.lookups.snapshot``).
    """
    result = df
    chosen: Column | None = None
    for i, (column, lookup, key) in enumerate(attempts):
        names = {f"__try{i}_{target}": source for target, source in take.items()}
        result = enrich(result, lookup, {column: key}, names, found=f"__try{i}_hit")
        hit = F.col(f"__try{i}_hit")
        value = F.struct(*[F.col(f"__try{i}_{t}").alias(t) for t in take])
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    result = result.withColumn("__chosen", chosen)
    if on_miss == "skip":
        result = result.where(F.col("__chosen").isNotNull())
    kept = [F.col(c) for c in df.columns if c not in take and c != found]
    added = [F.col(f"__chosen.{target}").alias(target) for target in take]
    if found:
        added.append(F.col("__chosen").isNotNull().alias(found))
    return result.select(*kept, *added)
