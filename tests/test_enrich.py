from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, enrich, quality, routing
from millrace.sources.lookups import lookup, snapshot


@pytest.fixture(scope="module")
def facts(spark):
    data = [(1, "a", 10), (2, "b", 20), (3, None, None), (4, "z", 30)]
    return spark.createDataFrame(data, "id int, k string, n int")


@pytest.fixture(scope="module")
def dim(spark):
    data = [("a", 2, "late"), ("a", 1, "x"), ("b", 5, "y"), (None, 9, "null")]
    return spark.createDataFrame(data, "key string, v int, w string")


def test_duplicate_lookup_keys_do_not_fan_out(facts, dim):
    single = enrich.unique_lookup(dim, ["key"], ["v", "w"])
    assert sorted(map(tuple, single.collect())) == [("a", 1, "x"), ("b", 5, "y")]
    out = enrich.enrich(facts, single, {"k": "key"}, {"v": "v"})
    assert {r.id: r.v for r in out.collect()} == {1: 1, 2: 5, 3: None, 4: None}


def test_skip_and_found(facts, dim):
    single = enrich.unique_lookup(dim, ["key"], ["v"])
    assert {r.id for r in enrich.enrich(facts, single, {"k": "key"}, {"v": "v"}, "skip").collect()} == {1, 2}
    found = enrich.enrich(facts, single, {"k": "key"}, {"v": "v"}, found="hit")
    assert {r.id: r.hit for r in found.collect()} == {1: True, 2: True, 3: False, 4: False}
    with pytest.raises(ValueError):
        enrich.enrich(facts, single, {"k": "key"}, {"v": "v"}, on_miss="maybe")


def test_either_key_prefers_the_first(spark, facts):
    styles = spark.createDataFrame([(10, 99, 1), (77, 10, 2), (78, 20, 3)], "sid int, pim int, fam int")
    out = enrich.enrich_either_key(
        facts, styles, "n", ["sid", "pim"], {"sid": "sid", "fam": "fam"}, on_miss="keep"
    )
    assert {r.id: (r.sid, r.fam) for r in out.collect()} == {
        1: (10, 1),
        2: (78, 3),
        3: (None, None),
        4: (None, None),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallback_key(spark, facts):
    fonts = spark.createDataFrame([(1, 10, "q"), (2, None, "b"), (3, 30, "z")], "font int, fs int, ps string")
    attempts = [
        ("n", enrich.unique_lookup(fonts, ["fs"], ["font"]), "fs"),
        ("k", enrich.unique_lookup(fonts, ["ps"], ["font"]), "ps"),
    ]
    out = enrich.enrich_fallback_key(facts, attempts, {"font": "font"}, found="ok")
    assert {r.id: (r.font, r.ok) for r in out.collect()} == {
        1: (1, True),
        2: (2, True),
        3: (None, False),
        4: (3, True),
    }


def test_single_value(spark, facts, dim):
    hit = enrich.single_value(dim, "key", "b", "v")
    miss = enrich.single_value(dim, "key", "nope", "v")
    out = facts.withColumns({"h": hit, "m": miss})
    assert {(r.h, r.m) for r in out.collect()} == {(5, None)}


def test_hot_key_is_split_over_tasks(spark):
    """A third of the rows (and a mass of NULLs) share one key; the lookup is too big to
    broadcast. AQE splits the hot partition, and no row is lost."""
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        facts = spark.range(0, n, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        dim = spark.range(0, n, 1, 8).select(key.alias("key"), F.col("id").alias("v"))
        single = snapshot(lookup(dim, ["key"], ["v"]))
        out = enrich.enrich(facts, single, {"k": "key"}, {"v": "v"})
        assert out.where("v IS NOT NULL").count() == n
        assert len(out.collect()) == n
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rejects_name_the_first_broken_rule(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "x", None), (3, "x", 1)], "id int, a string, b int")
    marked = quality.mark_rejects(df, [("no_a", quality.complete(["a"])), ("b_small", "b > 0")])
    again = quality.mark_rejects(marked, [("late", F.lit(False))])
    assert {r.id: r.reject_reason for r in again.collect()} == {1: "no_a", 2: "b_small", 3: "late"}
    assert [r.id for r in quality.valid_rows(marked).collect()] == [3]
    assert {r.id for r in quality.rejected_rows(marked).collect()} == {1, 2}


def test_null_condition_takes_the_false_route(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, c boolean")
    routed = routing.split_routing(df, "c", "yes", "no")
    parts = routing.routes(routed, {"y": "yes", "n": "no"})
    assert [r.id for r in parts["y"].collect()] == [1]
    assert {r.id for r in parts["n"].collect()} == {2, 3}


def test_first_value_skips_null(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, "a"), ("m", 1, None)], "k string, t int, v string")
    out = aggregates.aggregate(df, ["k"], {"n": "count(*)"}, ["v"], ["t"])
    assert sorted(map(tuple, out.collect())) == [("k", 3, "b"), ("m", 1, None)]
    with pytest.raises(ValueError):
        aggregates.aggregate(df, ["k"], {}, ["v"])


def test_monthly_rollup_keeps_old_rows_of_the_month(spark):
    schema = (
        "customer_id string, font_id long, year int, month int, usage_type string, source_system string,"
        "first_usage date, last_usage date, usage_count long, customer_identifier_type string"
    )
    import datetime as d

    def row(c, month, day, n, kind="GCID"):
        at = d.date(2024, month, day)
        return (c, 1, 2024, month, "u", "s", at, at, n, kind)

    old = spark.createDataFrame([row("a", 1, 5, 2), row("b", 1, 6, 3), row("a", 2, 1, 7)], schema)
    new = spark.createDataFrame([row("a", 1, 2, 4, "NEW")], schema)
    keys = ["customer_id", "font_id", "year", "month", "usage_type", "source_system"]
    months = new.select("year", "month").distinct()
    out = aggregates.monthly_rollup(old, new, keys, "customer_identifier_type", months)
    got = {(r.customer_id, r.month): r for r in out.collect()}
    assert set(got) == {("a", 1), ("b", 1)}
    a = got["a", 1]
    assert (a.first_usage.day, a.last_usage.day, a.usage_count, a.customer_identifier_type) == (2, 5, 6, "GCID")
