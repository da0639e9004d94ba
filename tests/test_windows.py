from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, windows

MINUTE = 60_000_000


def events(spark, data, schema="id long, user string, micros long, page string, device string"):
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_micros("micros"))


def brute_sessions(data, gap):
    """user -> sorted list of (id, session) by plain ordering."""
    result, last, number = {}, {}, {}
    for row in sorted((r for r in data if r[2] is not None), key=lambda r: (str(r[1]), r[2], r[0])):
        id_, user, at = row[:3]
        if user not in last or at - last[user] > gap:
            number[user] = number.get(user, 0) + 1
        last[user] = at
        result[id_] = number[user]
    return result


def random_events(seed, users=4, n=400, span=3 * 24 * 60):
    rng = random.Random(seed)
    hot = "u0"
    data = []
    for i in range(n):
        user = hot if rng.random() < 0.4 else rng.choice([f"u{k}" for k in range(users)] + [None])
        at = rng.randrange(-span, span) * MINUTE + rng.choice([0, 0, 1, 59_999_999])
        data.append((i, user, at, rng.choice(["/a", "/b", "/c", None]), rng.choice(["web", None])))
    return data


@pytest.mark.parametrize("seed", range(4))
def test_sessionize_equals_plain_ordering(spark, seed):
    data = random_events(seed)
    got = windows.sessionize(events(spark, data), "user", "ts", 30).select("id", "session_id").collect()
    assert {r.id: r.session_id for r in got} == brute_sessions(data, 30 * MINUTE)


def test_exact_gap_stays_in_the_session(spark):
    base = 1_700_000_000_000_000
    data = [
        (1, "u", base, "/a", "web"),
        (2, "u", base + 30 * MINUTE, "/a", "web"),
        (3, "u", base + 60 * MINUTE + 1, "/a", "web"),
        (4, "u", None, "/a", "web"),
        (5, "u", -1, "/a", "web"),
        (6, "u", 30 * MINUTE, "/a", "web"),
    ]
    got = windows.sessionize(events(spark, data), "user", "ts", 30).select("id", "session_id").collect()
    assert {r.id: r.session_id for r in got} == {5: 1, 6: 2, 1: 3, 2: 3, 3: 4, 4: None}


@pytest.mark.parametrize("seed", range(3))
def test_session_metrics_equal_plain_ordering(spark, seed):
    data = random_events(seed + 10)
    numbers = brute_sessions(data, 30 * MINUTE)
    expected = {}
    for id_, user, at, page, device in data:
        expected.setdefault((user, numbers[id_]), []).append((at, id_, page, device))
    want = {}
    for key, items in expected.items():
        items.sort()
        pages = [p for _, _, p, _ in items if p is not None]
        devices = [d for *_, d in items if d is not None]
        duration = (items[-1][0] - items[0][0]) / 1e6
        want[key] = (len(pages), duration, len(set(pages)), devices[0] if devices else None)
    got = aggregates.session_metrics(
        events(spark, data), "user", "ts", "page", ["device"], ["ts", "id"]
    ).collect()
    assert {
        (r.user, r.session_id): (r.page_views, r.session_duration_sec, r.unique_pages, r.device)
        for r in got
    } == want


def test_hot_user_window_holds_slots_not_rows(spark):
    """All rows of one user in one hour: the ordered part has at most three rows."""
    df = spark.range(5000).select(
        "id", F.lit("u").alias("user"), F.timestamp_micros(F.col("id") * 700_000).alias("ts")
    )
    out = windows.sessionize(df, "user", "ts", 30)
    assert out.select("session_id").distinct().count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    window_part = plan[plan.index("Window ") :]
    assert "HashAggregate" in window_part


def test_dedup_keeps_latest_real_time(spark):
    data = [(1, "a", 10), (2, "a", None), (3, "a", 10), (4, None, 5), (5, None, 6)]
    df = spark.createDataFrame(data, "id int, k string, t int")
    last = windows.deduplicate(df, ["k"], "t", keep="last", tiebreak=["id"])
    first = windows.deduplicate(df, ["k"], "t", keep="first", tiebreak=["id"])
    assert {r.id for r in last.collect()} == {3, 5}
    assert {r.id for r in first.collect()} == {1, 4}
    with pytest.raises(ValueError):
        windows.deduplicate(df, ["k"], "t", keep="any")


def test_dedup_default_ties_do_not_depend_on_arrival(spark):
    data = [(i, i % 3, i % 2) for i in range(60)]
    forward = spark.createDataFrame(data, "id int, k int, t int")
    backward = spark.createDataFrame(data[::-1], "id int, k int, t int")
    results = [
        sorted(map(tuple, windows.deduplicate(d, ["k"], "t").collect())) for d in (forward, backward)
    ]
    assert results[0] == results[1]


def test_dedup_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = windows.deduplicate(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a"), (2, "a"), (2, None)], "n int, s string")
    down = windows.sort_rows(df, ["n", "s"], [False, True]).collect()
    up = windows.sort_rows(df, ["n"], True, tiebreak=["s"]).collect()
    assert [tuple(r) for r in down] == [(2, "a"), (2, None), (1, "b"), (None, "a")]
    assert [r.n for r in up] == [1, 2, 2, None]
    with pytest.raises(ValueError):
        windows.sort_rows(df, ["n"], [True, False])


def test_row_limit(spark):
    df = spark.range(100)
    assert [r.id for r in windows.row_limit(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert windows.row_limit(df, 7).count() == 7
    plan = windows.row_limit(df, 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        windows.row_limit(df, 0)
