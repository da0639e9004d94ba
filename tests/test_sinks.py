from __future__ import annotations

import uuid

import pytest

from millrace.session import shared_folder
from millrace.sinks import jdbc as jdbc_sink
from millrace.sinks import journal, tables


def make(spark, schema, partition_by=()):
    name = f"t_{uuid.uuid4().hex}"
    tables.create_table(spark, name, schema, shared_folder(spark, "sinktest"), partition_by)
    return name


def content(spark, name):
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def frame(spark, data, schema="k string, v int, p int"):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("partition_by", [(), ("p",)])
def test_upsert_twice_changes_nothing(spark, partition_by):
    name = make(spark, "k string, v int, p int", partition_by)
    tables.append(frame(spark, [("a", 1, 1), ("b", 2, 1), ("c", 3, 2), (None, 4, 2)]), name)
    new = frame(spark, [("a", 10, 1), ("a", 11, 1), (None, 40, 2), ("d", 5, 3)])
    tables.upsert(new, name, ["k", "p"], order_by=["v"])
    once = content(spark, name)
    tables.upsert(new, name, ["k", "p"], order_by=["v"])
    assert content(spark, name) == once
    assert once == sorted(
        [("a", 11, 1), ("b", 2, 1), ("c", 3, 2), (None, 40, 2), ("d", 5, 3)], key=str
    )


def test_partitioned_upsert_leaves_other_partitions_alone(spark):
    name = make(spark, "k string, v int, p int", ("p",))
    tables.append(frame(spark, [("a", 1, 1), ("c", 3, 2)]), name)

    def files():
        rows = spark.table(name).selectExpr("p", "_metadata.file_path AS f").collect()
        return {r.p: r.f for r in rows}

    before = files()
    tables.upsert(frame(spark, [("a", 9, 1)]), name, ["k", "p"])
    after = files()
    assert after[2] == before[2] and after[1] != before[1]


def test_insert_ignore_twice_and_first_wins(spark):
    name = make(spark, "k string, v int, p int")
    tables.append(frame(spark, [("a", 1, 1)]), name)
    new = frame(spark, [("a", 9, 1), ("b", 3, 1), ("b", 2, 1), (None, 7, 1)])
    for _ in range(2):
        tables.insert_ignore(new, name, ["k"], order_by=["v"])
    assert content(spark, name) == sorted([("a", 1, 1), ("b", 2, 1), (None, 7, 1)], key=str)


def test_replace_may_read_its_own_target_and_drops_old_partitions(spark):
    name = make(spark, "k string, v int, p int", ("p",))
    tables.append(frame(spark, [("a", 1, 1), ("c", 3, 2)]), name)
    tables.replace(spark.table(name).where("p = 2").withColumn("v", spark.table(name)["v"] + 1), name)
    assert content(spark, name) == [("c", 4, 2)]
    tables.replace(frame(spark, [("z", 0, 5)]), name)
    assert content(spark, name) == [("z", 0, 5)]


def test_unfinished_rewrite_is_not_seen(spark):
    """Files of a rewrite that died before the switch are not part of the table."""
    name = make(spark, "k string, v int, p int")
    tables.append(frame(spark, [("a", 1, 1)]), name)
    frame(spark, [("ghost", 0, 0)]).write.parquet(tables._new_folder(spark, name))
    spark.catalog.refreshTable(name)
    assert content(spark, name) == [("a", 1, 1)]
    tables.replace(frame(spark, [("b", 2, 2)]), name)
    tables.append(frame(spark, [("c", 3, 3)]), name)
    assert content(spark, name) == [("b", 2, 2), ("c", 3, 3)]


def test_monthly_merge_twice_sums_twice_and_spares_other_months(spark):
    import datetime as d

    schema = (
        "customer_id string, font_id long, usage_type string, source_system string, first_usage date,"
        "last_usage date, usage_count long, customer_identifier_type string, year int, month int"
    )
    day = d.date(2024, 1, 3)
    name = make(spark, schema, ("year", "month"))
    old = [("a", 1, "u", "s", day, day, 5, "GCID", 2023, 12), ("b", 1, "u", "s", day, day, 2, "GCID", 2024, 1)]
    tables.append(frame(spark, old, schema), name)
    new = frame(spark, [("a", 1, "u", "s", day, day, 7, "GCID", 2024, 1)], schema)
    keys = ["customer_id", "font_id", "year", "month", "usage_type", "source_system"]
    for _ in range(2):
        tables.monthly_merge(new, name, keys)
    got = {(r.customer_id, r.month): r.usage_count for r in spark.table(name).collect()}
    assert got == {("a", 12): 5, ("b", 1): 2, ("a", 1): 14}


ODD = ("AT&T", "a/b", "it's", "x=y", "50%", "back\\slash", None)


def test_any_partition_value(spark):
    name = make(spark, "k string, v int, p string", ("p",))
    new = spark.createDataFrame([("a", n, p) for n, p in enumerate(ODD)], "k string, v int, p string")
    for _ in range(2):
        tables.upsert(new, name, ["k", "p"])
        assert sorted((r.v, r.p) for r in spark.table(name).collect()) == list(enumerate(ODD))
    tables.append(new.limit(3), name)
    tables.insert_ignore(new, name, ["k", "p"])
    assert spark.table(name).count() == len(ODD) + 3
    tables.replace(new.where("v < 2"), name)
    assert sorted((r.v, r.p) for r in spark.table(name).collect()) == list(enumerate(ODD))[:2]


def test_insert_ignore_reads_only_touched_partitions(spark):
    name = make(spark, "k string, v int, p int", ("p",))
    tables.append(frame(spark, [("a", 1, 1), ("b", 1, 2)]), name)
    broken = tables._location(spark, name, "`p`='2'")
    spark.sql(f"ALTER TABLE {name} PARTITION (p=2) SET LOCATION '{broken}-absent'")
    tables.insert_ignore(frame(spark, [("a", 5, 1), ("c", 5, 1)]), name, ["k", "p"])
    assert sorted((r.k, r.v) for r in spark.table(name).where("p = 1").collect()) == [("a", 1), ("c", 5)]


class Death(Exception):
    pass


@pytest.mark.parametrize("deaths", range(7))
def test_death_between_any_two_steps_loses_and_doubles_nothing(spark, monkeypatch, deaths):
    """Append, merge of partitions and upsert in one batch; the driver dies after n steps."""
    plain = make(spark, "k string, v int, p int")
    parts = make(spark, "k string, v int, p int", ("p",))
    tables.append(frame(spark, [("a", 1, 1)]), plain)
    tables.append(frame(spark, [("a", 1, 1), ("a", 1, 2)]), parts)
    new = frame(spark, [("a", 7, 1), ("a", 7, 2), ("a", 7, 3)])
    folder = shared_folder(spark, "journal")
    changes = [tables.prepare_append(new, plain), tables.prepare_upsert(new, parts, ["k", "p"])]
    left = [deaths]
    sql, move = type(spark).sql, tables._move_files

    def dying(action):
        def act(*args, **named):
            statement = args[1] if isinstance(args[1], str) else ""
            if action is move or statement.startswith("ALTER"):
                if not left[0]:
                    left[0] = -1
                    raise Death
                left[0] -= left[0] > 0
            return action(*args, **named)

        return act

    monkeypatch.setattr(type(spark), "sql", dying(sql))
    monkeypatch.setattr(tables, "_move_files", dying(move))
    try:
        journal.load_all(spark, folder, changes)
    except Death:
        present = {r.p for r in spark.table(parts).collect()}
        assert present >= {1, 2}
    monkeypatch.undo()
    journal.finish_open(spark, folder)
    assert journal.finish_open(spark, folder) == []
    assert sorted(map(tuple, spark.table(plain).collect())) == [("a", 1, 1), ("a", 7, 1), ("a", 7, 2), ("a", 7, 3)]
    assert sorted(map(tuple, spark.table(parts).collect())) == [("a", 7, 1), ("a", 7, 2), ("a", 7, 3)]


def test_conform_orders_casts_and_adds(spark):
    name = make(spark, "v BIGINT, extra STRING, k STRING")
    tables.append(frame(spark, [("a", 1, 1)]), name)
    assert content(spark, name) == [(1, None, "a")]


def test_jdbc_write_options(monkeypatch):
    monkeypatch.setenv("TARGET_PASSWORD", "secret")
    options = jdbc_sink.write_options(
        {
            "engine": "mysql",
            "host": "db",
            "port": 3306,
            "username": "root",
            "password_env_var": "TARGET_PASSWORD",
            "database": "d",
            "table": "t",
            "mode": "replace",
            "keep_ddl": True,
            "chunksize": 2000,
            "connections": 8,
        }
    )
    assert options == {
        "url": "jdbc:mysql://db:3306/d",
        "user": "root",
        "password": "secret",
        "dbtable": "t",
        "batchsize": "2000",
        "numPartitions": "8",
        "truncate": "true",
    }
    with pytest.raises(ValueError, match="staging"):
        jdbc_sink.write_table(None, {"engine": "mysql", "database": "d", "table": "t", "mode": "upsert"})


def bucketed(spark, count=8, key=("k",), partition_by=()):
    name = f"t_{uuid.uuid4().hex}"
    tables.create_table(
        spark, name, "k string, v int, p int", shared_folder(spark, "sinktest"), partition_by, tables.KeyBuckets(key, count)
    )
    return name


def files_of(spark, name):
    rows = spark.table(name).selectExpr("key_bucket", "_metadata.file_path AS f").distinct().collect()
    return {b: {r.f for r in rows if r.key_bucket == b} for b in {r.key_bucket for r in rows}}


@pytest.mark.parametrize("partition_by", [(), ("p",)])
def test_bucketed_upsert_equals_the_plain_one(spark, partition_by):
    plain, name = make(spark, "k string, v int, p int"), bucketed(spark, 8, ("k",), partition_by)
    first = frame(spark, [(f"k{n}", n, n % 3) for n in range(200)] + [(None, -1, 0)])
    new = frame(spark, [(f"k{n}", n * 10, n % 3) for n in range(190, 210)] + [("k5", 1, 2), ("k5", 2, 2), (None, -2, 0)])
    for target in (plain, name):
        tables.append(first, target)
        for _ in range(2):
            tables.upsert(new, target, ["k", "p"], order_by=["v"])
        tables.insert_ignore(frame(spark, [("k7", 0, 1), ("new", 1, None), (None, 9, 0)]), target, ["k", "p"])
    rows = spark.table(name)
    assert sorted(map(tuple, rows.drop("key_bucket").select("k", "v", "p").collect()), key=str) == content(spark, plain)
    assert rows.where(rows.key_bucket != tables.KeyBuckets(("k",), 8).of()).count() == 0


def test_bucketed_upsert_reads_only_the_touched_buckets(spark):
    name = bucketed(spark)
    tables.append(frame(spark, [(f"k{n}", n, 0) for n in range(200)]), name)
    before = files_of(spark, name)
    assert len(before) == 8 and all(len(f) == 1 for f in before.values())  # a file a bucket, not one a task
    touched = spark.table(name).where("k = 'k3'").first().key_bucket
    for bucket, paths in before.items():
        for path in paths if bucket != touched else ():
            place = path.removeprefix("file://").removeprefix("file:")
            with open(place, "wb") as out:
                out.write(b"not to be read")
    tables.upsert(frame(spark, [("k3", 33, 0)]), name, ["k"])
    tables.insert_ignore(frame(spark, [("k3", 34, 0)]), name, ["k"])
    mine = spark.table(name).where(f"key_bucket = {touched}")
    assert mine.where("k = 'k3'").first().v == 33 and mine.count() == sum(1 for _ in mine.collect())
    locations = spark.sql(f"SHOW PARTITIONS {name}").count()
    assert locations == 8


def test_bucketed_upsert_by_fewer_columns_reads_all(spark):
    """A key that does not decide the bucket: equal keys may be anywhere."""
    name = bucketed(spark, 8, ("k", "p"))
    tables.append(frame(spark, [(f"k{n}", n, n) for n in range(40)]), name)
    tables.upsert(frame(spark, [("k3", 1, 99)]), name, ["k"])
    rows = spark.table(name)
    assert rows.count() == 40 and tuple(rows.where("k = 'k3'").select("k", "v", "p").first()) == ("k3", 1, 99)
    with pytest.raises(ValueError, match="key buckets"):
        bucketed(spark, 0)
