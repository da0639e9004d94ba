"""Rendezvous sharding: balance, small moves, gapless slots."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, sharding


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r.slot)
    return out


def test_slots_are_gapless_and_rows_right(edge):
    rows = sharding.decisions(edge, [1.0] * 5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert all(sorted(s) == list(range(len(s))) for s in by_shard(rows).values())
    shards = defaultdict(set)
    for r in rows:
        shards[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 5)
    assert all(len(s) == 1 for s in shards.values())


def test_empty(empty):
    assert sharding.decisions(empty, [1.0] * 3).count() == 0
    assert sharding.assign(empty, [1.0, 2.0]).count() == 0


def test_same_result_in_any_partitioning(documents):
    want = {tuple(r) for r in sharding.decisions(documents, [1.0] * 6).collect()}
    for n in (1, 7):
        assert {tuple(r) for r in sharding.decisions(documents.repartition(n), [1.0] * 6).collect()} == want


def test_hot_rows_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 8)
    rows = spark.range(100).select(F.when(F.col("id") >= 40, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.decisions(rows, [1.0] * 3).collect()
    assert len(got) == 100 and sum(r.doc_id is None for r in got) == 40
    assert all(sorted(s) == list(range(len(s))) for s in by_shard(got).values())


def test_weights_share_and_growth_moves_few(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 0.0, 5.0]
    got = Counter(r.shard for r in sharding.assign(docs, weights).select("shard").collect())
    assert got[2] == 0 and all(abs(got[k] / 20_000 - w / 8) < 0.02 for k, w in enumerate(weights))
    # A fifth shard takes rows only into itself, its share of them.
    gone = sharding.moved(docs, weights, [*weights, 2.0]).collect()
    assert {r.to_shard for r in gone} == {4} and abs(len(gone) / 20_000 - 0.2) < 0.02
    # A shard that goes away moves only its own rows; a heavier one only gains.
    assert {r.from_shard for r in sharding.moved(docs, weights, [1.0, 0.0, 0.0, 5.0]).collect()} == {1}
    assert {r.to_shard for r in sharding.moved(docs, weights, [1.0, 4.0, 0.0, 5.0]).collect()} == {1}


@pytest.mark.parametrize("weights", [[], [0.0], [-1.0, 2.0], [float("nan")], [float("inf"), 1.0]])
def test_bad_weights(edge, weights):
    with pytest.raises(ValueError):
        sharding.assign(edge, weights)


def test_columns_stay_and_clashes_are_replaced(edge):
    docs = edge.withColumn("shard", F.lit("own"))
    got = sharding.assign(docs, [1.0, 1.0], more=[1.0])
    assert set(got.columns) == {*docs.columns, "grown_shard"} and dict(got.dtypes)["shard"] == "int"
    assert got.count() == docs.count()


def test_shards_are_written_whole(edge, spark, tmp_path):
    back = sharding.write_shards(edge, str(tmp_path / "shards"), [1.0] * 4, parts=2, rows_per_file=3)
    want = Counter((r.doc_id, r.text, r.shard) for r in sharding.assign(edge, [1.0] * 4).collect())
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == want


def test_main_path_is_native(spark, sf_dir, capsys):
    queries.QUERIES["op13_sharding"](spark, sf_dir).explain()
    shown = capsys.readouterr().out
    sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 24, more=[1.0]).explain()
    shown += (narrow := capsys.readouterr().out)
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown and "Exchange" not in narrow
