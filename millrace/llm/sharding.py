"""Sharding by rendezvous hashing: each shard bids for a record's key, the best bid wins.

A bid depends on the key and the shard alone, so another shard count moves only the records whose
best bid is of a new or a removed shard. With weights a bid is the waiting time -ln(u) / weight
of a race, in which a shard of weight w wins w parts of all weights. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Stages

# Hexadecimal digits of a bid that count: a double holds them exactly.
BID_DIGITS = 13
# Hexadecimal digits that cut a shard into buckets, in which rows are numbered.
BUCKET_DIGITS = 4
# Equal rows that one row of the expansion becomes at most.
CHUNK = 1 << 16


def _bid(key: Column, shard: int, weight: float) -> Column:
    """Less is better. ``key`` is text."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, BID_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**BID_DIGITS))
    return -F.ln(u) / F.lit(float(weight))


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(bid, shard) of the winner among shards from ``first`` on; a tie goes to the lower number."""
    bids = [F.struct(_bid(key, k, w).alias("bid"), F.lit(k).alias("shard")) for k, w in enumerate(weights, first) if w > 0]
    return F.least(*bids) if len(bids) > 1 else bids[0]


def _checked(weights: Sequence[float]) -> list[float]:
    given = [float(w) for w in weights]
    if not any(w > 0 for w in given) or any(w < 0 or w != w or w == float("inf") for w in given):
        raise ValueError("weights must be finite and not negative, and one of them positive")
    return given


def key_text(key_col: str) -> Column:
    """A key as text; no key is the empty text."""
    return F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))


def assign(
    docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id",
    shard_col: str = "shard", more: Sequence[float] = (), grown_col: str = "grown_shard",
) -> DataFrame:
    """``docs`` with the shard of each row, and with ``more`` shards added its shard then.

    A narrow projection: no shuffle, all columns stay (of columns with the same name as a new one, the
    new one stays). A shard of weight 0 gets no rows. Rows of one key share a shard; rows without
    a key do too. An empty table gives no rows.
    """
    given, added = _checked(weights), [float(w) for w in more]
    out = docs.withColumn("__best", _best(key_text(key_col), given))
    columns = {shard_col: F.col("__best.shard")}
    if any(w > 0 for w in added):
        columns[grown_col] = F.least(F.col("__best"), _best(key_text(key_col), added, len(given)))["shard"]
    elif added:
        columns[grown_col] = F.col("__best.shard")
    return out.withColumns(columns).drop("__best")


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key_col: str = "doc_id") -> DataFrame:
    """The rows whose shard changes between two lists of weights, with ``from_shard`` and ``to_shard``."""
    old = assign(docs, before, key_col, "from_shard")
    return assign(old, after, key_col, "to_shard").where("from_shard != to_shard")


def write_shards(
    docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", parts: int = 1,
    rows_per_file: int = 1_000_000,
) -> DataFrame:
    """Write ``docs`` as Parquet in a folder ``shard=k`` for each shard; returns them as read back.

    A shard is written by up to ``parts`` tasks, dealt by the whole row so that rows of one hot key spread.
    """
    rows = assign(docs, weights, key_col)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    rows = rows.withColumn("__part", F.pmod(whole, F.lit(parts)))
    rows = rows.repartition(len(weights) * parts, "shard", "__part").drop("__part")
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: Sequence[str], spread: str, stages: Stages) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each ``group``, by ``spread`` and then ``order``.

    ``spread`` is a hexadecimal hash of the row. No task sees a whole group: equal rows are counted
    first, groups are cut into buckets by the hash, and a bucket starts where those before end.
    """
    named = [c for c in rows.columns if c != "__bucket"]
    distinct = stages.write(
        rows.groupBy(*named).agg(F.count("*").alias("__times"))
        .withColumn("__bucket", F.substring(spread, 1, BUCKET_DIGITS)), "distinct"
    )
    totals = distinct.groupBy(group, "__bucket").agg(F.sum("__times").alias("__rows"))
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stages.write(
        totals.select(group, "__bucket", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start")), "starts"
    )
    before = Window.partitionBy(group, "__bucket").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("__before", F.coalesce(F.sum("__times").over(before), F.lit(0)))
    placed = placed.join(starts, [group, "__bucket"]).withColumn("__first", F.col("__start") + F.col("__before"))
    placed = stages.write(placed.select(*named, "__times", "__first"), "placed")

    def expanded(part: DataFrame) -> DataFrame:
        step = F.explode(F.sequence(F.lit(0), (F.col("__times") - 1).cast("int")))
        return part.select(*named, "__first", step.alias("__k")).select(
            *named, (F.col("__first") + F.col("__k")).alias("slot")
        )

    few = expanded(placed.where(F.col("__times") <= CHUNK))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__times - 1) div {CHUNK}")))
    many = placed.where(F.col("__times") > CHUNK).withColumn("__chunk", chunk)
    many = many.withColumns(
        {
            "__first": F.col("__first") + F.col("__chunk") * CHUNK,
            "__times": F.least(F.lit(CHUNK), F.col("__times") - F.col("__chunk") * CHUNK),
        }
    )
    return few.unionByName(expanded(many.repartition(F.col("__first"))))


def decisions(
    docs: DataFrame, weights: Sequence[float], more: Sequence[float] = (1.0,),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8 (null: 8); ``text_crc32`` the unsigned CRC-32 of it.
    ``slot`` numbers the rows of a shard without gaps by a hash of id, CRC and size, so it depends
    neither on partitions nor on arrival; of equal rows each has its own. ``grown_shard`` is the shard with ``more``
    shards added. Rows without an id share a shard. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = assign(rows, weights, "doc_id", more=more)
    fields = F.concat_ws(":", key_text("doc_id"), "text_crc32", "size")
    rows = numbered(rows.withColumn("__spread", F.md5(fields)), "shard", ["doc_id", "text_crc32", "size"], "__spread", stages)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.col("grown_shard").cast("int").alias("grown_shard"),
    )
