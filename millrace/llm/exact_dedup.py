"""Exact de-duplication by a 128-bit content hash with a byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Stages, documents


def decisions(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by MD5 of the text *and* the text itself: the second key compares the bytes
    of rows with equal hashes, on the map side first, so copies of one text leave each task as
    one row. ``keep`` is ``smallest`` or ``largest`` id. A null text is empty, so null and empty
    texts are equal. A null id is kept only if its whole group has none. Of repeated rows
    (same id, same text) one is kept. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    choose = F.min if keep == "smallest" else F.max
    rows = documents(docs, id_col, text_col)
    stages = Stages(docs.sparkSession, "exact-dedup")
    texts = stages.write(
        rows.groupBy(F.unhex(F.md5("text")).alias("hash"), "text")
        .agg(choose("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"),
        "texts",
    )
    # Equal hashes with different bytes keep apart by their SHA-256.
    keys = rows.select(
        "doc_id", F.unhex(F.md5("text")).alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha")
    )
    joined = keys.join(texts, ["hash", "sha"]).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    again = Window.partitionBy("doc_id", "sha", "kept").orderBy("hash")
    return joined.withColumn("kept", F.col("kept") & (F.row_number().over(again) == 1)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = decisions(docs, keep, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    )
    kept = Stages(docs.sparkSession, "exact-dedup").write(kept, "kept")
    marked = docs.withColumn("__sha256", F.sha2(text, 256))
    same = id_.cast("long").eqNullSafe(kept["__id"]) & (F.col("__sha256") == kept["__sha"])
    stay = marked.join(kept, same, "left_semi")
    repeated = (
        documents(docs, id_col, text_col).groupBy("doc_id", F.sha2("text", 256)).count().where("count > 1").limit(1)
    )
    if repeated.count():
        stay = stay.dropDuplicates([id_col, "__sha256"])
    return stay.drop("__sha256")
