"""Near-duplicate documents by an LSH forest over MinHash signatures.

Twenty trees order the documents by six MinHash values each. Neighbours share a prefix of three
values: a pair at similarity 0.75 shares none with probability (1 - 0.75 ** 3) ** 20 < 2e-5. A
region in which more than ``links.REGION_ITEMS`` documents share the prefix is first compared in
parts, by all six values, and as a whole once components are known. Links are confirmed on the full
shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import links
from millrace.llm.common import Stages, documents
from millrace.llm.shingles import Forest, word_shingles

WIDTH = 5
HUNDREDTHS = 75
FOREST = Forest(trees=20, shallow=3, deep=6, more=136)
# 256 values estimate 0.75 with a deviation of 0.027: candidates below 0.64 are four away.
LEAST_ESTIMATE = 0.64


def _signatures(batches):
    for batch in batches:
        n, sets, keys = [], [], []
        for text in batch.column("text").to_pylist():
            shingles = word_shingles(text, WIDTH)
            n.append(len(shingles))
            sets.append(_set_hash(shingles))
            keys.append(FOREST.shallow_keys(shingles) if len(shingles) > 2 else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
             pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n", "set_hash", "keys"],
        )


def _keys(batches):
    for batch in batches:
        keys, nodes = batch.column("keys"), batch.column("node").to_numpy()
        lengths = keys.value_lengths().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.repeat(nodes, lengths))], ["key", "node"])


def _set_hash(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(batches):
    """Sketches of the rows whose set is the node's; an id may have rows of other sets."""
    for batch in batches:
        n, deep, sketch, own = [], [], [], []
        for text, set_hash in zip(batch.column("text").to_pylist(), batch.column("set_hash").to_pylist()):
            shingles = word_shingles(text, WIDTH)
            own.append(_set_hash(shingles) == set_hash)
            if own[-1]:
                keys, bytes_ = FOREST.sketch(shingles)
                n.append(len(shingles))
                deep.append(keys)
                sketch.append(bytes_)
        kept = batch.filter(pa.array(own, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [kept.column("node"), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()),
             pa.array(deep, pa.list_(pa.int64())), kept.column("text")],
            ["node", "n", "sketch", "deep", "text"],
        )


def _shingles(text: str) -> np.ndarray:
    return word_shingles(text, WIDTH)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space with A-Z in lower case. A text of fewer than five words
    is one shingle; an empty or null text has none and links with nothing, not even with rows of
    its id. Documents with equal sets link without being paired. Rows that share an id are linked
    with each other. A row without an id links with nothing: its component_id is null and it is
    kept. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "near-dedup")
    rows = documents(docs, id_col, text_col)
    signed = stages.write(
        rows.mapInArrow(_signatures, "doc_id long, n long, set_hash binary, keys array<long>"), "signatures"
    )
    # A node is a set, numbered in a written table; ids unite the sets of their rows.
    sets = signed.where("n > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("least"))
    sets = stages.write(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    filled = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash"))
    member = signed.select("doc_id", "n", filled.alias("set_hash")).join(sets, "set_hash", "left")
    member = stages.write(member.select("doc_id", "n", "node", "least"), "members")
    several = member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("x"))
    several = several.where("b <> x").select("doc_id", "b")
    given = stages.write(
        member.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct(), "given"
    )
    own = signed.where("keys is not null").withColumnRenamed("doc_id", "least").join(sets, ["set_hash", "least"])
    forest = stages.write(links.shared_keys(own.select("keys", "node"), _keys), "forest")
    shared = sets.join(forest.select("node").distinct(), "node", "left_semi").withColumnRenamed("least", "doc_id")
    items = rows.join(shared, "doc_id").select("node", "set_hash", "text")
    items = items.mapInArrow(_sketches, "node long, n long, sketch binary, deep array<long>, text string")
    items = stages.write(items.dropDuplicates(["node"]), "items")
    given = None if given.isEmpty() else given
    found = links.components(forest, items, _shingles, HUNDREDTHS, stages, LEAST_ESTIMATE, given)
    stages.drop("signatures", "forest", "items", "given")
    named = found.join(sets.select("node", "least"), "node")
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stages.write(named.join(firsts, "component").select("node", "component_id"), "named")
    stages.drop("sets", "components")
    component = F.coalesce("component_id", "least", "doc_id")
    return member.join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(component)).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (its smallest id), with all columns of ``docs``."""
    gone = decisions(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Stages(docs.sparkSession, "near-dedup").write(gone, "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
