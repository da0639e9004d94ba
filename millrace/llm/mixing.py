"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

A token budget flows down the tree. Each node shares its budget among its children by weight; a
child takes no more than its subtree can give in all allowed epochs, and what it can't take goes
to its siblings. Only when all siblings are full does a node take less than its share, which its
own siblings then receive. All amounts are whole tokens, so the result is the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Stages

# Order buckets of a leaf's partial epoch; only the bucket at the end of the prefix is sorted.
BUCKET_DIGITS = 3
# What orders rows of one id.
TIE = "text_md5"


@dataclass(frozen=True)
class Mixture:
    """``weights``: for each level of the tree, positive whole weights by name (others: 1).
    ``share``: the budget, in hundredths of all tokens. ``epochs``: how often a row may be taken."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    share: int = 100
    epochs: int = 2
    seed: int = 7


# No table gives a domain: the number at the end of a source's name decides.
DOMAINS = ("encyclopedia", "forum", "news")
PRODUCTION = Mixture(
    weights={"domain": {"encyclopedia": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}, share=90, epochs=3
)


def domain_of(source: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("int")
    return F.get(F.array(*map(F.lit, DOMAINS)), F.coalesce(digits, F.lit(0)) % len(DOMAINS))


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    value = F.lit(1)
    for name, weight in weights.items():
        if weight < 1:
            raise ValueError(f"weight of {level} {name!r} must be a positive whole number")
        value = F.when(F.col(level) == name, weight).otherwise(value)
    return value.cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], mixture: Mixture) -> DataFrame:
    """``leaves`` (levels, supply) with ``budget``: water-filling at each level, from the root down."""
    held = leaves.withColumn("capacity", F.col("supply") * mixture.epochs)
    nodes = held.agg((F.coalesce(F.sum("supply"), F.lit(0)) * mixture.share / F.lit(100)).cast("long").alias("given"))
    path: list[str] = []
    for level in levels:
        children = held.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"))
        children = children.withColumn("weight", _weight(level, mixture.weights.get(level, {})))
        children = children.join(nodes, path) if path else children.join(F.broadcast(nodes))  # one row
        siblings = Window.partitionBy(*path) if path else Window.partitionBy(F.lit(0))
        # Least capacity for its weight first: those that their share fills are a prefix.
        order = siblings.orderBy(F.col("capacity").cast("double") / F.col("weight"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
        weight_left = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        children = children.withColumn("full", F.col("capacity") * weight_left <= left * F.col("weight"))
        open_ = F.when(~F.col("full"), F.col("weight")).otherwise(0)
        rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
        children = children.withColumns({
            "rest": rest, "open": F.sum(open_).over(siblings),
            "upto": F.sum(open_).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        })
        part = F.expr("rest * upto DIV open - rest * (upto - weight) DIV open")
        path.append(level)
        nodes = children.select(*path, F.when(F.col("full"), F.col("capacity")).otherwise(part).alias("given"))
    return leaves.join(nodes.withColumnRenamed("given", "budget"), path)


def select(rows: DataFrame, levels: Sequence[str], mixture: Mixture) -> DataFrame:
    """``rows`` (doc_id, levels, n_tokens, and ``text_md5`` if they have it) with ``epoch`` and ``n_taken``,
    once for each epoch.

    A leaf's budget is as many whole epochs as fit, then a prefix of the next one in a seeded
    order; the row at the prefix's end counts with the part of its tokens that fits. The order is by a hash of
    the id, or of ``text_md5`` where there is no id; rows that share an id follow by ``text_md5`` and
    ``n_tokens``, so rows that tie are equal and the result does not depend on the partitioning. Null names
    are the leaf ``unknown``. Leaves without tokens give no rows. An empty table gives none.
    """
    if TIE not in rows.columns:
        rows = rows.withColumn(TIE, F.lit(""))
    stages = Stages(rows.sparkSession, "mixing")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")).where("supply > 0")
    planned = stages.write(budgets(leaves, levels, mixture), "budgets")
    planned = planned.withColumns({"whole": F.expr("budget DIV supply"), "part": F.expr("budget % supply")})
    dealt = rows.join(planned.drop("supply", "budget"), [*levels])
    whole = dealt.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)")))
    whole = whole.withColumn("n_taken", F.col("n_tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col(TIE))))
    partial = dealt.where("part > 0").withColumn("key", key)
    partial = partial.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = partial.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("held"))
    running = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("base", F.sum("held").over(running) - F.col("held"))
    partial = partial.join(sums, [*levels, "bucket"]).where("base < part")
    within = Window.partitionBy(*levels, "bucket").orderBy("key", "doc_id", TIE, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inner = F.col("base") + F.col("held") <= F.col("part")
    last = partial.where(~inner).withColumn("start", F.col("base") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    last = last.where("start < part").withColumn("n_taken", F.least("n_tokens", F.col("part") - F.col("start")))
    sure = partial.where(inner).withColumn("n_taken", F.col("n_tokens"))
    columns = ["doc_id", *levels, F.col("epoch").cast("long").alias("epoch"), "n_tokens", "n_taken", TIE]
    return (
        whole.select(*columns)
        .union(sure.withColumn("epoch", F.col("whole")).select(*columns))
        .union(last.withColumn("epoch", F.col("whole")).select(*columns))
    )


LEVELS = ("domain", "lang", "source")


def text_md5(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["text"], F.lit("")))


def rows_of(docs: DataFrame) -> DataFrame:
    """What ``select`` needs of ``documents``, written once: token counts read whole texts."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        count_tokens(F.col("text")).alias("n_tokens"),
        text_md5(docs).alias(TIE),
    )
    return Stages(docs.sparkSession, "mixing").write(named, "rows")


def mixture_rows(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """The selection over ``documents``: doc_id, domain, lang, source, epoch, n_tokens, n_taken, text_md5."""
    return select(rows_of(docs), LEVELS, mixture)


def mix(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """The mixed documents, with all columns of ``docs``: a row for each epoch that takes it.

    A row goes by its id and text; rows that share both are taken together. Documents are not cut: the one at the
    end of a leaf's prefix comes whole, and ``n_taken`` of ``mixture_rows`` says how much of it counts.
    """
    taken = mixture_rows(docs, mixture)
    taken = taken.select(F.col("doc_id").alias("__id"), F.col(TIE).alias("__md5"), F.col("epoch").alias("__epoch")).distinct()
    taken = Stages(docs.sparkSession, "mixing").write(taken, "taken")
    same = docs["doc_id"].cast("long").eqNullSafe(taken["__id"]) & (text_md5(docs) == taken["__md5"])
    return docs.join(taken, same).select(docs["*"])
