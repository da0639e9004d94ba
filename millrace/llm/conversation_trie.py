"""Prefix trie of conversations by fixed-length block hashing.

Turns become digests, and every BLOCK_TURNS of them a block digest. Conversations are grouped by
their successive block digests; the key of a path is the XOR of one hash for each (block number, block
digest), so paths need no walk from block to block and a very long conversation is cut anywhere. Turn
boundaries are looked at only within blocks whose parent path has several different next blocks;
any other block is a plain chain of nodes. No step depends on the depth of the trie: totals of a
subtree are sums over the conversations that pass its top (see ``_totals``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Stages

# Turns of a block, and blocks of a run within which paths are summed by one window.
BLOCK_TURNS = 4
RUN_BLOCKS = 1024
# Conversation ids that are joined to one text before a node's ids meet.
ID_CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "x", "y"]


def _halves(text: Column) -> tuple[Column, Column]:
    """128 bits of a text as two numbers."""
    hashed = F.md5(text)
    return tuple(F.conv(F.substring(hashed, at, 16), 16, -10).cast("long") for at in (1, 17))


def ordered(
    conversations: DataFrame, stages: Stages, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """(conv_id, depth, digest, words): the turns of each conversation, numbered from 1, and columns to ``keep``.

    In order of ``turn``, null first; ties by the MD5 of role and text. A null role or text is empty. Rows
    without a conversation id belong to none and are left out. The rows are range-partitioned by the whole
    order, so a conversation with most of the rows is numbered by many tasks.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep],
    ).where("conv_id IS NOT NULL")
    rows = stages.write(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.col("turn").asc_nulls_first(), "digest", "row"]
    dealt = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = stages.write(dealt, "dealt")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stages.write(counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "starts")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = dealt.withColumn("within", within).join(starts.where("start > 0"), ["conv_id", "part"], "left")
    return stages.write(
        numbered.select(
            "conv_id", (F.col("within") + F.coalesce("start", F.lit(0))).cast("long").alias("depth"), "digest", "words",
            *[F.col(f"`kept_{c}`").alias(c) for c in keep],
        ), "ordered",
    )


def branched(turns: DataFrame, stages: Stages, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share beginnings: of ``ordered`` turns, those of conversation c begin with the
    first h turns of conversation c - c % family, and go on with c's own after its first h; h is the unsigned
    CRC-32 of c in decimal, modulo ``most``. A conversation left without a turn has one row of depth 0."""
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string").cast("binary")) % most
    base = conv - conv % family
    sizes = stages.write(turns.groupBy("conv_id").agg(F.max("depth").alias("size")), "sizes")
    convs = sizes.select("conv_id", "size", base.alias("base"), shared.alias("h"))
    bases = sizes.where(conv % family == 0).select(F.col("conv_id").alias("base"), F.least("size", F.lit(most)).alias("base_size"))
    known = F.least("h", F.coalesce("base_size", F.lit(0)))
    plan = convs.join(bases, "base", "left").withColumn("head", known).drop("base_size")
    plan = stages.write(plan, "branches")
    first = turns.where((conv % family == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base")
    heads = plan.where("head > 0").join(first, "base").where("depth <= head")
    # Only conversations whose base lacks turns move up.
    moves = plan.where("head < h").select("conv_id", (F.col("h") - F.col("head")).alias("up"))
    own = turns.where(F.col("depth") > shared).join(moves, "conv_id", "left")
    own = own.withColumn("depth", F.col("depth") - F.coalesce("up", F.lit(0)))
    bare = plan.where("head = 0 AND size <= h").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words")
    )
    columns = ["conv_id", "depth", "digest", "words"]
    return stages.write(heads.select(columns).unionByName(own.select(columns)).unionByName(bare), "branched")


def _blocks(turns: DataFrame, stages: Stages) -> DataFrame:
    """A row for each conversation and block: its turns, the path before it (px, py) and with it (x, y),
    and the words before it."""
    made = turns.where("depth > 0").groupBy(
        "conv_id", F.expr(f"(depth - 1) div {BLOCK_TURNS}").alias("block")
    ).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
    made = made.withColumns({"digests": F.col("turns.digest"), "words": F.col("turns.words")})
    x, y = _halves(_step(F.col("block"), F.size("digests"), F.col("digests")))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)
    made = made.withColumns({"bx": x, "by": y, "total": total, "run": F.expr(f"block div {RUN_BLOCKS}")}).drop("turns")
    made = stages.write(made, "blocks")
    runs = made.groupBy("conv_id", "run").agg(
        F.bit_xor("bx").alias("rx"), F.bit_xor("by").alias("ry"), F.sum("total").alias("rt")
    )
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[how(c).over(before).alias(c) for c, how in (("rx", F.bit_xor), ("ry", F.bit_xor), ("rt", F.sum))])
    runs = stages.write(runs.where("run > 0"), "runs")
    upto = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    placed = made.withColumns({"x": F.bit_xor("bx").over(upto), "y": F.bit_xor("by").over(upto), "upto": F.sum("total").over(upto)})
    placed = placed.join(runs, ["conv_id", "run"], "left").withColumns(
        {
            "x": F.col("x").bitwiseXOR(F.coalesce("rx", none)),
            "y": F.col("y").bitwiseXOR(F.coalesce("ry", none)),
            "upto": F.col("upto") + F.coalesce("rt", none),
        }
    )
    return stages.write(
        placed.select(
            "conv_id", "block", "digests", "words", "x", "y",
            F.col("x").bitwiseXOR(F.col("bx")).alias("px"), F.col("y").bitwiseXOR(F.col("by")).alias("py"),
            (F.col("upto") - F.col("total")).alias("words_before"), F.col("upto").alias("words_upto"),
        ), "paths",
    )


def _step(block: Column, length: Column, digests: Column) -> Column:
    """What the first ``length`` turns of a block add to the key of a path."""
    return F.concat_ws(":", block.cast("string"), length.cast("string"), F.array_join(F.slice(digests, F.lit(1), length), ","))


def _turns_of(groups: DataFrame) -> DataFrame:
    """A row for each turn of each block group: its node's key, the parent's, and the words before it."""
    out = groups.select("*", F.posexplode("words").alias("at", "turn_words"))
    depth = F.col("block") * BLOCK_TURNS + F.col("at") + 1
    here, above = (_halves(_step(F.col("block"), n, F.col("digests"))) for n in (F.col("at") + 1, F.col("at")))
    first = F.col("at") == 0
    earlier = F.aggregate(F.slice("words", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.withColumns(
        {
            "depth": depth.cast("long"),
            "nx": F.col("px").bitwiseXOR(here[0]),
            "ny": F.col("py").bitwiseXOR(here[1]),
            "up_x": F.when(first, F.col("px")).otherwise(F.col("px").bitwiseXOR(above[0])),
            "up_y": F.when(first, F.col("py")).otherwise(F.col("py").bitwiseXOR(above[1])),
            "words_before": F.col("words_before") + earlier,
        }
    ).drop("x", "y").withColumnsRenamed({"nx": "x", "ny": "y"})


def _nodes(groups: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The nodes of all blocks. A block group that is its parent's only one is a chain of nodes with its
    own values; others are refined: turns that siblings share become one node."""
    fixed = ["up_x", "up_y", "turn_words", "words_before"]
    turns = _turns_of(groups)
    chains = turns.where("NOT diverges").select(*KEY, *fixed, *columns)
    shared = turns.where("diverges").groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in fixed], *[how.alias(c) for c, how in columns.items()]
    )
    return chains.unionByName(shared)


def trie(turns: DataFrame, stages: Stages) -> DataFrame:
    """One row for each node of the trie of ``ordered`` (or ``branched``) turns.

    depth, conv_id (smallest member), parent_conv_id (null for the root), n_convs, n_children, n_leaves (of
    the subtree), saved_tokens (over the subtree, words of the last turn times members but one) and
    ends_sha256 (of the ids that end here, ascending, comma-joined). A row of depth 0 is a conversation
    without turns. No conversations: no nodes. The node's last turn is turn ``depth`` of ``conv_id``.
    """
    paths = _blocks(turns, stages)
    last = paths.groupBy("conv_id").agg(F.max(F.struct("block", F.size("digests").alias("size"), "x", "y", "words_upto")).alias("end"))
    none = F.lit(0).cast("long")
    ends = stages.write(
        last.select(
            "conv_id", (F.col("end.block") * BLOCK_TURNS + F.col("end.size")).cast("long").alias("depth"),
            "end.x", "end.y", F.col("end.words_upto").alias("all_words"),
        ).unionByName(
            turns.where("depth = 0").select("conv_id", *[none.alias(c) for c in ("depth", "x", "y", "all_words")])
        ), "ends",
    )
    # Equal conversations are one from here on, of weight n.
    alike = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("all_words").alias("all_words"))
    alike = stages.write(alike, "alike")
    paths = stages.write(paths.join(alike.select("conv_id", "n", "all_words"), "conv_id"), "alike-paths")
    path, above = ["block", "x", "y"], ["block", "px", "py"]
    same = [F.first(c).alias(c) for c in ("px", "py", "digests", "words", "words_before")]
    groups = paths.groupBy(*path).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same)
    groups = stages.write(groups, "groups")
    fans = stages.write(groups.groupBy(*above).agg(F.count("*").alias("fan")).where("fan > 1"), "fans")
    groups = stages.write(groups.join(fans, above, "left").withColumn("diverges", F.col("fan").isNotNull()).drop("fan"), "marked")
    first = _nodes(groups, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")})
    first = stages.write(first, "first-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")]
    children = stages.write(first.groupBy(*up).agg(F.count("*").alias("n_children")), "children")
    # What each conversation owns: the nodes of which it is the smallest member, and whether it ends in a leaf.
    owned = first.join(children, KEY, "left").groupBy("conv_id").agg(
        F.sum("turn_words").alias("own"), F.max(F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaf")
    )
    owned = stages.write(owned, "owned")
    nodes = stages.write(_totals(paths, groups, alike, owned, path), "nodes")
    parents = nodes.select(F.col("depth").alias("d"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    closed = stages.write(_id_digests(ends), "ids")
    joined = stages.write(nodes.join(children, KEY, "left").join(closed, KEY, "left"), "joined")
    joined = joined.withColumn("d", F.col("depth") - 1).join(stages.write(parents, "parents"), ["d", "up_x", "up_y"], "left")
    kids = F.coalesce("n_children", none)
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", kids.alias("n_children"),
        F.when(kids == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _totals(paths: DataFrame, groups: DataFrame, alike: DataFrame, owned: DataFrame, path: list[str]) -> DataFrame:
    """The nodes with subtree totals, as sums over their members.

    The nodes below a node u, and u, are each owned by one member of u. All that a member other than
    u's smallest one, r, owns lies there; of what r owns, the words from u on. So the words of all those nodes
    are sum(own) - own(r) + words of r from u on. Each times its members is the sum of the
    members' words from u on; the difference of both is what sharing saves.
    """
    stats = alike.select("conv_id", F.col("n").alias("m"), F.col("all_words").alias("w")).join(owned, "conv_id", "left")
    stats = stats.withColumns({"own": F.coalesce("own", F.lit(0).cast("long")), "leaf": F.coalesce("leaf", F.lit(0))})
    spark = paths.sparkSession
    stages = Stages(spark, "conversation-trie")
    stats = stages.write(stats, "stats")
    rep = F.struct("conv_id", F.col("w").alias("rep_words"), F.col("own").alias("rep_own"))
    sums = [
        F.sum("m").alias("n_convs"), F.sum(F.col("m") * F.col("w")).alias("member_words"),
        F.sum("own").alias("owned"), F.sum("leaf").alias("leaves"), F.min(rep).alias("rep"),
    ]
    weighed = paths.select("conv_id", *path).join(stats, "conv_id")
    below = stages.write(weighed.groupBy(*path).agg(*sums), "below")
    whole = groups.drop("n_convs", "conv_id").join(below, path)
    how = {c: F.sum(c) for c in ("n_convs", "member_words", "owned", "leaves")} | {"rep": F.min("rep")}
    none = F.lit(0).cast("long")
    root = stats.agg(*sums).where("n_convs > 0").select(
        *[none.alias(c) for c in (*KEY, "up_x", "up_y", "turn_words", "words_before")],
        "n_convs", "member_words", "owned", "leaves", "rep",
    )
    nodes = _nodes(whole, how).unionByName(root)
    saved = (
        F.col("member_words") - F.col("n_convs") * F.col("words_before")
        - (F.col("owned") - F.col("rep.rep_own") + F.col("rep.rep_words") - F.col("words_before"))
    )
    return nodes.select(*KEY, "up_x", "up_y", F.col("rep.conv_id").alias("conv_id"), "n_convs", "leaves", saved.alias("saved_tokens"))


def _id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node. Ids meet as texts of up to ID_CHUNK of them; a node's texts are
    hashed one after the other as they come in order, so a task holds one of them."""
    chunks = ends.groupBy(*KEY, F.floor(F.col("conv_id") / ID_CHUNK).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("depth", "x", "y", "ids")]
            for *key, ids in zip(*columns):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield table(done)
        if now is not None:
            yield table([(*now, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "x", "y", "ends_sha256"])

    placed = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return placed.mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The trie of the conversations as they are, each node with ``role`` and ``text`` of its last turn (null
    in the root); see ``ordered`` for nulls and ties and ``trie`` for the columns."""
    stages = Stages(conversations.sparkSession, "conversation-trie")
    turns = ordered(conversations, stages, conv_col, turn_col, role_col, text_col, [role_col, text_col])
    texts = turns.select("conv_id", "depth", F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    return stages.write(trie(turns, stages), "trie").join(texts, ["conv_id", "depth"], "left")


def branched_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt by ``branched``."""
    stages = Stages(conversations.sparkSession, "conversation-trie")
    return trie(branched(ordered(conversations, stages), stages), stages)
