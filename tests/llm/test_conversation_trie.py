"""The prefix trie against one that is built in memory."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def order_of(row):
    role, text = row[2] or "", row[3] or ""
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return (row[1] is not None, row[1] or 0, digest)


def conversations_of(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order_of):
        own[r[0]].append((r[2] or "", r[3] or ""))
    return own


def rebuilt(rows):
    own = conversations_of(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in children[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def made(seed, convs=60, turns=11, words=2):
    dice = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = dice.randrange(-30, 90)
        rows += [(c, t, dice.choice(["user", "bot", None]), dice.choice(["a b", "c", "", None][: words + 1])) for t in range(dice.randrange(turns))]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "RUN_BLOCKS", 2)
    monkeypatch.setattr(trie, "ID_CHUNK", 3)
    rows = [(c, t, "user", text) for c, t, _, text in made(seed)] if seed else made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.branched_trie(df)) == brute(rebuilt(rows))
    got = trie.conversation_trie(df)
    assert found(got) == brute(conversations_of(rows))


def test_edges(spark):
    rows = [
        (7, None, None, None), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (8, -5, "user", "x"),
        (None, 0, "user", "of nobody"), (20, 0, "user", "base"), (33, 0, "", ""), (41, 0, "user", "short"), (-41, 0, "user", "negative"),
        *[(60, k, "user", f"turn {k % 7}") for k in range(700)], *[(60 + c, k, "user", f"turn {k % 7}") for c in (1, 2) for k in range(650)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("depth", "digest", "x", "y", "n", "block", "words", "part")})
    assert found(trie.branched_trie(df)) == brute(rebuilt(rows))
    got = trie.conversation_trie(df).collect()
    own = conversations_of(rows)
    assert all((r.role or "", r.text or "") == (own[r.conv_id][r.depth - 1] if r.depth else ("", "")) for r in got)
    assert trie.branched_trie(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(41, 0, "user", "x")], SCHEMA)  # crc32 takes its only turn
    h = zlib.crc32(b"41") % 4
    assert h and [(r.depth, r.n_convs, r.n_leaves, r.n_children) for r in trie.branched_trie(alone).collect()] == [(0, 1, 1, 0)]


def test_hot_conversation_is_cut_by_many_tasks(spark):
    """One conversation of most rows, in any arrival: its turns are numbered and summed in several partitions."""
    rows = spark.range(12_000).select(
        F.when(F.col("id") < 9000, 5).otherwise(F.col("id")).cast("long").alias("conv_id"), (-F.col("id")).alias("turn"),
        F.lit("user").alias("role"), (F.col("id") % 11).cast("string").alias("text"),
    )
    stages = trie.Stages(spark, "t")
    turns = trie.ordered(rows.repartition(5), stages)
    assert {r.depth for r in turns.where("conv_id = 5").collect()} == set(range(1, 9001))
    got = trie.trie(turns, stages)
    top = got.where("depth = 0").collect()[0]
    assert (top.n_convs, got.where("depth = 9000").count(), got.agg(F.max("depth")).collect()[0][0]) == (3001, 1, 9000)
