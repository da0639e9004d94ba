"""Exact, near and line de-duplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import exact_dedup, line_dedup, links, near_dedup
from millrace.llm.common import Stages
from millrace.llm.links import connected
from millrace.llm.shingles import char_shingles, char_windows, distinct_counts, similar, similar_lines


def word_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def united(sets, hundredths):
    """Smallest id reachable, by comparing all pairs that share an element."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            common.update((a, b) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= hundredths * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_exact(edge):
    rows = sorted(exact_dedup.decisions(edge, "largest").collect(), key=str)
    assert len(rows) == 14
    same = {r.doc_id: r for r in rows if r.doc_id in (1, 2)}
    assert same[1].keep_id == same[2].keep_id == 2 and not same[1].kept and same[2].kept
    assert [r.kept for r in rows if r.doc_id == 3].count(True) == 1
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.group_size for r in empty} == {3} and {r.keep_id for r in empty} == {5}
    alone = next(r for r in rows if r.doc_id is None and r.group_size == 1)
    assert alone.kept and alone.keep_id is None
    smallest = {r.doc_id: r.keep_id for r in exact_dedup.decisions(edge).collect()}
    assert smallest[2] == 1 and smallest[5] == 4


def test_exact_stage_keeps_columns_and_one_row_each(edge, empty):
    kept = exact_dedup.exact_dedup(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.decisions(empty).count() == 0


def test_exact_refuses_unknown_choice(edge):
    with pytest.raises(ValueError):
        exact_dedup.decisions(edge, "newest")


def test_near_edges(edge, empty):
    rows = near_dedup.decisions(edge).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 14
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[9].component_id == by[10].component_id == 9 and by[9].n_shingles == 29_996
    assert by[7].component_id == by[8].component_id == 7 and by[7].n_shingles == 1
    assert all(by[i].kept and by[i].n_shingles == 0 and by[i].component_id == i for i in (4, 5, 6))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = near_dedup.near_dedup(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 11]
    assert near_dedup.decisions(empty).count() == 0


@pytest.fixture(scope="module")
def families(spark):
    """A hot family of 700 edited copies, chains at the edge of the threshold, and strangers."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(700):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = rng.choice(words)
        texts.append(copy)
    for _ in range(20):
        chain = [rng.choice(words) for _ in range(80)]
        for step in range(5):
            texts.append(chain[4 * step : 4 * step + 60])
    texts += [[rng.choice(words) for _ in range(rng.randrange(1, 40))] for _ in range(150)]
    rng.shuffle(texts)
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)


def test_near_families_equal_brute_force(families):
    want = united({r.doc_id: word_set(r.text) for r in families.collect()}, 75)
    got = {r.doc_id: r for r in near_dedup.decisions(families).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items())


def test_near_rows_that_share_an_id(spark):
    """Rows of an id are linked with each other, and each of them with what is like it."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, a), (1, b), (2, a[1:]), (3, b[1:]), (4, a), (5, ["c"]), (5, []), (0, b[:-1]), (1, a)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.decisions(docs).collect())
    assert got == [
        (0, 55, 0, True), (1, 56, 0, False), (1, 56, 0, False), (1, 56, 0, False), (2, 55, 0, False),
        (3, 55, 0, False), (4, 56, 0, False), (5, 0, 5, True), (5, 1, 5, True),
    ]


def test_spanning_pairs_are_a_forest():
    """As many pairs as a greedy forest over the candidates has, and of the same estimates."""
    rng = np.random.default_rng(3)
    label, node = np.repeat(np.arange(40), 3), np.arange(120)
    i, j = np.triu_indices(120, 1)
    take = (label[i] != label[j]) & (rng.random(len(i)) < 0.05)
    i, j = i[take], j[take]
    estimate = rng.integers(5, 9, len(i)) / 10
    kept = links._spanning(label, i, j, estimate, node)
    root, want = list(range(40)), []

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in np.lexsort((j, i, -estimate)):
        x, y = top(label[i[k]]), top(label[j[k]])
        if x != y:
            root[x] = y
            want.append(k)
    assert sorted(kept) == sorted(want)


def test_hashed_lines_of_a_batch_equal_single_ones():
    lines = ["x" * 8, "abcdefghij", "öäüß long enough \U0001f600 for some windows", "abcdefgh"]
    hashes, starts = char_windows(lines, 8)
    for line, got in zip(lines, np.split(hashes, starts[1:])):
        assert set(got.tolist()) == set(char_shingles(line, 8).tolist()) and len(got) == len(line) - 7


def test_near_documents_equal_brute_force(documents):
    sets = {r.doc_id: word_set(r.text) for r in documents.collect()}
    want = united(sets, 75)
    got = near_dedup.decisions(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_near_links_within_a_crowd(spark):
    """Links at exactly 0.75 between single members of a family of 3,000 and documents beside it."""
    base = [f"w{k}" for k in range(501)]  # 497 shingles
    texts = []
    for k in range(3000):
        copy = list(base)
        copy[80 + k % 400] = f"edit{k}"
        texts.append(copy)
    for k in range(10):  # 71 shingles less: 426 of 568
        texts.append([f"own{k}-{x}" for x in range(71 + k % 2)] + texts[300 * k][71 + k % 2 :])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.decisions(docs).collect()}
    assert all(got[k] == 0 for k in range(3000))
    assert {k: got[3000 + k] for k in range(10)} == {k: 3000 + k if k % 2 else 0 for k in range(10)}


def test_near_crowd_below_the_threshold_forms_no_square(spark, monkeypatch):
    """200 documents at 0.72 of each other and of a family of 300: each pair is judged, none gets a row of its own."""
    base = [f"w{k}" for k in range(400)]  # 396 shingles
    texts = [[*base[: 80 + k], f"edit{k}", *base[81 + k :]] for k in range(300)]
    texts += [[f"own{k}-{x}" for x in range(64)] + base[64:] for k in range(200)]
    counts, whole = [], links.verified
    monkeypatch.setattr(links, "verified", lambda pairs, *more: counts.append(pairs.count()) or whole(pairs, *more))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.decisions(docs).collect()}
    assert got == {k: 0 if k < 300 else k for k in range(500)}
    assert sum(counts) <= near_dedup.FOREST.trees * 500


def test_crossing_links_span_what_all_pairs_link(spark, monkeypatch):
    """The links of a region of several tiles unite what all its pairs do, in fewer rows than it has components."""
    monkeypatch.setattr(links, "TILE_ITEMS", 16)
    rng = random.Random(9)
    texts = [" ".join(rng.sample("abcdefghij", 8)) for _ in range(120)]
    component = [rng.choice([0, 0, 0, k]) for k in range(120)]
    rows = [(7, k, 8, b"same", component[k], text) for k, text in enumerate(texts)]
    items = spark.createDataFrame(rows, "region long, node long, n long, sketch binary, component long, text string")
    met = links.crossing_items(items.drop("text").repartition(3), 0.75, 0.64)
    assert {r.node for r in met.collect()} == set(range(120))

    def words(text):
        return np.unique([ord(x) for x in text.split()]).astype(np.uint64)

    found = {(r.a, r.b) for r in links.crossing_links(met, items, words, 100).collect()}
    sets = [set(t.split()) for t in texts]
    assert found and all(sets[a] == sets[b] and component[a] != component[b] for a, b in found)
    assert len(found) < len(set(component)) * met.select("tile").distinct().count()
    given = [(f"c{component[k]}", k) for k in range(120)]

    def parts(edges):
        root = {x: x for e in given for x in e}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in [*given, *edges]:
            root[top(a)] = top(b)
        together = defaultdict(set)
        for x in root:
            together[top(x)].add(x)
        return {frozenset(x) for x in together.values()}

    assert parts(found) == parts((a, b) for a in range(120) for b in range(a) if sets[a] == sets[b])


def test_crossing_pairs_meet_in_tiles(spark, monkeypatch):
    """A region of several tiles gives every pair of different components that is alike, once."""
    monkeypatch.setattr(links, "TILE_ITEMS", 16)
    rng = random.Random(8)
    rows = []
    for k in range(400):
        region, component = (7, rng.choice([1, 1, 1, 2, k])) if k < 300 else (k // 5, k)
        rows.append((region, k, 100 + rng.randrange(60), bytes(rng.choice(b"ab") for _ in range(8)), component))
    df = spark.createDataFrame(rows, "region long, node long, n long, sketch binary, component long").repartition(3)
    want = {
        (a[1], b[1]) for k, a in enumerate(rows) for b in rows[k + 1 :]
        if a[0] == b[0] and a[4] != b[4] and min(a[2], b[2]) >= 0.75 * max(a[2], b[2])
        and sum(x == y for x, y in zip(a[3], b[3])) >= 0.64 * 8
    }
    got = [(r.a, r.b) for r in links.crossing_pairs(df, 0.75, 0.64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_candidates_go_as_pairs_and_many_as_items(spark, monkeypatch):
    """Every pair that is alike is a row or has both ends in a tile's items; rows stay in proportion to the tiles'."""
    monkeypatch.setattr(links, "TILE_ITEMS", 16)
    rng = random.Random(10)
    rows = []
    for k in range(400):
        region, component = (7, rng.choice([1, 1, 2, k])) if k < 200 else (k // 5, k)
        sketch = b"aaaaaaaa" if 100 < k < 200 else bytes(rng.choice(b"abc") for _ in range(8))
        rows.append((region, k, 100 + rng.randrange(60), sketch, component))
    df = spark.createDataFrame(rows, "region long, node long, n long, sketch binary, component long").repartition(3)
    want = {(r.a, r.b) for r in links.crossing_pairs(df, 0.75, 0.64).collect()}
    got = links.crossing_items(df, 0.75, 0.64, 2).collect()
    pairs = {(r.a, r.b) for r in got if r.tile is None}
    met = defaultdict(set)
    for r in got:
        if r.tile is not None:
            met[r.tile].add(r.node)
    assert pairs and met and pairs <= want
    assert all(any({a, b} <= nodes for nodes in met.values()) for a, b in want - pairs)
    assert len(got) <= 3 * links.tiles(df).count()


def brute_lines(rows):
    places, first = [], {}
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                places.append((i, k, line))
                first.setdefault(line, len(first))
    root = united({n: set(char_shingles(x).tolist()) for x, n in first.items()}, line_dedup.HUNDREDTHS)
    seen, dropped = set(), defaultdict(list)
    for i, k, line in places:
        if root[first[line]] in seen:
            dropped[i].append(k)
        seen.add(root[first[line]])
    return {i: dropped[i] for i, _ in rows}


def test_lines_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.dropped for r in line_dedup.decisions(documents).collect()}
    assert got == brute_lines(rows)


def test_line_stages_go_when_used_up(spark, edge, monkeypatch):
    """Whole lines are not kept beside the links, nor sketches in the tables that precede their exchange."""
    held, columns, whole = [], {}, Stages.write
    search = links.components

    def write(stages, df, name):
        columns[name] = df.columns
        return whole(stages, df, name)

    def components(forest, items, shingles, hundredths, stages, *more):
        held.append(set(stages.paths))
        found = search(forest, items, shingles, hundredths, stages, *more)
        held.append(set(stages.paths))
        return found

    monkeypatch.setattr(Stages, "write", write)
    monkeypatch.setattr(links, "components", components)
    assert line_dedup.decisions(edge).count() == 14
    assert held[0] == {"places", "forest", "items"} and held[1] == held[0] | {"components"}
    assert columns["regions"] == ["region", "node"]


def test_closest_candidates_are_proposed_once(spark, monkeypatch):
    """Every candidate of a second round would be one of the first: the last check follows the first round."""
    calls, closest = [], links.closest_pairs
    monkeypatch.setattr(links, "closest_pairs", lambda *x: calls.append(1) or closest(*x))
    lines = [f"A line of family {k // 4} that is long enough to be compared with others, copy {k % 4}" for k in range(80)]
    found = line_dedup.decisions(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.dropped for r in found.collect()} == brute_lines(list(enumerate(lines)))
    assert len(calls) == 1


def test_keys_travel_in_packs(spark):
    """Keys of several nodes are found from fewer rows than there are keys; a node counts once for a key."""
    rng = np.random.default_rng(4)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(-(2**62), 2**62, 400)[rng.integers(0, 400, 20_000)], rng.integers(0, 300, 20_000))]
    rows += [(int(k), 7) for k in rng.integers(-(2**62), 2**62, 20_000)] + [(5, 9), (5, 9)]
    want = defaultdict(set)
    for key, node in rows:
        want[key].add(node)
    df = spark.createDataFrame(rows, "key long, node long").coalesce(2)
    got = [tuple(r) for r in links.shared_keys(df, iter).collect()]
    assert sorted(got) == sorted((k, n, len(nodes)) for k, nodes in want.items() if len(nodes) > 1 for n in nodes)
    batches = [pa.RecordBatch.from_pylist([{"key": k, "node": n} for k, n in rows])]
    packs = list(links._packs(iter(batches), 64))
    assert sum(x.num_rows for x in packs) == 64 and sum(len(x.column("keys").flatten()) for x in packs) == len(rows)
    assert links.shared_keys(df.limit(0), iter).count() == 0


def test_lines_of_texts():
    """Blank lines are those of ASCII white space alone; every other line counts, with its place."""
    texts = ["", "\n", "a\n \t\x0b\x0c\r\n\nb\n", "\u00a0", "\x1c\n\x00", "a", "x\r\ny"]
    text, line_no, lines, hashes = line_dedup._lines(pa.array(texts))
    want = [(t, k, x) for t, whole in enumerate(texts) for k, x in enumerate(whole.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    assert list(zip(text.tolist(), line_no.tolist(), lines.to_pylist())) == want
    assert len({tuple(x) for x in hashes.tolist()}) == len({x for _, _, x in want})
    assert all(len(x) == 0 for x in line_dedup._lines(pa.array(["", " "])))


def test_lines_travel_in_packs(spark, monkeypatch):
    """Texts are read and split once, lines go in few rows, and those that share a hash with another have no sketch."""
    lines = ["a line that is long enough \U0001f600", "short", "another line of some length", "a line that is long enough \U0001f600"]
    nodes, others = np.array([1 << 40, 2 << 40, 65 << 40, 1 << 40]), np.array([7, 8, 9, 7])
    packs = line_dedup._packs(nodes, others, pa.array(lines), 64)
    assert packs.num_rows <= 3
    found, texts = line_dedup._unpacked(packs)
    assert dict(zip(found.tolist(), texts.to_pylist())) == dict(zip(nodes.tolist(), lines)) and len(found) == 3
    clash = line_dedup._packs(nodes[2:3], others[:1], pa.array(["the other line of that hash"]), 64)
    wanted = list(line_dedup._wanted(iter([pa.RecordBatch.from_arrays([pa.array(nodes[[0, 2, 0]])], ["node"])]), 64))
    for more, want in (([packs], [lines[0], lines[2]]), ([clash], [lines[0]])):
        table = pa.Table.from_batches([packs, *more, *wanted]).sort_by("part").combine_chunks()
        rows = [r for x in line_dedup._items(iter(table.to_batches())) for r in x.to_pylist()]
        long = [r["text"] for r in rows if len(r["text"]) > 8]
        assert sorted(long) == sorted(want)
    whole = line_dedup._split
    docs = spark.createDataFrame([(k, f"line {k} of some length\nthe same line in all") for k in range(40)], "doc_id long, text string")
    count = spark.sparkContext.accumulator(0)

    def split(batches, parts):
        for batch in batches:
            count.add(batch.num_rows)
            yield from whole(iter([batch]), parts)

    monkeypatch.setattr(line_dedup, "_split", split)
    assert {r.doc_id: r.dropped for r in line_dedup.decisions(docs).collect()} == brute_lines([tuple(r) for r in docs.collect()])
    assert count.value == 40


def test_similar_lines_equal_single_ones():
    rng = random.Random(6)
    first = ["".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randrange(8, 60))) for _ in range(200)]
    second = [x if k % 3 else x[: len(x) - k % 7] + "tail" * (k % 2) + x[:8] for k, x in enumerate(first)]
    want = [similar(char_shingles(x), char_shingles(y), 80) for x, y in zip(first, second)]
    assert similar_lines(first, second, 8, 80).tolist() == want and 0 < sum(want) < 200
    assert line_dedup._similar(first, second).tolist() == want and len(line_dedup._similar([], [])) == 0


def test_distinct_counts():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 9, n).astype(np.uint64) for n in (1, 5, 30, 2)]
    starts = np.cumsum([0, *map(len, sets[:-1])])
    assert distinct_counts(np.concatenate(sets), starts).tolist() == [len(set(x.tolist())) for x in sets]


def test_line_edges(spark, edge, empty):
    rows = line_dedup.decisions(edge).collect()
    assert len(rows) == 14
    by = {r.doc_id: r for r in rows}
    assert by[2].dropped == [0] and by[1].dropped == [] and by[4].n_lines == by[5].n_lines == 0
    assert sorted(r.n_dropped for r in rows if r.doc_id == 3) == [0, 1]
    cleaned = line_dedup.dedup_lines(edge)
    assert cleaned.columns == edge.columns and cleaned.count() == 14
    assert {r.doc_id: r.text for r in cleaned.collect()}[2] == ""
    assert line_dedup.decisions(empty).count() == line_dedup.dedup_lines(empty).count() == 0
    similar = spark.createDataFrame(
        [(2, "keep\n\nA line that is long enough to be compared with others."),
         (1, "A line that is long enough to be compared with others!\nB")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(similar).collect()}[2] == "keep\n"


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = connected(spark.createDataFrame(edges, "a long, b long"), Stages(spark, "test")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: root(x) for x in linked} and len(found) == len(linked)
