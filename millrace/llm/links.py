"""Near-duplicate links from sketches: shared keys, candidate regions, exact checks, components.

Every step is a sort or hash exchange of narrow rows. A region (the items that share one key)
is read as a sorted stream; only its items' sketches are compared, and at first at most a
spanning forest of its candidates leaves it. Crowded regions are then seen in parts. All further candidates follow
when components are known, from whole regions, and then only across components. They are compared
where they meet, and of their links too no more than a forest leaves a region, so neither a group of
copies nor one of texts just below the threshold becomes the square of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Stages, runs
from millrace.llm.shingles import TREE_MASK, similar

# For the first check, a region with more items than this is cut by its deeper key, and then into random
# blocks that differ from key to key.
REGION_ITEMS = 256
# For the last check nothing is cut: a larger region is dealt to tiles of about so many items or
# shingles, and every item outside the region's largest component visits all of them.
TILE_ITEMS = 1024
TILE_SHINGLES = 2_000_000
# Candidates of the last check go as pairs where a tile has at most so many for each of its items.
FEW = 2
# Edges that a task contracts at a time.
CHUNK_EDGES = 500_000
# Keys travel in packs of one part of the keys; a task makes packs of so many keys at a time.
PACK_KEYS = 200_000
LEAST_PARTS = 1024
PARTS_PER_PARTITION = 16


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (v, u) of each chunk as stars around its components' smallest nodes."""

    def stars(chunk: pa.Table) -> pa.RecordBatch:
        v, u = chunk.column("v").to_numpy(), chunk.column("u").to_numpy()
        nodes, ends = np.unique(np.concatenate([v, u]), return_inverse=True)
        x, y = ends[: len(v)], ends[len(v) :]
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root[x], root[y])
            lower = root.copy()
            for end in (x, y):
                np.minimum.at(lower, end, least)
                np.minimum.at(lower, root[end], least)
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        out = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["v", "u"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK_EDGES:
            yield stars(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield stars(pa.Table.from_batches(held))


def connected(edges: DataFrame, stages: Stages) -> DataFrame:
    """Distributed union-find: ``(node, component)`` for the nodes of ``edges`` (a, b).

    Tasks contract their chunks of edges to stars; large-star and small-star steps alternate with
    that until the edges no longer change. Each step is a written table. ``component`` is the
    smallest node that is reachable.
    """

    def contracted(pairs: DataFrame) -> DataFrame:
        return stages.write(pairs.distinct().mapInArrow(_contracted, "v long, u long").distinct(), "edges")

    def state_of(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()

    edges = contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")))
    seen = state_of(edges)
    while True:
        both = edges.union(edges.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(lower, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")),
                                      F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.*")
            .where("v <> u")
        )
        before = list(stages.paths.pop("edges"))
        edges = contracted(small)
        stages.paths["used"] = before
        stages.drop("used")
        state = state_of(edges)
        if state == seen:
            break
        seen = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each of the hashed ``keys``."""
    return ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _packs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) as rows (part, keys, nodes), a part being that of its keys."""

    def packs(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        part = part_of(keys, parts)
        order = part.argsort(kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (keys, nodes))
        return pa.RecordBatch.from_arrays([pa.array(found), *lists], ["part", "keys", "nodes"])

    held, count = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node")])
        count += batch.num_rows
        if count >= PACK_KEYS:
            yield packs(*map(np.concatenate, zip(*held)))
            held, count = [], 0
    if count:
        yield packs(*map(np.concatenate, zip(*held)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, "part"):
        keys, nodes = (
            np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks]) for c in ("keys", "nodes")
        )
        # Most keys have one node; only the others are put in order by node too.
        order = keys.argsort()
        same = np.diff(keys[order]) == 0
        order = order[np.append(False, same) | np.append(same, False)]
        keys, nodes = keys[order], nodes[order]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        keep = size > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, nodes, size)], ["key", "node", "size"])


def shared_keys(rows: DataFrame, keyed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows (key, node, size) of the keys that at least two nodes have, each once. ``size``: how many nodes.

    ``keyed`` makes batches (key, node) of those of ``rows``. Keys are exchanged in packs: a row for each key and
    node would cost more than the keys themselves.
    """
    parts = max(LEAST_PARTS, PARTS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(lambda batches: _packs(keyed(batches), parts), "part int, keys array<long>, nodes array<long>")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "key long, node long, size long")


def regions(forest: DataFrame, items: DataFrame) -> DataFrame:
    """(region, node): adaptive depth, the deeper key where many items share one."""
    tree = F.col("key").bitwiseAND(TREE_MASK).cast("int")
    crowded = forest.where(F.col("size") > REGION_ITEMS).drop("size")
    deeper = crowded.join(items.select("node", "deep"), "node").select(F.get("deep", tree).alias("region"), "node")
    full = deeper.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > REGION_ITEMS)
    blocks = F.pmod(F.xxhash64("node", "region"), F.ceil(F.col("size") / F.lit(REGION_ITEMS)))
    calm = forest.where(F.col("size") <= REGION_ITEMS).select(F.col("key").alias("region"), "node")
    return calm.union(
        deeper.join(full, "region", "left")
        .select(
            F.when(F.col("size").isNull(), F.col("region"))
            .otherwise(F.xxhash64("region", blocks)).alias("region"),
            "node",
        )
        .distinct()
    )


def _alike(n, sketch, i, j, ratio: float, least: float):
    """Those of the index pairs whose sizes and sketches allow a link, and their estimate."""
    ok = np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    estimate = (sketch[i] == sketch[j]).mean(axis=1) if len(i) else np.empty(0)
    ok = estimate >= least
    return i[ok], j[ok], estimate[ok]


def _columns(table: pa.Table | pa.RecordBatch):
    """node, component, n and sketch as arrays."""
    node, component, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
    return node, component, n, np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)


def _pairs(table: pa.Table, key: str, ratio: float, least: float):
    """Index pairs of equal ``key`` and different components that allow a link, and their estimate."""
    region = table.column(key).to_numpy()
    _, component, n, sketch = _columns(table)
    for offset in range(1, len(n)):
        same = region[offset:] == region[:-offset]
        if not same.any():
            return
        i = np.flatnonzero(same & (component[offset:] != component[:-offset]))
        i, j, estimate = _alike(n, sketch, i, i + offset, ratio, least)
        if len(i):
            yield i, j, estimate


PAIRS = "a long, b long, estimate double"


def _emit(node, i, j, estimate) -> pa.RecordBatch:
    x, y = node[i], node[j]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(estimate)],
        ["a", "b", "estimate"],
    )


def _spanning(label, i, j, estimate, node):
    """Indices of a spanning forest of the pairs over their labels, closest first."""
    x, y = node[i], node[j]
    order = np.lexsort((np.maximum(x, y), np.minimum(x, y), -estimate))
    i, j = label[i[order]], label[j[order]]
    chosen = np.zeros(len(i), bool)
    root = np.arange(int(label.max()) + 1)
    left = np.arange(len(i))
    while len(left):
        p, q = root[i[left]], root[j[left]]
        left, p, q = left[p != q], p[p != q], q[p != q]
        if not len(left):
            break
        # Ranks are unique, so closest pairs form no cycle but a pair that both ends chose.
        closest = np.full(len(root), len(i))
        np.minimum.at(closest, p, left)
        np.minimum.at(closest, q, left)
        ends = np.flatnonzero(closest < len(i))
        edge = closest[ends]
        chosen[edge] = True
        above = np.arange(len(root))
        above[ends] = root[i[edge]] + root[j[edge]] - ends
        both = (above[above] == np.arange(len(root))) & (np.arange(len(root)) < above)
        above[both] = np.flatnonzero(both)
        while (above[above] != above).any():
            above = above[above]
        root = above[root]
    return order[chosen]


def closest_pairs(rows: DataFrame, ratio: float, least: float) -> DataFrame:
    """For each region a spanning forest of the closest candidates that join its components: fewer
    pairs than the region has components, and if all are links, none of its candidates is open."""

    def scan(batches):
        for table in runs(batches, "region"):
            found = list(_pairs(table, "region", ratio, least))
            if not found:
                continue
            i, j, estimate = (np.concatenate(x) for x in zip(*found))
            region, component = table.column("region").to_numpy(), table.column("component").to_numpy()
            order = np.lexsort((component, region))
            fresh = np.ones(len(order), np.int64)
            fresh[1:] = (np.diff(region[order]) != 0) | (np.diff(component[order]) != 0)
            label = np.empty(len(order), np.int64)
            label[order] = fresh.cumsum() - 1
            node = table.column("node").to_numpy()
            kept = _spanning(label, i, j, estimate, node)
            yield _emit(node, i[kept], j[kept], estimate[kept])

    found = rows.repartition("region").sortWithinPartitions("region", "n", "node").mapInArrow(scan, PAIRS)
    return found.select("a", "b").distinct()


def crowds(rows: DataFrame) -> DataFrame:
    """(region, blocks, largest) of the regions of several tiles: how many, and the largest component."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(TILE_ITEMS), F.sum("n") / F.lit(TILE_SHINGLES)))
    several = rows.groupBy("region").agg(blocks.alias("blocks")).where("blocks > 1")
    parts = rows.join(several.select("region"), "region", "left_semi").groupBy("region", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("region").agg(F.max(F.struct("size", "component"))["component"].alias("largest"))
    return several.join(largest, "region")


def tiles(rows: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """(tile, block, own, large, node, component, n, sketch) of whole regions. ``several``: what ``crowds`` finds.

    An item is at home in the tile of its ``own`` block. In a region of several tiles each item
    outside the largest component (``large``) visits the other tiles. So any two items of different
    components meet, and the copies are the other components' items times the tiles. In a region of one
    tile nothing visits, and no component counts as the largest.
    """
    dealt = rows.join(crowds(rows) if several is None else several, "region", "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumns({
        "own": F.pmod(F.xxhash64("node", "region"), F.col("blocks")),
        "large": F.coalesce(F.col("component") == F.col("largest"), F.lit(False)),
    })
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("large"), F.array("own")).otherwise(every)))
    return dealt.select(
        F.xxhash64("region", "block").alias("tile"), "block", "own", "large", "node", "component", "n", "sketch"
    )


def homes_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Regroups rows sorted by tile, those at home first: (False, whole tiles at home) and (True,
    some visitors of the last of these tiles). Holds one tile's home and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        visiting = batch.column("own").to_numpy() != batch.column("block").to_numpy()
        turns = (visiting[1:] != visiting[:-1]) | visiting[1:] & (tile[1:] != tile[:-1])
        ends = [*(np.flatnonzero(turns) + 1).tolist(), len(tile)]
        for start, end in zip([0, *ends], ends):
            if held and (visiting[start] or tile[start] != held[-1].column("tile")[-1].as_py()):
                yield False, pa.Table.from_batches(held)
                held = []
            if visiting[start]:
                yield True, pa.Table.from_batches([batch.slice(start, end - start)])
                continue
            last = start + int(tile[start:end].searchsorted(tile[end - 1]))
            if last > start:
                yield False, pa.Table.from_batches([*held, batch.slice(start, last - start)])
                held = []
            held.append(batch.slice(last, end - last))
    if held:
        yield False, pa.Table.from_batches(held)


def _visits(home: pa.Table, visitors: pa.Table, ratio: float, least: float):
    """Candidates of visitors among the items at home, as indices into both tables, one after the other."""
    block, large = home.column("block")[0].as_py(), np.array(home.column("large").to_pylist())
    _, component, n, sketch = (np.concatenate(x) for x in zip(_columns(home), _columns(visitors)))
    count, from_ = home.num_rows, visitors.column("own").to_numpy()
    for k in range(visitors.num_rows):
        i = np.flatnonzero(_meets(large, from_[k], block) & (component[:count] != component[count + k]))
        i, j, estimate = _alike(n, sketch, i, np.full(len(i), count + k), ratio, least)
        if len(i):
            yield i, j, estimate


def _meets(large: np.ndarray, own: int, block: int) -> np.ndarray:
    """Which items at home in ``block`` a visitor meets there."""
    # Visitors from lower blocks have met their like there, but not the largest component.
    return large if own < block else np.ones(len(large), bool)


def _meetings(batches: Iterator[pa.RecordBatch], ratio: float, least: float):
    """Tables of items that meet, how many of their first items have been in one before, and their candidates as
    indices. Holds one tile's home and one batch."""
    home = None
    for visiting, table in homes_first(batches):
        tile = table.column("tile").to_numpy()
        if not visiting:
            home = table.slice(int(np.searchsorted(tile, tile[-1])))
            yield table, 0, _pairs(table, "tile", ratio, least)
        elif home is not None and home.column("tile")[0].as_py() == tile[0]:
            yield pa.concat_tables([home, table]), home.num_rows, _visits(home, table, ratio, least)


def _by_tile(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of tiles as ``homes_first`` reads them."""
    visits = rows.withColumn("visits", F.col("own") != F.col("block"))
    return visits.repartition("tile").sortWithinPartitions("tile", "visits", *order).drop("visits")


def crossing_pairs(rows: DataFrame, ratio: float, least: float) -> DataFrame:
    """All candidates between different components; rows (region, node, n, sketch, component)."""

    def scan(batches):
        for table, _, found in _meetings(batches, ratio, least):
            node = table.column("node").to_numpy()
            for i, j, estimate in found:
                yield _emit(node, i, j, estimate)

    return _by_tile(tiles(rows), "n", "node").mapInArrow(scan, PAIRS)


MET = "tile long, block long, own long, large boolean, node long, component long"


def _few_or_met(table: pa.Table, before: int, found, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates (i, j) of the tiles that have at most ``few`` for each item, and a mask of the items that
    the other tiles' candidates are of. Holds no more candidates than that."""
    _, of = np.unique(table.column("tile").to_numpy(), return_inverse=True)
    most = few * np.bincount(of[before:], minlength=of.max() + 1)
    count, met, held = np.zeros(len(most), np.int64), np.zeros(len(of), bool), []
    for i, j, _ in found:
        count += np.bincount(of[i], minlength=len(count))
        many = (count > most)[of[i]]
        met[i[many]] = met[j[many]] = True
        held.append((i[~many], j[~many]))
    i, j = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
    many = (count > most)[of[i]]
    met[i[many]] = met[j[many]] = True
    return i[~many], j[~many], met


def crossing_items(rows: DataFrame, ratio: float, least: float, few: int = 0, several: DataFrame | None = None) -> DataFrame:
    """What ``crossing_pairs`` finds, as rows of MET, a and b that are no more than a few for each row of ``tiles``: of a
    tile with at most ``few`` candidates for each item the pairs (a, b), of another the items (MET)."""
    names = [c.split()[0] for c in MET.split(", ")]
    kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in MET.split(", ")]

    def scan(batches):
        for table, before, found in _meetings(batches, ratio, least):
            i, j, met = _few_or_met(table, before, found, few)
            if len(i):
                ends = _emit(table.column("node").to_numpy(), i, j, np.zeros(len(i)))
                none = [pa.nulls(len(i), kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([*none, ends.column("a"), ends.column("b")], [*names, "a", "b"])
            if met.any():
                for batch in table.select(names).filter(pa.array(met)).combine_chunks().to_batches():
                    none = pa.nulls(batch.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.columns, none, none], [*names, "a", "b"])

    return _by_tile(tiles(rows, several), "n", "node").mapInArrow(scan, f"{MET}, a long, b long").distinct()


class _Home:
    """The whole sets of a tile's items at home, and the components that its links have united."""

    def __init__(self, table: pa.Table, shingles: Callable[[str], np.ndarray], hundredths: int):
        self.tile, self.block = table.column("tile")[0].as_py(), table.column("block")[0].as_py()
        self.node, self.component = (table.column(c).to_numpy() for c in ("node", "component"))
        self.large = np.array(table.column("large").to_pylist())
        self.shingles, self.hundredths, self.above = shingles, hundredths, {}
        sets = [shingles(text) for text in table.column("text").to_pylist()]
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        values, holders = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = values.argsort(kind="stable")
        self.values, self.holders = values[order], holders[order]
        kinds, of, sizes = np.unique(self.component, return_inverse=True, return_counts=True)
        # Two items of different components are not both of the most frequent one.
        self.others = {int(k): sets[k] for k in np.flatnonzero(of != sizes.argmax())}

    def _common(self, own: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with the items at home."""
        first, end = (self.values.searchsorted(own, side) for side in ("left", "right"))
        count = end - first
        places = np.repeat(first - (count.cumsum() - count), count) + np.arange(count.sum())
        return np.bincount(self.holders[places], minlength=len(self.n))

    def _top(self, component: int) -> int:
        while (above := self.above.get(component, component)) != component:
            self.above[component] = self.above.get(above, above)
            component = above
        return component

    def _links(self, node: int, component: int, own: np.ndarray, meets: np.ndarray):
        """Links of an item that join components not yet joined in this tile."""
        common = self._common(own)
        alike = meets & (common > 0) & (self.component != component)
        alike &= 100 * common >= self.hundredths * (self.n + len(own) - common)
        like = np.flatnonzero(alike)
        for other, k in zip(*np.unique(self.component[like], return_index=True)):
            x, y = self._top(component), self._top(int(other))
            if x != y:
                self.above[max(x, y)] = min(x, y)
                end = int(self.node[like[k]])
                yield min(node, end), max(node, end)

    def inner(self):
        every = np.ones(len(self.n), bool)
        for k, own in self.others.items():
            yield from self._links(int(self.node[k]), int(self.component[k]), own, every)

    def visited(self, table: pa.Table):
        columns = (table.column(c).to_pylist() for c in ("node", "component", "own", "text"))
        for node, component, from_, text in zip(*columns):
            yield from self._links(node, component, self.shingles(text), _meets(self.large, from_, self.block))


def crossing_links(met: DataFrame, items: DataFrame, shingles: Callable[[str], np.ndarray], hundredths: int) -> DataFrame:
    """Links (a, b) that join the components of the ``met`` items of each tile, by their whole texts.

    Every pair of a tile is compared where it meets, and a tile gives fewer links than it has
    components: no row stands for a pair.
    """

    def scan(batches):
        home = None
        for visiting, table in homes_first(batches):
            tile = table.column("tile").to_numpy()
            if visiting:
                found = list(home.visited(table)) if home is not None and home.tile == tile[0] else []
            else:
                found, cuts = [], np.flatnonzero(tile[1:] != tile[:-1]) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tile)]):
                    home = _Home(table.slice(start, end - start), shingles, hundredths)
                    found += home.inner()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    texts = met.join(items.select("node", "text"), "node")
    texts = texts.select("tile", "block", "own", "large", "node", "component", "text")
    return _by_tile(texts, "node").mapInArrow(scan, "a long, b long").distinct()


def verified(
    pairs: DataFrame, items: DataFrame, shingles: Callable[[str], np.ndarray], hundredths: int,
    alike: Callable[[list[str], list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """The pairs (a, b) whose whole texts have sets of ``shingles`` that are similar enough. ``alike`` says the same of
    many pairs of texts at once."""

    def scan(batches):
        last, y = None, None
        for batch in batches:
            ok = []
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            if alike is not None:
                yield batch.select(["a", "b"]).filter(pa.array(alike(text_a.to_pylist(), text_b.to_pylist())))
                continue
            for k, b in enumerate(batch.column("b").to_pylist()):
                if b != last:
                    last, y = b, shingles(text_b[k].as_py())
                ok.append(similar(shingles(text_a[k].as_py()), y, hundredths))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (
        pairs.select("a", "b")
        .join(items.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(items.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(scan, "a long, b long")
    )


def components(
    forest: DataFrame,
    items: DataFrame,
    shingles: Callable[[str], np.ndarray],
    hundredths: int,
    stages: Stages,
    least: float,
    given: DataFrame | None = None,
    alike: Callable[[list[str], list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """(node, component) of the linked nodes.

    ``forest``: (key, node, size) with shared keys. ``items``: (node, n, sketch, deep, text). ``given``:
    edges (a, b) that hold without a check. ``alike``: as for ``verified``.
    First the closest candidates that span each region are checked on the full sets, and the links
    are united. A second round would find none that is new: what spans a region closest after some of its
    components are united is part of what spanned it before. Then all remaining candidates between
    components are checked once, from the uncut regions. Pairs within a component need no check: they
    change nothing.
    """
    ratio = hundredths / 100
    rows = stages.write(regions(forest, items), "regions")
    known = None if given is None else stages.write(connected(given, stages), "known")
    if known is None:
        labelled = _sketched(rows.withColumn("component", F.col("node")), items)
    else:
        labelled = stages.write(_crossing(rows, known, items), "labelled")
    tried = stages.write(closest_pairs(labelled, ratio, least), "tried")
    stages.drop("labelled", "regions")
    links = stages.write(verified(tried, items, shingles, hundredths, alike), "links")
    known = stages.write(connected(_between(links, known), stages), "known")
    whole = stages.write(_crossing(forest.withColumnRenamed("key", "region"), known, items), "whole")
    several = stages.write(crowds(whole), "crowds")
    met = stages.write(crossing_items(whole, ratio, least, FEW, several), "met")
    stages.drop("whole", "crowds")
    # A pair meets in the tiles of all keys it shares, and is checked once.
    pairs = met.where("tile is null").select("a", "b").join(tried, ["a", "b"], "left_anti")
    many = crossing_links(met.where("tile is not null").drop("a", "b"), items, shingles, hundredths)
    more = stages.write(verified(pairs, items, shingles, hundredths, alike).union(many), "links")
    found = stages.write(connected(_between(more, known), stages), "components")
    stages.drop("met", "links", "known", "edges", "tried")
    return found


def _crossing(rows: DataFrame, known: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (region, node) of the regions with items of several components, with component, size and sketch."""
    labelled = rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = labelled.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return _sketched(labelled.join(ends.where("x <> y").select("region"), "region", "left_semi"), items)


def _sketched(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The narrow rows are exchanged, a sketch only once for each item."""
    return rows.join(items.select("node", "n", "sketch"), "node").select("region", "node", "n", "sketch", "component")


def _between(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """``links`` as edges between components, with the edges that hold the components together."""
    if known is None:
        return links
    label = lambda end: F.coalesce(f"component_{end}", end)
    for end in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    edges = links.select(label("a").alias("a"), label("b").alias("b")).distinct()
    return edges.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
