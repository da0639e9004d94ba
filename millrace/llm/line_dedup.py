"""Near-duplicate lines of a corpus: MinHash of character shingles, banding, exact Jaccard
verification, and distributed union-find; of each component the first line stays.

Fourteen bands of three values: lines at similarity 0.8 share no band with probability
(1 - 0.8 ** 3) ** 14 < 5e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import links
from millrace.llm.common import Stages, runs
from millrace.llm.shingles import Forest, char_shingles, distinct_counts, similar_lines, text_windows

WIDTH = 8
HUNDREDTHS = 80
BANDS = Forest(trees=14, shallow=3, deep=6, seed=2, more=172)
# 256 values estimate 0.8 with a deviation of 0.025.
LEAST_ESTIMATE = 0.7
# Lines of fewer shingles have no unequal neighbour at 0.8.
LEAST_SHINGLES = 4
# Code points of the lines whose windows are hashed at once; their values stay in a core's cache.
CHUNK_POINTS = 32_768
# Packs of lines are larger than those of keys, so that few rows are exchanged.
LEAST_PARTS = 64
PARTS_PER_PARTITION = 4
PACKS = "part int, nodes binary, others binary, sizes binary, bytes binary"
PACK_COLUMNS = [c.split()[0] for c in PACKS.split(", ")]
PLACES = "doc_id long, text_hash long, row long, lines array<struct<line_no: int, node: long, other: long>>"


def _joined(column: pa.Array, dtype: type) -> np.ndarray:
    """The values of all rows of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each start to the next."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The lines of so many bytes that follow each other in ``data``."""
    offsets = np.append(0, sizes.cumsum()).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _buffers(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin and end in their bytes, and the bytes. There must be a line that isn't empty."""
    _, ends, data = lines.buffers()
    return np.frombuffer(ends, np.int32)[lines.offset : lines.offset + len(lines) + 1], np.frombuffer(data, np.uint8)


def _packs(nodes: np.ndarray, others: np.ndarray, lines: pa.Array, parts: int) -> pa.RecordBatch:
    """Lines, each once, as one row for each part of their nodes."""
    part = links.part_of(nodes, parts)
    order = np.lexsort((others, nodes, part))
    order = order[np.append(True, (np.diff(nodes[order]) != 0) | (np.diff(others[order]) != 0))]
    found, starts = np.unique(part[order], return_index=True)
    starts = np.append(starts, len(order))
    ends, data = _buffers(lines.take(pa.array(order)))
    columns = (_cut(x, starts) for x in (nodes[order], others[order], np.diff(ends)))
    # A pack goes through a table, an exchange and three tasks.
    cuts = ends[starts].tolist()
    small = [pa.compress(data[x:y], "zstd", asbytes=True) for x, y in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(found), *columns, pa.array(small, pa.binary())], PACK_COLUMNS)


def _unpacked(packs: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Nodes and lines of all packs."""
    sizes = [np.frombuffer(x, np.int32) for x in packs.column("sizes").to_pylist()]
    small = packs.column("bytes").to_pylist()
    data = b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in zip(small, sizes))
    lines = _strings(np.frombuffer(data, np.uint8), np.concatenate([np.empty(0, np.int32), *sizes]))
    return _joined(packs.column("nodes"), np.int64), lines


def _chunks(lengths: list[int]):
    """Slices of successive lines of about ``CHUNK_POINTS`` code points, or of one longer line."""
    start, points = 0, 0
    for k, length in enumerate(lengths):
        if points and points + length > CHUNK_POINTS:
            yield slice(start, k)
            start, points = k, 0
        points += length
    if start < len(lengths):
        yield slice(start, len(lengths))


def _windowed(lines: pa.Array):
    """Slices of lines that have windows, with the windows' hashes and each line's first place among them."""
    if not len(lines):
        return
    lengths, (ends, data) = pc.utf8_length(lines).to_numpy(), _buffers(lines)
    for part in _chunks(lengths.tolist()):
        text = data[ends[part.start] : ends[part.stop]].tobytes().decode()
        yield part, *text_windows(text, lengths[part], WIDTH)


def _keys(batches):
    for batch in batches:
        nodes, lines = _unpacked(batch)
        # Fewer windows have fewer distinct shingles than LEAST_SHINGLES.
        long = np.asarray(pc.utf8_length(lines)) >= WIDTH + LEAST_SHINGLES - 1
        nodes, lines = nodes[long], lines.filter(pa.array(long))
        for part, hashes, starts in _windowed(lines):
            keys = BANDS.keys_of(BANDS.minima_of(hashes, starts, slice(0, BANDS.shallow)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.T.ravel()), pa.array(np.repeat(nodes[part], BANDS.trees))], ["key", "node"]
            )


def _wanted(batches, parts: int):
    """The nodes of a forest in packs without lines."""

    def packs(nodes: np.ndarray) -> pa.RecordBatch:
        nodes = np.unique(nodes)
        part = links.part_of(nodes, parts)
        order = part.argsort(kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        none = pa.nulls(len(found), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(found), _cut(nodes[order], np.append(starts, len(nodes))), none, none, none], PACK_COLUMNS
        )

    held, count = [], 0
    for batch in batches:
        held.append(batch.column("node").to_numpy())
        count += batch.num_rows
        if count >= links.PACK_KEYS:
            yield packs(np.concatenate(held))
            held, count = [], 0
    if count:
        yield packs(np.concatenate(held))


def _items(batches):
    """Sketches of the lines whose nodes are wanted in their part, each once. Lines that share a hash with another are
    left out."""
    for table in runs(batches, "part"):
        whole = np.asarray(table.column("bytes").is_valid())
        packs, wanted = table.filter(pa.array(whole)), table.filter(pa.array(~whole))
        (nodes, lines), others = _unpacked(packs), _joined(packs.column("others"), np.int64)
        kept = np.flatnonzero(np.isin(nodes, _joined(wanted.column("nodes"), np.int64)))
        if not len(kept):
            continue
        kept = kept[np.lexsort((others[kept], nodes[kept]))]
        first = np.append(True, np.diff(nodes[kept]) != 0)
        another = np.append(False, np.diff(others[kept]) != 0) & ~first
        kept = kept[first][~np.logical_or.reduceat(another, np.flatnonzero(first))]
        nodes, lines = nodes[kept], lines.take(pa.array(kept))
        for part, hashes, starts in _windowed(lines):
            n = distinct_counts(hashes, starts)
            minima = BANDS.minima_of(hashes, starts)
            sketch, deep = BANDS.bytes_of(minima, hashes, starts), BANDS.keys_of(minima).T
            deep = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS.trees), pa.array(deep.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[part]), pa.array(n), pa.array(sketch, pa.binary()), deep, lines[part]],
                ["node", "n", "sketch", "deep", "text"],
            )


def _shingles(line: str) -> np.ndarray:
    return char_shingles(line, WIDTH)


def _similar(first: list[str], second: list[str]) -> np.ndarray:
    """Which pairs of lines are linked, by all their windows; every line has one."""
    found = [np.empty(0, bool)]
    for part in _chunks([len(x) + len(y) for x, y in zip(first, second)]):
        found.append(similar_lines(first[part], second[part], WIDTH, HUNDREDTHS))
    return np.concatenate(found)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The lines that aren't blank: place of the text, line_no, line, and two hashes."""
    split = pc.split_pattern(texts, "\n")
    lines, text = split.flatten(), pc.list_parent_indices(split).to_numpy()
    line_no = np.arange(len(lines)) - text.searchsorted(text)
    kept = ~pc.or_(pc.equal(lines, ""), pc.ascii_is_space(lines)).to_numpy(zero_copy_only=False)
    lines = lines.filter(pa.array(kept))
    digests = b"".join(map(xxhash.xxh3_128_digest, lines.cast(pa.binary()).to_pylist()))
    return text[kept], line_no[kept].astype(np.int32), lines, np.frombuffer(digests, np.int64).reshape(-1, 2)


def _split(batches, parts: int):
    """The places of each text's lines, and the lines of a batch in packs."""

    def batch_of(kind: str, found: pa.RecordBatch) -> pa.RecordBatch:
        rows = found.num_rows
        own = [found.column(c.name) if c.name in found.schema.names else pa.nulls(rows, c.type) for c in schema]
        return pa.RecordBatch.from_arrays([*own, pa.array([kind] * rows)], [*schema.names, "kind"])

    line = pa.struct([("line_no", pa.int32()), ("node", pa.int64()), ("other", pa.int64())])
    schema = pa.schema([
        *((c, pa.int64()) for c in ("doc_id", "text_hash", "row")), ("lines", pa.list_(line)),
        ("part", pa.int32()), *((c, pa.binary()) for c in PACK_COLUMNS[1:]),
    ])
    for batch in batches:
        text, line_no, lines, hashes = _lines(batch.column("text"))
        starts = text.searchsorted(np.arange(batch.num_rows + 1)).astype(np.int32)
        # A second hash tells lines apart that share the first.
        nodes, others = (np.ascontiguousarray(hashes[:, k]) for k in range(2))
        places = pa.StructArray.from_arrays([pa.array(x) for x in (line_no, nodes, others)], ["line_no", "node", "other"])
        yield batch_of("places", pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text_hash", "row")), pa.ListArray.from_arrays(pa.array(starts), places)],
            ["doc_id", "text_hash", "row", "lines"],
        ))
        if len(lines):
            yield batch_of("texts", _packs(nodes, others, lines, parts))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_lines, n_dropped, dropped.

    ``n_lines`` counts lines that aren't blank, ``dropped`` lists the numbers (from 0, blank ones
    counted) of those that repeat an earlier one: an equal line, or a member of the same
    component of similar lines. Earlier is by id, then number; rows without an id come last.
    Blank lines and null or empty texts are left alone. Repeated rows are different documents. An
    empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "line-dedup")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"), text,
    )
    # Lines travel in packs, as their keys do, and meet the forest's nodes in the part of their node.
    parts = max(LEAST_PARTS, PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = rows.mapInArrow(lambda batches: _split(batches, parts), f"{PLACES}, {PACKS}, kind string")
    places, texts = stages.write_kinds(split, {"places": PLACES, "texts": PACKS})
    forest = stages.write(links.shared_keys(texts.select("nodes", "sizes", "bytes"), _keys), "forest")
    wanted = forest.select("node").mapInArrow(lambda batches: _wanted(batches, parts), PACKS)
    items = stages.write(
        texts.union(wanted).repartition("part").sortWithinPartitions("part").mapInArrow(
            _items, "node long, n long, sketch binary, deep array<long>, text string"
        ),
        "items",
    )
    stages.drop("texts")
    found = links.components(forest, items, _shingles, HUNDREDTHS, stages, LEAST_ESTIMATE, None, _similar)
    stages.drop("forest", "items")
    # A line that occurs once and is like no other stays; only the others are compared.
    times = places.select(F.explode("lines.node").alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    open_ = times.where("times > 1").select("node").union(found.select("node")).distinct()
    occurrences = places.select("doc_id", "row", F.explode("lines").alias("x")).select("doc_id", "row", "x.*")
    occurrences = stages.write(occurrences.join(open_, "node", "left_semi"), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "line_no", "row")
    firsts = occurrences.groupBy("node", "other").agg(F.min(place).alias("place"))
    alike = firsts.groupBy("node").agg(F.count("*").alias("texts"))
    firsts = firsts.join(alike, "node").join(found, "node", "left").withColumn(
        "component", F.when(F.col("texts") > 1, F.xxhash64("node", "other")).otherwise(F.coalesce("component", "node"))
    )
    stay = firsts.groupBy("component").agg(F.min("place").alias("place")).select("place.row", "place.line_no")
    goes = occurrences.select("row", "line_no").join(stay, ["row", "line_no"], "left_anti")
    goes = goes.groupBy("row").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    return (
        places.select("row", "doc_id", "text_hash", F.size("lines").cast("long").alias("n_lines"))
        .join(goes, "row", "left")
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
        .select("doc_id", "text_hash", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped lines. Rows that repeat an id and text keep the lines of the first."""
    found = decisions(docs, id_col, text_col).where("n_dropped > 0")
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.min_by("dropped", "n_dropped").alias("__dropped")
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    joined = docs.join(
        found, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left"
    )
    left = F.filter(F.split(text, "\n"), lambda x, k: ~F.array_contains("__dropped", k))
    cleaned = F.when(F.col("__dropped").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn(text_col, cleaned).select(*(f"`{c}`" for c in docs.columns))
