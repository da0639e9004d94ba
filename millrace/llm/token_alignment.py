"""Alignment of two tokenizers over the same texts, in Arrow arrays.

In a task, the token lists of a slice of texts are flattened with the indices of their parents; byte
ends are segmented cumulative sums of the entries' lengths; an Acero hash join on (text, end) finds where
both tokenizers end a token. Those places cut the tokens into groups, and the two tokens that end there
are linked. Each chunk of texts counts its id pairs (``Table.group_by``), Spark adds the
counts, and each chunk gets back the totals of its own pairs only.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Stages, documents, shipped

# Characters of texts that are aligned in one go, and that share a dictionary of id pairs.
SLICE, CHUNK = 1 << 19, 1 << 23
# A longer text is aligned in pieces.
PIECE = 1 << 18
# Where both tokenizers surely end a token: before a space between a visible character and a Latin letter.
_CUT = re.compile("(?<=[!-~À-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")
# Units between such cuts whose tokens a task remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level entry stands for: printable ones stand for themselves,
    the others follow from 256 on in the order of the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Files:
    """The two vocabularies as they lie in their files, a few MB at most: a byte-level BPE of the
    tokenizers library and a sentencepiece model."""

    byte_level: str
    pieces: bytes

    @staticmethod
    def load(byte_level_path: str, pieces_path: str) -> Files:
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            own = Files(a.read(), b.read())
        if len(own.byte_level) + len(own.pieces) > 256 << 20:
            raise ValueError("vocabularies of this size can't be sent to each executor")
        return own

    def open(self) -> Aligner:
        return Aligner(self)


class Side:
    """Entries by id, as bytes, lengths and decimal ids."""

    def __init__(self, entries: list[bytes]):
        self.entries = pa.array(entries, pa.binary())
        self.lengths = pa.array([len(e) for e in entries], pa.int64())
        self.names = pa.array([str(k) for k in range(len(entries))])

    def joined(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.entries.take(lists.values)), b"")

    def grouped(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The ids of each group as text; ``ends`` are the positions after the groups."""
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(ids)), ",")


@dataclass
class Aligned:
    """What is found in a piece of a text: ``groups`` as ``a1,a2|b1;a3|b2,b3`` and a code a << 32 | b for each link."""

    good: bool
    n_a: int = 0
    n_b: int = 0
    groups: str = ""
    links: np.ndarray | None = None


class Aligner:
    """A task's pair of tokenizers."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(files.byte_level)
        self.first.encode_special_tokens = True
        byte_of = byte_alphabet()
        vocabulary = self.first.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            entries[k] = bytes(map(byte_of.__getitem__, entry)) if all(c in byte_of for c in entry) else entry.encode()
        self.a = Side(entries)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.b = Side(
            [
                bytes([int(p[1:-1], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode()
                for k, p in enumerate(pieces)
            ]
        )
        # No piece goes on behind a word's end, so no merge crosses a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.older = self.known

    def parts(self, text: str) -> list[str]:
        """The text in pieces that begin where a space was taken away, which both sides put back."""
        out, start = [], 0
        while self.cuts and len(text) - start > PIECE and (cut := _CUT.search(text, start + PIECE)):
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def learn(self, units: set[str]) -> None:
        """Tokens of units, a space before each, as packed 32-bit integers."""
        new = []
        for unit in units:
            if unit in self.older[0]:
                for known, older in zip(self.known, self.older):
                    known[unit] = older[unit]
            else:
                new.append(unit)
        first = self.first.encode_batch_fast([" " + u for u in new], add_special_tokens=False)
        for unit, x, y in zip(new, first, self.second.encode(new, num_threads=1)):
            self.known[0][unit] = array("i", x.ids).tobytes()
            self.known[1][unit] = array("i", y).tobytes()

    def tokens(self, texts: list[str]) -> list[pa.ListArray]:
        """The ids of each piece by both sides, put together from its units."""
        if len(self.known[0]) > REMEMBERED:
            self.older, self.known = self.known, ({}, {})
        units = [_CUT.split(t) if self.cuts else [t] for t in texts]
        new = {u for own in units for u in own if u not in self.known[0]}
        self.learn(new)
        out = []
        for known in self.known:
            packed = [b"".join(map(known.__getitem__, own)) for own in units]
            offsets = np.cumsum([0, *map(len, packed)]) // 4
            values = np.frombuffer(b"".join(packed), "<i4")
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
        for unit in new:
            if len(unit) > LONGEST:
                for known in self.known:
                    del known[unit]
        return out

    def align(self, texts: list[str]) -> list[Aligned]:
        """Each of some non-empty pieces."""
        a, b = self.tokens(texts)
        want = pa.array([b" " + t.encode() for t in texts], pa.binary())
        good = pc.and_(pc.equal(self.a.joined(a), want), pc.equal(self.b.joined(b), want))
        kept = good.to_pylist()
        if not any(kept):
            return [Aligned(False) for _ in texts]
        if not all(kept):
            a, b, want = a.filter(good), b.filter(good), want.filter(good)
        size = pc.binary_length(want).cast(pa.int64())
        start = pc.subtract(pc.cumulative_sum(size), size)

        def ends(lists: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
            ids, parent = lists.flatten(), lists.value_parent_indices()
            end = pc.subtract(pc.cumulative_sum(lengths.take(ids)), start.take(parent))
            return pa.table({"text": parent, "end": end, f"{name}_at": np.arange(1, len(ids) + 1), name: ids})

        both = ends(a, self.a.lengths, "a").join(
            ends(b, self.b.lengths, "b"), keys=["text", "end"], join_type="inner", use_threads=False
        ).sort_by([("text", "ascending"), ("end", "ascending")])
        a_at, b_at = (both.column(c).to_numpy() for c in ("a_at", "b_at"))
        pairs = pc.binary_join_element_wise(self.a.grouped(a.flatten(), a_at), self.b.grouped(b.flatten(), b_at), "|")
        bounds = np.searchsorted(both.column("text").to_numpy(), np.arange(len(want) + 1))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs), ";").to_pylist()
        codes = both.column("a").to_numpy().astype(np.int64) << 32 | both.column("b").to_numpy().astype(np.int64)
        n_a, n_b = (np.diff(x.offsets.to_numpy()).tolist() for x in (a, b))
        found = iter(
            Aligned(True, n_a[k], n_b[k], groups[k], codes[bounds[k] : bounds[k + 1]]) for k in range(len(want))
        )
        return [next(found) if x else Aligned(False) for x in kept]

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[Aligned]]]:
        """(doc_id, characters, its aligned pieces) of every row, in order."""
        held: list[tuple[int | None, int, int]] = []
        parts: list[str] = []
        length = 0

        def aligned() -> Iterator[tuple[int | None, int, list[Aligned]]]:
            found = iter(self.align(parts) if parts else [])
            for doc_id, characters, count in held:
                yield doc_id, characters, [next(found) for _ in range(count)]
            held.clear()
            parts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if len(text) > PIECE:  # its pieces go one by one, so that memory doesn't grow with the text
                    yield from aligned()
                    length = 0
                    yield doc_id, len(text), [x for part in self.parts(text) for x in self.align([part])]
                    continue
                held.append((doc_id, len(text), int(bool(text))))
                parts.extend([text] if text else [])
                length += len(text)
                if length >= SLICE or len(held) >= 10_000:
                    yield from aligned()
                    length = 0
        yield from aligned()


def groups(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, groups): the aligned groups of each text, as ``a1,a2|b1;a3|b2,b3``.

    A text that is null, empty, or that either side's tokens don't give back with one space before it has no
    tokens: counts of 0 and an empty text.
    """
    shared = shipped(docs.sparkSession, files)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, _, found in shared().open().texts(batches):
            found = found if all(x.good for x in found) else []
            row = [[doc_id], [sum(x.n_a for x in found)], [sum(x.n_b for x in found)], [";".join(x.groups for x in found)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(),) * 3 + (pa.string(),))], ["doc_id", "n_a", "n_b", "groups"])

    return documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_a long, n_b long, groups string")


_SCANNED = "chunk long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links binary, a array<int>, b array<int>, n array<bigint>"


def _scan(shared: Callable[[], Files]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of texts, whose links are positions in their chunk's dictionary, and a row of each dictionary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        length = 0
        for doc_id, characters, found in shared().open().texts(batches):
            found = found if all(x.good for x in found) else []
            digest = hashlib.sha256()
            for k, x in enumerate(found):
                digest.update((";" * (k > 0) + x.groups).encode())
            own = [x.links for x in found]
            size = sum(map(len, own))
            rows.append((doc_id, sum(x.n_a for x in found), sum(x.n_b for x in found), size, digest.hexdigest() if found else ""))
            links += own
            length += characters
            if length >= CHUNK or len(rows) >= 100_000:
                yield _chunk(number, rows, links)
                number, rows, links, length = number + 1, [], [], 0
        if rows:
            yield _chunk(number, rows, links)

    return scan


def _chunk(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
    codes = pa.array(np.concatenate([np.empty(0, np.int64), *links])).dictionary_encode()
    pairs = codes.dictionary.to_numpy()
    counts = pa.table({"at": codes.indices}).group_by("at").aggregate([("at", "count")]).sort_by("at")
    places = codes.indices.to_numpy().astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
    after = np.cumsum([r[3] for r in rows])
    packed = [places[e - r[3] : e].tobytes() for r, e in zip(rows, after.tolist())]
    columns = list(zip(*rows))
    more = [[None]] if len(pairs) else [[]]  # the row of the dictionary
    arrays = [pa.array([number] * (len(rows) + len(more[0])), pa.int64())]
    arrays += [pa.array([*c, *more[0]], t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()))]
    arrays.append(pa.array([*packed, *more[0]], pa.binary()))
    for values, kind in ((pairs >> 32, pa.int32()), (pairs & 0xFFFFFFFF, pa.int32()), (counts.column("at_count").to_numpy(), pa.int64())):
        arrays.append(pa.array([None] * len(rows) + ([values] if len(pairs) else []), pa.list_(kind)))
    names = [f.split()[0] for f in _SCANNED.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names)


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The totals of a chunk's links, added up for each of its texts."""
    at = pairs.column("at").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at] = pairs.column("total").to_numpy()
    best[at] = pairs.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    kind = "<u2" if len(at) <= 1 << 16 else "<u4"
    sums, bests = [], []
    for packed in docs.column("links").to_pylist():
        own = np.frombuffer(packed, kind)
        sums.append(int(total[own].sum()))
        bests.append(int(best[own].sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def _scanned(docs: DataFrame, files: Files, stages: Stages) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, the pairs of each chunk, and all pairs with their totals."""
    scanned = docs.mapInArrow(_scan(shipped(docs.sparkSession, files)), _SCANNED)
    scanned = stages.write(scanned, "scanned")
    texts = scanned.where("n_a IS NOT NULL").select(
        F.col("chunk").alias("own_chunk"), "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links"
    )
    listed = scanned.where("a IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "pair"))
    listed = listed.select("chunk", "at", "pair.a", "pair.b", "pair.n")
    totals = listed.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = F.max("total").over(Window.partitionBy("b"))  # at most one row for each entry of the first side
    totals = stages.write(totals.withColumn("best", F.col("total") == highest), "totals")
    return texts, listed, totals


def links(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, total, best): how many links of all texts hold an id pair, and whether no other pair of
    that ``b`` has more. An empty table has none."""
    return _scanned(documents(docs, id_col, text_col), files, Stages(docs.sparkSession, "token-alignment"))[2]


def decisions(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Rows without tokens (see ``groups``) have zeros and an empty digest; rows keep their number and
    their ids, null or repeated. A text is aligned in pieces of about PIECE characters, cut where both sides end a
    token, so what a task holds is a chunk's links, two or four bytes each.
    """
    texts, listed, totals = _scanned(documents(docs, id_col, text_col), files, Stages(docs.sparkSession, "token-alignment"))
    marked = listed.join(totals, ["a", "b"]).select("chunk", "at", "total", "best")
    scored = texts.groupBy("own_chunk").cogroup(marked.groupBy("chunk")).applyInArrow(
        _score, "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return scored.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
