"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by merges on a heap.

Tier 1: a hash-and-displace table maps each of the n vocabulary entries to its own slot of n; a
pre-token is looked up with one 64-bit hash and one comparison of bytes. Tier 2, for
pre-tokens that are not entries: bytes as a doubly linked list, candidate merges on a heap by
(rank, position), so a pre-token of m bytes takes O(m log m).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import sys
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, shipped

# Encoded pre-tokens in each of the two generations that a task remembers.
REMEMBERED = 200_000
# Characters of texts that are cut before new pre-tokens are looked up together, and pre-tokens of a longer
# text that are held at a time.
SLICE, PRE_TOKENS = 1 << 18, 1 << 16


def _mix(value: np.ndarray, salt: np.ndarray) -> np.ndarray:
    value = (value ^ salt * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash over distinct keys: a displacement for each bucket of about four keys."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        hashes = self.hashes(keys)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        members = np.split(order, np.cumsum(np.bincount((hashes % np.uint64(self.buckets)).astype(int), minlength=self.buckets))[:-1])
        self.salt = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        free = None
        for bucket in sorted(range(self.buckets), key=lambda k: -len(members[k])):
            keys_in = members[bucket]
            if not len(keys_in):
                break
            if len(keys_in) == 1:  # the slot itself, as a negative displacement
                free = list(np.flatnonzero(self.key_at < 0)) if free is None else free
                slot = free.pop()
                self.salt[bucket], self.key_at[slot] = -slot - 1, keys_in[0]
                continue
            start, tries = 0, np.arange(1, 33, dtype=np.uint64)
            while True:
                slots = (_mix(hashes[keys_in][:, None], tries + np.uint64(start)) % np.uint64(self.n)).astype(int)
                ordered = np.sort(slots, axis=0)
                good = (self.key_at[slots] < 0).all(axis=0) & (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    first = int(good.argmax())
                    self.salt[bucket], self.key_at[slots[:, first]] = start + first + 1, keys_in
                    break
                start += len(tries)
                tries = np.arange(1, min(4096, 4 * len(tries)) + 1, dtype=np.uint64)

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only entry that it can be; compare the bytes."""
        if not self.n:
            return np.full(len(keys), -1)
        hashes = self.hashes(keys)
        salt = self.salt[(hashes % np.uint64(self.buckets)).astype(int)]
        slots = (_mix(hashes, np.maximum(salt, 0).astype(np.uint64)) % np.uint64(self.n)).astype(int)
        return self.key_at[np.where(salt < 0, -salt - 1, slots)]


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that cuts texts before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.entries, self.ids = list(ranks), list(ranks.values())
        self.table = PerfectHash(self.entries)

    def open(self) -> Codec:
        return Codec(self)


class Codec:
    """A task's encoder and decoder."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.cut = self.pattern.findall
        self.ranks = dict(zip(vocabulary.entries, vocabulary.ids))
        self.entry_of = dict(zip(vocabulary.ids, vocabulary.entries))
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Least rank first, leftmost of equal ones. A candidate is one number: rank, start and end."""
        get, m = self.ranks.get, len(piece)
        bits = m.bit_length()
        mask, wide = (1 << bits) - 1, 2 * bits
        after, before, ends = list(range(1, m + 1)), list(range(-1, m - 1)), list(range(1, m + 1))
        heap = [r << wide | i << bits | i + 2 for i in range(m - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            least = heappop(heap)
            i, end = least >> bits & mask, least & mask
            j = after[i]
            if j >= m or ends[j] != end or not ends[i]:
                continue
            ends[j], ends[i] = 0, end  # a part without an end is gone
            k = after[i] = after[j]
            if k < m:
                before[k] = i
                last = ends[k]
                if (r := get(piece[i:last])) is not None:
                    heappush(heap, r << wide | i << bits | last)
            left = before[i]
            if left >= 0 and (r := get(piece[left:end])) is not None:
                heappush(heap, r << wide | left << bits | end)
        ranks = self.ranks
        return [ranks[piece[i:end]] for i, end in enumerate(ends) if end]

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Ids of pre-tokens that are not at hand, as little-endian 32-bit integers.

        When the younger generation is full it becomes the older one; what is used again moves back.
        """
        packed = self.packed
        new = {t for t in pre_tokens if t not in packed}
        for token in new & self.older.keys():
            packed[token] = self.older[token]
            new.discard(token)
        if not new:
            return
        tokens = list(new)
        pieces = [t.encode("utf-8", "surrogatepass") for t in tokens]
        entries, ids = self.vocabulary.entries, self.vocabulary.ids
        for token, piece, k in zip(tokens, pieces, self.vocabulary.table.candidates(pieces).tolist()):
            found = [ids[k]] if k >= 0 and entries[k] == piece else self.merge(piece)
            packed[token] = array("I", found).tobytes()

    def join(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of pre-tokens."""
        if len(self.packed) > REMEMBERED:
            self.packed, self.older = {}, self.packed
        self.learn(itertools.chain.from_iterable(lists))
        return [b"".join(map(self.packed.__getitem__, own)) for own in lists]

    def encode(self, text: str) -> bytes:
        """Packed ids of one text, whose pre-tokens are never held all at once if it is long."""
        if len(text) <= SLICE:
            return self.join([self.cut(text)])[0]
        found = (m[0] for m in self.pattern.finditer(text))
        return b"".join(self.join([part])[0] for part in iter(lambda: list(itertools.islice(found, PRE_TOKENS)), []))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; texts of about SLICE characters share their look-ups."""
        held: list[str] = []
        length = 0
        for text in texts:
            if length + len(text) > SLICE:
                yield from self.join([self.cut(t) for t in held])
                held, length = [], 0
                if len(text) > SLICE:
                    yield self.encode(text)
                    continue
            held.append(text)
            length += len(text)
        yield from self.join([self.cut(t) for t in held])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.entry_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def load_vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """Ranks from a file of lines ``base64 rank``, a few MB at most."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if sys.getsizeof(ranks) > 256 << 20:
        raise ValueError("a vocabulary of this size can't be sent to each executor")
    return Vocabulary(ranks, pattern)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): packed little-endian unsigned 32-bit ids of every whole text.

    A null text is empty and has no ids. Special tokens' strings are ordinary text. Rows keep
    their number and their ids, null or repeated; an empty table gives no rows.
    """
    shared = shipped(docs.sparkSession, vocabulary)

    def scan(batches):
        codec = shared().open()
        for batch in batches:
            ids = list(codec.encode_all(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, bytes): what the ids stand for; null ids are an empty text."""
    shared = shipped(encoded.sparkSession, vocabulary)

    def scan(batches):
        codec = shared().open()
        for batch in batches:
            text = [codec.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(text, pa.binary())], ["doc_id", "ids", "bytes"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, ids binary, bytes binary")


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Token count and SHA-256 of the ids and of the text decoded from them."""
    shown = decode(encoded, vocabulary)
    return shown.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests(encode(docs))`` in one pass, with one codec a task: each text is encoded, its ids are decoded,
    and only their digests leave the task. Rows as in ``encode``."""
    shared = shipped(docs.sparkSession, vocabulary)

    def scan(batches):
        codec = shared().open()
        for batch in batches:
            counts, ids, texts = [], [], []
            for packed in codec.encode_all(batch.column("text").to_pylist()):
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents(docs, id_col, text_col).mapInArrow(scan, schema)
