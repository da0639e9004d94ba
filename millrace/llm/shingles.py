"""Hashed shingle sets and MinHash sketches (NumPy, one text at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown to ``bound`` words."""

    bound = 100_000

    def __reduce__(self):
        return WordHashes, ()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    moved = values >> np.uint64(32)
    moved ^= values
    moved *= _MIX
    moved ^= moved >> np.uint64(29)
    return moved


def _polynomials(units: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` units, led by the width; windows of one, two, four ...
    units are put together."""
    total, covered = np.full(len(units) + 1, width, np.uint64), 0
    part, length = units, 1  # windows of ``length`` units
    power = np.array([_BASE])  # _BASE ** length, modulo 2 ** 64
    while True:
        if width & length:
            # A window's first ``covered`` units are in ``total``.
            count = len(units) - covered - length + 1
            total = total[:count] * power
            total += part[covered : covered + count]
            covered += length
        if covered == width:
            return total
        after, part = part[length:], part[:-length] * power
        part += after
        power, length = power * power, 2 * length


def _windows(units: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all windows; a shorter sequence is one window, an empty one none."""
    if not len(units):
        return np.empty(0, np.uint64)
    width = min(width, len(units))
    values = mixed(_polynomials(units, width))
    values.sort()
    return values[_firsts(values)]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of the sorted values differ from the one before."""
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return first


def word_shingles(text: str, width: int = 5) -> np.ndarray:
    """Words split at ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return _windows(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)), width)


def char_shingles(text: str, width: int = 8) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _windows(points * _MIX, width)


def char_windows(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of lines that have at least one, one line after the other, and each
    line's first place among them."""
    return text_windows("".join(lines), np.fromiter(map(len, lines), np.int64, len(lines)), width)


def text_windows(text: str, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``char_windows`` of the lines of so many code points that follow each other in ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _MIX
    total = _polynomials(points, width)
    count = len(total)
    lengths = lengths.astype(np.int64)
    ends = lengths.cumsum()
    inside = np.ones(count, bool)
    for k in range(1, width):
        inside[ends[:-1] - k] = False
    return mixed(total[inside]), np.concatenate([[0], (lengths - width + 1).cumsum()[:-1]])


def distinct_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of distinct hashes of each of the sets that begin at ``starts``."""
    values = hashes.copy()
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
        values[start:end].sort()
    first = _firsts(values)
    first[starts] = True
    return np.add.reduceat(first, starts, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    """100 * intersection >= hundredths * union, and not both empty."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = np.count_nonzero(both[1:] == both[:-1])
    return 100 * common >= hundredths * (len(a) + len(b) - common)


def similar_lines(first: list[str], second: list[str], width: int, hundredths: int) -> np.ndarray:
    """``similar`` for each pair of lines that have at least one window."""
    bits = np.uint64(max(1, len(first).bit_length()))  # of each hash, for the number of its pair

    def sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, starts = char_windows(lines, width)
        pair = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(starts, len(hashes))))
        values = (pair << (np.uint64(64) - bits)) | (hashes >> bits)
        values.sort()
        values = values[_firsts(values)]
        return values, count_of(values)

    def count_of(values: np.ndarray) -> np.ndarray:
        return np.bincount((values >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(first))

    (a, n), (b, m) = sets(first), sets(second)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = count_of(both[1:][both[1:] == both[:-1]])
    return 100 * common >= hundredths * (n + m - common)


def _least(a: np.ndarray, b: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for start in range(0, len(shingles), 1024):
        least = np.minimum(least, (a * shingles[start : start + 1024] + b).min(axis=1))
    return least


def _least_of(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each permutation and each of the sets that begin at ``starts``, the least value."""
    a, b, values = a.astype(np.uint32), b.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least, moved = np.empty((*a.shape, len(starts)), np.uint32), np.empty_like(values)
    for place in np.ndindex(*a.shape):
        np.multiply(values, a[place], out=moved)
        np.add(moved, b[place], out=moved)
        np.minimum.reduceat(moved, starts, out=least[place])
    return least


# The low bits of a key are the number of its tree.
TREE_MASK = 31


class Forest:
    """``trees`` signature orders of ``deep`` MinHash values each, keyed at depth ``shallow``."""

    def __init__(self, trees: int, shallow: int, deep: int, seed: int = 1, more: int = 0):
        """``more`` values serve estimates only."""
        if trees > TREE_MASK + 1:
            raise ValueError("too many trees")
        self.trees, self.shallow, self.deep = trees, shallow, deep
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 2**63, trees * deep, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, trees * deep, np.uint64)
        self.more_a = draw.integers(1, 2**63, (more, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.more_b = draw.integers(0, 2**63, (more, 1), np.uint64)

    def minima(self, shingles: np.ndarray, only: slice | None = None) -> np.ndarray:
        """The least value of each permutation, as (trees, depth)."""
        a = self.a.reshape(self.trees, self.deep)
        b = self.b.reshape(self.trees, self.deep)
        if only is not None:
            a, b = a[:, only], b[:, only]
        depth = a.shape[1]
        return _least(a.reshape(-1, 1), b.reshape(-1, 1), shingles).reshape(self.trees, depth)

    def keys(self, minima: np.ndarray, depth: int) -> np.ndarray:
        """One key for each tree: its first ``depth`` values."""
        key = np.arange(1, self.trees + 1, dtype=np.uint64) * _BASE
        for k in range(depth):
            key = mixed(key * _BASE + mixed(minima[:, k]))
        tree = np.arange(self.trees, dtype=np.uint64)
        return (key & ~np.uint64(TREE_MASK) | tree).view(np.int64)

    def shallow_keys(self, shingles: np.ndarray) -> np.ndarray:
        return self.keys(self.minima(shingles, slice(0, self.shallow)), self.shallow)

    def sketch(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Keys at full depth, and one byte of each minimum for estimates."""
        minima = self.minima(shingles)
        every = np.concatenate([minima.ravel(), _least(self.more_a, self.more_b, shingles)])
        return self.keys(minima, self.deep), (mixed(every) >> np.uint64(56)).astype(np.uint8).tobytes()

    def minima_of(self, hashes: np.ndarray, starts: np.ndarray, only: slice = slice(None)) -> np.ndarray:
        """The least values of many sets, as (trees, depth, sets); 32 bits of each hash are permuted."""
        return _least_of(
            self.a.reshape(self.trees, self.deep)[:, only], self.b.reshape(self.trees, self.deep)[:, only], hashes, starts
        )

    def keys_of(self, minima: np.ndarray) -> np.ndarray:
        """One key for each tree and set, of all given values: (trees, sets)."""
        tree = np.arange(self.trees, dtype=np.uint64)[:, None]
        key = (tree + np.uint64(1)) * _BASE
        for k in range(minima.shape[1]):
            key = mixed(key * _BASE + mixed(minima[:, k].astype(np.uint64) + np.uint64(1)))
        return (key & ~np.uint64(TREE_MASK) | tree).view(np.int64)

    def bytes_of(self, minima: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """One byte of each minimum of a set, and of those that serve estimates only."""
        more = _least_of(self.more_a[:, 0], self.more_b[:, 0], hashes, starts)
        every = np.concatenate([minima.reshape(-1, len(starts)), more]).astype(np.uint64) + np.uint64(1)
        return [row.tobytes() for row in (mixed(every) >> np.uint64(56)).astype(np.uint8).T]
