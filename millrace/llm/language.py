"""Language identification in two steps: the family, then the language within it.

One linear support vector machine for each family tells it from the others; within a family, one
for each pair of languages decides, and the language with most votes (then the largest sum of
margins) wins. Features are hashed character n-grams of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import documents, shipped

# Families of language codes, fixed values; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
DIMENSIONS = 4096
# Labelled rows fitted on: about so many in all, and of one language.
FIT_ROWS, FIT_ROWS_EACH = 3_000, 500
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(text: str) -> np.ndarray | None:
    """Unit vector of n-gram counts (one to three letters, word ends included); None without a letter."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not letters:
        return None
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(DIMENSIONS)
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        gram = gram[: len(points) - n + 1] * _BASE + points[n - 1 :] + np.uint64(n)
        slots = ((gram ^ (gram >> np.uint64(29))) * _BASE) >> np.uint64(52)
        counts += np.bincount(slots.astype(np.int64), minlength=DIMENSIONS)
    counts = np.log1p(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def fit_svm(x: np.ndarray, positive: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss, classes weighted alike), the last for the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1, -1).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    share = share.astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        slack = np.maximum(np.float32(0), 1 - y * (x @ w))
        slope = np.float32(penalty) * w - (share * y * slack) @ x
        speed = np.float32(0.9) * speed - np.float32(0.5) * slope
        w += speed
    return w


@dataclass
class Model:
    """Machines by family, and by pair of languages of one family."""

    languages: dict[str, list[str]]
    family: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str) -> tuple[str, float]:
        x = features(text) if self.languages else None
        if x is None:
            return UNKNOWN, 0.0
        margin = lambda w: float(x @ w[:-1] + w[-1])
        sure = lambda m: 1 / (1 + np.exp(-4 * m))
        margins = {f: margin(w) for f, w in self.family.items()}
        family = max(sorted(margins), key=margins.get) if margins else next(iter(self.languages))
        score = sure(margins[family]) if margins else 1.0
        names = self.languages[family]
        votes, sums, support = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            m = margin(self.pairs[a, b])
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            support[a], support[b] = min(support[a], sure(m)), min(support[b], sure(-m))
        best = max(names, key=lambda name: (votes[name], sums[name]))
        return best, float(score * support[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Learn from rows with a language that are not held out: a sample of about ``FIT_ROWS``, by
    a hash of the id, with at most about ``FIT_ROWS_EACH`` of a language."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{lang_col}`").alias("lang"),
    ).where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = min(FIT_ROWS_EACH, max(1, FIT_ROWS // max(1, len(counts))))
    chosen = F.lit(False)
    for lang, n in counts.items():
        within = F.pmod(F.xxhash64("doc_id"), F.lit(10_000_000)) < int(10_000_000 * min(1.0, each / n)) + 1
        chosen = chosen | ((F.col("lang") == lang) & within)

    def scan(batches):
        for batch in batches:
            vectors = [features(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary())],
                ["lang", "vector"],
            )

    sample = rows.where(chosen).select("lang", "text").mapInArrow(scan, "lang string, vector binary")
    found = sample.where("vector is not null").collect()
    if not found:
        return Model({}, {}, {})
    found.sort(key=lambda r: (r["lang"], r["vector"]))
    x = np.stack([np.frombuffer(r["vector"], np.float32) for r in found])
    lang = np.array([r["lang"] for r in found], object)
    family_of = {code: name for name, codes in families.items() for code in codes}
    languages: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        languages.setdefault(family_of.get(name, name), []).append(name)
    own = np.array([family_of.get(name, name) for name in lang], object)
    family = {f: fit_svm(x, own == f) for f in languages} if len(languages) > 1 else {}
    pairs = {}
    for names in languages.values():
        for a, b in combinations(names, 2):
            both = (lang == a) | (lang == b)
            pairs[a, b] = fit_svm(x[both], lang[both] == a)
    return Model(languages, family, pairs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learnt. Ids may
    be null (not held out) or repeated; an empty table gives no rows.
    """
    shared = shipped(docs.sparkSession, model)

    def scan(batches):
        own = shared()
        for batch in batches:
            found = [own.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` by a model of the rows of ``docs`` whose language is known."""
    return identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
