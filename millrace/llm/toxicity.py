"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt too: words and word beginnings that labelled toxic documents have far more
often. The fit is crossed over FOLDS parts of the labelled rows: a row's features come from the lexicon of the
other parts, and the scores that are calibrated from trees of the other parts, so that both learn from
rows like those to be scored later, which neither lexicon nor trees have seen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Stages, documents, shipped

# At most so many labelled rows are fitted on, those with the least hashed ids.
FIT_ROWS = 20_000
FOLDS = 3
LEXICON_TERMS = 400
# Toxic documents that a term of the lexicon is in.
LEAST_SEEN = 4
THRESHOLD = 0.7
# Second-person words of the languages at hand, fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine ihr euch sie tu te toi ton ta vous votre "
    "usted ustedes tú ti tus su vosotros os".split()
)
NEAR = 5
WORD = re.compile(r"[^\W_]+(?:[*@$!0-9'_.-]+[^\W_]+)*")
# From the first letter of a run and without a way back: a long run costs its length, not the square of it.
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$!_.0-9-]++[^\W\d_]+")
JOINED = re.compile(r"[*@$!_.0-9-]++(?=[^\W\d_])")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
# Begins with a set of characters, which a search skips to.
SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ](?<!\w.)[A-ZÀ-ÖØ-Þ]{2,}\b")
WIDE_MARKS = re.compile(r"[^\w\s\x00-\xff]")
LATIN = bytes(range(256)).decode("latin-1")
CAPITALS = re.sub(r"[^A-ZÀ-ÖØ-Þ]", "", LATIN).encode("latin-1")
MARKS = re.sub(r"[\w\s]", "", LATIN).encode("latin-1")


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def terms(word: str) -> list[str]:
    """The word and its beginnings of three to seven letters, the latter marked with a dash."""
    return [word, *(word[:k] + "-" for k in range(3, min(8, len(word))))]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """Capitals, shouted words, exclamation and question marks, all marks, obfuscated words and stretched
    letters. Most texts have no candidate of the costly patterns, which cheaper searches tell."""
    latin = text.encode("latin-1", "replace")
    capitals = len(latin) - len(latin.translate(None, CAPITALS))
    marks = len(latin) - len(latin.translate(None, MARKS))
    asked = text.count("?")
    if wide := latin.count(b"?") - asked:  # each stands for a character beyond Latin-1
        marks += len(WIDE_MARKS.findall(text)) - wide
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = points[1:] == points[:-1]
    return (
        capitals,
        len(SHOUTED.findall(text)) if capitals > 2 else 0,
        asked + text.count("!"),
        marks,
        len(OBFUSCATED.findall(text)) if JOINED.search(text) else 0,
        len(STRETCHED.findall(text)) if (same[1:] & same[:-1]).any() else 0,
    )


class Found(dict):
    """For each word (its strongest term or None, that term's weight, whether it is second person), None where it
    is neither; forgets all when it has grown to ``bound`` words."""

    bound = 100_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[str | None, float, bool] | None:
        if len(self) >= self.bound:
            self.clear()
        known = [t for t in terms(word) if t in self.lexicon.counts]
        term, person = max(known, key=self.lexicon.weight, default=None), word in SECOND_PERSON
        weight = 0.0 if term is None else max(0.0, self.lexicon.weight(term))
        self[word] = found = None if term is None and not person else (term, weight, person)
        return found


@dataclass
class Lexicon:
    """Counts of labelled documents with each term, by label, and of all labelled documents."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int

    def weight(self, term: str) -> float:
        a, b = self.counts[term]
        return math.log((a + 0.5) / (self.toxic + 1) * (self.clean + 1) / (b + 0.5))

    def features(self, text: str, found: Found) -> list[float]:
        """Densities and rates of a whole text."""
        words = words_of(text)
        places, people, hits, weights = [], [], [], []
        for k, known in enumerate(map(found.__getitem__, words)):
            if known is not None:
                term, weight, person = known
                if term is not None:
                    places.append(k)
                    hits.append(term)
                    weights.append(weight)
                if person:
                    people.append(k)
        capitals, shouted, excited, marks, obfuscated, stretched = counts(text)
        n, length = max(1, len(words)), max(1, len(text))
        close, at = 0, 0
        for k in places if people else ():
            while at < len(people) and people[at] < k - NEAR:
                at += 1
            close += at < len(people) and people[at] <= k + NEAR
        return [
            len(hits) / n,
            math.log1p(len(hits)),
            sum(weights),
            max(weights, default=0.0),
            sum(weights) / n,
            float(len(set(hits))),
            len(people) / n,
            close / max(1, len(hits)),
            capitals / length,
            shouted / n,
            excited / length,
            marks / length,
            obfuscated / n,
            stretched / n,
            math.log1p(len(words)),
        ]


@dataclass
class Model:
    """``trees`` and ``calibration`` are None where only one class was seen: ``rate`` is the score."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def _features(rows: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(doc_id, toxic, fold, sha, values) of rows (doc_id, text, toxic, fold, sha); ``fold`` chooses the lexicon, the
    last where it is null. ``toxic`` is null where unknown."""
    shared = shipped(rows.sparkSession, lexicons)

    def scan(batches):
        own = shared()
        found = [Found(lexicon) for lexicon in own]
        for batch in batches:
            values = [
                own[-1 if fold is None else fold].features(text, found[-1 if fold is None else fold])
                for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "toxic", "fold", "sha")), pa.array(values, pa.list_(pa.float64()))],
                ["doc_id", "toxic", "fold", "sha", "values"],
            )

    columns = rows.select("doc_id", "text", "toxic", F.col("fold").cast("int").alias("fold"), "sha")
    return columns.mapInArrow(scan, "doc_id long, toxic int, fold int, sha binary, values array<double>")


def _terms(batches):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("text", "toxic", "fold")]
        for text, label, fold in zip(*columns):
            own = list({t for w in set(words_of(text)) for t in terms(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), *(pa.array([x] * len(own), pa.int32()) for x in (label, fold))], ["term", "toxic", "fold"]
            )


def fit(docs: DataFrame, labels: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows that are not held out, at most ``FIT_ROWS`` of them."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
    )
    # A fold that doesn't depend on the hash that chose the rows.
    known = known.withColumn("fold", F.pmod(F.xxhash64(-F.col("doc_id")), F.lit(FOLDS)).cast("int"))
    # Bounded by FIT_ROWS rows of three numbers.
    rows = stages.write(documents(docs, id_col, text_col).join(F.broadcast(known), "doc_id"), "labelled")
    by_fold = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (_, y), n in by_fold.items() if y == label) for label in (1, 0))
    rate = toxic / max(1, toxic + clean)
    # Each part needs a toxic and a clean row elsewhere.
    crossed = all(sum(n for (k, y), n in by_fold.items() if k != fold and y == label) >= 2 for fold in range(FOLDS) for label in (0, 1))
    if not crossed:
        return Model(Lexicon({}, toxic, clean), None, None, rate)
    counted = rows.select("text", "toxic", "fold").mapInArrow(_terms, "term string, toxic int, fold int")
    parts = [F.sum(F.when(F.col("fold") == k, x).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c, x in (("a", F.col("toxic")), ("b", 1 - F.col("toxic")))]
    counted = stages.write(counted.groupBy("term").agg(*parts).where(sum(F.col(f"a{k}") for k in range(FOLDS)) >= LEAST_SEEN), "terms")
    lexicons = [_lexicon(counted, by_fold, [j for j in range(FOLDS) if j != k]) for k in range(FOLDS + 1)]
    values = stages.write(
        _features(rows.withColumn("sha", F.lit(None).cast("binary")), lexicons).select(
            "doc_id", "fold", array_to_vector("values").alias("features"), F.col("toxic").cast("double").alias("label")
        ), "fit",
    )
    booster = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=1)
    scored = None
    for k in range(FOLDS):
        own = booster.fit(values.where(F.col("fold") != k)).transform(values.where(F.col("fold") == k))
        own = own.select(vector_to_array("probability")[1].alias("raw"), "label")
        scored = own if scored is None else scored.unionByName(own)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(stages.write(scored, "crossed"))
    return Model(lexicons[-1], booster.fit(values), calibration, rate)


def _lexicon(counted: DataFrame, by_fold: dict[tuple[int, int], int], folds: list[int]) -> Lexicon:
    """The strongest terms of some of the folds."""
    toxic, clean = (sum(by_fold.get((k, y), 0) for k in folds) for y in (1, 0))
    a, b = (sum(F.col(f"{c}{k}") for k in folds) for c in "ab")
    weight = F.log((F.col("a") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("b") + 0.5))
    chosen = (
        counted.select("term", a.alias("a"), b.alias("b")).where(F.col("a") >= LEAST_SEEN).withColumn("w", weight).where("w > 1.5")
        .orderBy((F.col("a") * F.col("w")).desc(), "term").limit(LEXICON_TERMS).collect()
    )
    return Lexicon({r["term"]: (r["a"], r["b"]) for r in chosen}, toxic, clean)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, and with ``hashed`` the text's SHA-256; see ``toxicity``."""
    rows = documents(docs, id_col, text_col)
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)) if hashed else F.lit(None).cast("binary"))
    if model.trees is None:
        scored = rows.select("doc_id", "sha", F.lit(model.rate).alias("score"))
    else:
        unknown = F.lit(None).cast("int")
        values = _features(rows.withColumns({"toxic": unknown, "fold": unknown}), [model.lexicon])
        raw = model.trees.transform(values.select("doc_id", "sha", array_to_vector("values").alias("features")))
        raw = raw.select("doc_id", "sha", vector_to_array("probability")[1].alias("raw"))
        scored = model.calibration.transform(raw).select(
            "doc_id", "sha", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score")
        )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *(["sha"] if hashed else []),
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of the labelled ones.

    Null texts are empty; empty texts have a score too. Rows without an id are scored and not held
    out. Labels other than 0 and 1 are ignored; of a document's several labels the largest counts.
    Where the folds have too few documents of a class to learn from the others, each score is the share
    of toxic labels. An empty table gives no rows.
    """
    return scores(docs, fit(docs, labels, Stages(docs.sparkSession, "toxicity"), id_col, text_col), id_col, text_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, with all their columns.

    A row goes by its own text: equal texts have equal scores, so it is found by id and SHA-256 of the
    text. Toxic rows without an id go too, and of rows that share an id the clean ones stay.
    """
    stages = Stages(docs.sparkSession, "toxicity")
    model = fit(docs, labels, stages, id_col, text_col)
    gone = scores(docs, model, id_col, text_col, hashed=True).where("predicted = 1")
    gone = stages.write(gone.select(F.col("doc_id").alias("__gone"), F.col("sha").alias("__sha")).distinct(), "gone")
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__gone")) & (sha == F.col("__sha"))
    return docs.join(gone, same, "left_anti")
