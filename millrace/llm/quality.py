"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns (at most 3 to the power of the number of rules, whatever the input) estimates each
rule's accuracy and the share of good documents; a document's posterior probability decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Stages, documents

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
ROUNDS = 50
KEEP_AT = 0.5
# A rule accuses at most this share of the good documents: it keeps a class of frequent faults
# from passing as good.
MOST_FALSE = 0.01


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once although ``body`` uses it often."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def again(e: Column, k: Column) -> Column:
            before = (k > 0) & e["h"].eqNullSafe(F.get(s, k - 1)["h"])
            return before | e["h"].eqNullSafe(F.get(s, k + 1)["h"])

        return F.array_sort(F.transform(F.filter(s, again), lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(pairs, repeated), total)


def _repeat_words(words: Column) -> Column:
    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )
        return let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))
        )

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(words, count)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text; a null text is empty."""
    rows = documents(docs, id_col, text_col)
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE))
    counts = rows.withColumns({"words": words, "lines": lines})
    return counts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("long").alias("n_calls"),
    )


@dataclass(frozen=True)
class Rule:
    """``value`` votes bad outside [low, high], good inside ``good`` if there is one, or abstains."""

    name: str
    value: str
    low: float
    high: float
    good: tuple[float, float] | None = None

    def vote(self) -> Column:
        value = F.expr(self.value)
        vote = F.when((value < self.low) | (value > self.high), -1)
        return (vote.when(value.between(*self.good), 1) if self.good else vote).otherwise(0)


MANY = 1e18
RULES = (
    Rule("length", "n_words", MIN_WORDS, MANY, (50, MANY)),
    Rule("word length", "word_chars / greatest(n_words, 1)", 2.5, 12, (3.5, 9)),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0, 0.1),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", 0, 0.3),
    Rule("repeated words", "n_repeat_words / greatest(n_words, 1)", 0, MAX_REPEATED / 100),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", 0, 0.4),
    Rule("calls", "n_calls / greatest(n_words, 1)", 0, 0.3),
    Rule("variety", "n_distinct_words / greatest(n_words, 1)", 0.05, 1),
)


VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class Accuracy:
    """How often a rule casts each vote on good and on bad documents."""

    good: dict[int, float]
    bad: dict[int, float]

    def evidence(self, vote: int) -> float:
        """Log odds of good; an abstention says nothing, as most rules look for one fault each."""
        return math.log(self.good[vote] / self.bad[vote]) if vote else 0.0


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[Accuracy]]:
    """The share of good documents and each rule's accuracy, by EM over the pattern counts.

    The first guess is that documents with a bad vote are bad with probability 0.9 and others with
    0.1, which fixes which of the two classes is the good one.
    """
    n_rules, total = len(next(iter(patterns), ())), sum(patterns.values())
    good = {votes: 0.1 if -1 in votes else 0.9 for votes in patterns}
    # The share of good documents stays that of the first guess: most documents break no rule and
    # so give no evidence, and estimating the share anew from them would let it drift to nothing.
    clear = sum(n for votes, n in patterns.items() if -1 not in votes)
    prior = min(0.95, max(0.6, (clear + 1) / (total + 2)))
    rules = [Accuracy(*[dict.fromkeys(VOTES, 1 / 3)] * 2)] * n_rules
    for _ in range(rounds if total else 0):
        rules = []
        for j in range(n_rules):
            cast = {True: dict.fromkeys(VOTES, 1.0), False: dict.fromkeys(VOTES, 1.0)}
            for votes, n in patterns.items():
                cast[True][votes[j]] += n * good[votes]
                cast[False][votes[j]] += n * (1 - good[votes])
            shares = [{v: c / sum(k.values()) for v, c in k.items()} for k in (cast[True], cast[False])]
            shares[0][-1] = min(shares[0][-1], MOST_FALSE)
            rules.append(Accuracy(*shares))
        for votes in patterns:
            odds = math.log(prior / (1 - prior)) + sum(r.evidence(v) for r, v in zip(rules, votes))
            good[votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return prior, rules


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the counts, base_failed, quality (posterior) and kept.

    An empty or null text has no words and fails the base. Ids play no part: null and repeated ones
    stay as they are. The rules' accuracies come from all rows; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "quality")
    votes = [f"vote_{k}" for k in range(len(RULES))]
    rows = stages.write(
        measures(docs, id_col, text_col).withColumns({v: r.vote() for v, r in zip(votes, RULES)}), "measures"
    )
    counted = rows.groupBy(*votes).count().collect()
    prior, rules = estimate({tuple(r[v] for v in votes): r["count"] for r in counted})
    odds = F.lit(math.log(prior / (1 - prior)))
    for vote, rule in zip(votes, rules):
        evidence = [F.lit(rule.evidence(v)) for v in VOTES]
        odds = odds + F.get(F.array(*evidence), F.col(vote) + 1)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("quality"),
    ).select("*", (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"))
