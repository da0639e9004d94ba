"""Tokens, quality, personal data, language and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, language, personal, quality, queries, toxicity


@pytest.fixture(scope="module")
def vocabulary(spark):
    return queries.vocabulary(spark)


@pytest.fixture(scope="module")
def reference(vocabulary):
    ranks = dict(zip(vocabulary.entries, vocabulary.ids))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.table
    assert sorted(table.key_at) == list(range(len(vocabulary.entries)))
    assert (table.candidates(vocabulary.entries) == np.arange(len(vocabulary.entries))).all()
    assert byte_bpe.PerfectHash([]).candidates([b"x"]).tolist() == [-1]


def test_bpe_equals_library(spark, vocabulary, reference, documents, edge, empty):
    rng = random.Random(1)
    odd = ["a" * 3000, " " * 500 + "x", "<|endoftext|>", "\x1c\x1d\x85​　 y", "'s'LL ǅ ٣٤"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xE000, 0x110000)])) for _ in range(80))
            for _ in range(100)]
    extra = spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(edge.select("doc_id", "text")).union(extra)
    want = Counter()
    for r in docs.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes()
        text = (r.text or "").encode()
        want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.digests(byte_bpe.encode(docs, vocabulary), vocabulary).collect())) == want
    assert byte_bpe.encode(empty, vocabulary).count() == 0


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, documents, edge, empty):
    rows = [(1, "a b c d e f a b c d e"), (2, "x x x x x x x"), (3, "u\nu\n \n\nu v"), (4, "é😀 \x0b\x0c|<#\r\n")]
    docs = documents.select("doc_id", "text").union(edge.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
    got = quality.quality(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    assert quality.quality(empty).count() == 0


def test_quality_is_native(documents):
    plan = quality.quality(documents)._jdf.queryExecution().toString()
    plan += quality.measures(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    rows = quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.good]
    bad = [r.kept for r in rows if not r.good]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    spans = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 16 <= len(digits) <= 19 and personal.luhn(digits)
                    or kind == 3 and 8 <= len(digits) <= 15):
                spans.append((kind, m.start(), m.end()))
    return spans


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    parts = ["1", "2", "45", ".", "@", "a", "-", " ", "+", "(", "é", "4111111111111111", "255", "256", "x.y"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert personal.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    assert personal.base_spans("a" * 200_000) == [] and personal.base_spans("1" * 200_000) == []
    assert personal.base_spans("1." * 20_000 + "@" * 1000)


def test_personal(documents, edge, empty):
    docs = documents.select("doc_id", "text").union(edge.select("doc_id", "text"))
    got = personal.personal(docs).collect()
    want = Counter()
    for r in docs.collect():
        spans = plain_spans(r.text)
        n = Counter(k for k, _, _ in spans)
        want[(r.doc_id, *(n[k] for k in range(4)), hashlib.sha256(personal.shown(spans).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert personal.personal(empty).count() == 0


def test_personal_leaves_plain_numbers_alone(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(digits + c for c in "0123456789" if personal.luhn(digits + c))
        wrong = digits + str((int(card[-1]) + 1) % 10)
        rows.append((k, f"some words here user{k}@mail{k % 9}.example.com and more, card {card} or +1 (212) 555-{k:04d} "
                        f"then {wrong} at home and 300.{k % 255}.1.999 end, call 12.5.2024"))
    rows.append((5000, "some words here joe at mail7.example.com and more, card 4111.1111.1111.1111 or nothing"))
    rows.append((5001, "plain words that are at home, in 2024, with 12 of 300 things and no more"))
    got = {r.doc_id: r for r in personal.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000].n_card == got[5000].n_email == 0
    assert got[5001].spans == ""


def test_personal_finds_rewritten_forms(spark):
    rng = random.Random(4)
    names = ["joe", "ann.lee", "user7", "kim", "desk2024", "max.muster"]
    hosts = ["mail7", "mail", "post12", "web"]
    rows = []
    for k in range(1200):
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(digits + c for c in "0123456789" if personal.luhn(digits + c))
        wrong = digits + str((int(card[-1]) + 1) % 10)
        rows.append((k, f"some words here {rng.choice(names)}@{rng.choice(hosts)}.example.com and more, card {card} or +1 (212) 555-{k:04d} "
                        f"then {wrong} at home and 300.{k % 255}.1.999 end, call 12.5.2024"))
    text = "some words here joe at mail7 dot example dot com and more, card 4111.1111.1111.1111 or nothing"
    rows.append((5000, text))
    rows.append((5001, "plain words that are at home, in 2024, with 12 of 300 things and no more"))
    got = {r.doc_id: r for r in personal.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = [x.split(":") for x in got[5000].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [
        ("email", "joe at mail7 dot example dot com"), ("card", "4111.1111.1111.1111")]
    assert got[5001].spans == ""


def test_language(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    small = language.language(edge)
    found = {r.doc_id: r.lang_pred for r in small.collect()}
    assert small.count() == 14 and found[4] == found[5] == found[6] == "und" and found[9] != "und"
    assert language.language(empty).count() == 0
    blind = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language(blind).collect()} == {"und"}


def test_language_ignores_all_but_text(edge):
    model = language.fit(edge)
    moved = edge.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    both = [sorted(map(str, language.identify(d, model).collect())) for d in (edge, moved)]
    assert both[0] == both[1]


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    toxic, clean = ([r.predicted for r in held if r.toxic == y] for y in (1, 0))
    assert len(rows) == 1000 and sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (7, None), (None, 1), (8, 5)], "doc_id long, toxic int")
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == 14 and {r.predicted for r in rows} <= {0, 1}
    assert toxicity.toxicity(edge, labels.limit(0)).count() == 14
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.without_toxic(edge, labels).columns == edge.columns


def test_toxic_rows_go_by_their_own_text(spark, monkeypatch):
    """A toxic row without an id goes, and a clean row that shares an id with a toxic one stays."""
    docs = spark.createDataFrame([(1, "bad"), (1, "good"), (None, "bad"), (None, None), (2, "good"), (2, "bad")], "doc_id long, text string")
    scored = docs.selectExpr("doc_id", "unhex(sha2(coalesce(text, ''), 256)) AS sha", "int(coalesce(text, '') = 'bad') AS predicted")
    monkeypatch.setattr(toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(toxicity, "scores", lambda *_, **__: scored)
    left = toxicity.without_toxic(docs, docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (1, "good"), (2, "good")]


def test_toxicity_counts_equal_plain_patterns():
    """Cheaper searches count what the patterns of the features say, also in long runs of letters."""
    capital = "A-ZÀ-ÖØ-Þ"
    plain = [
        f"[{capital}]", rf"\b[{capital}]{{3,}}\b", "[!?]", r"[^\w\s]", r"[^\W\d_]+[*@$!_.0-9-]+[^\W\d_]+", r"([^\W\d_])\1\1",
    ]
    rng = random.Random(4)
    letters = "aAbBÄß_É×÷ÞÐ0129²½.-*@$!_? \n\t'“—…😀ΩЖжé\x85\xa0x\ud800"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert toxicity.counts(text) == tuple(len(re.findall(p, text)) for p in plain), text
    start = time.perf_counter()
    assert toxicity.counts("ab" * 100_000 + " a.b") == (0, 0, 0, 1, 1, 0)
    assert time.perf_counter() - start < 2
