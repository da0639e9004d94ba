"""Mixing, WARC archives, the registered SQL and the whole pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from millrace.llm import mixing, near_dedup, queries, toxicity, warc  # noqa: E402
from millrace.llm.common import SHUFFLES_GO, Stages  # noqa: E402
from millrace_checks.compare import differences, duck  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    sql = queries.ORACLES[name]
    # Integers with nulls.
    nullable = {"op9_warc": ["refers_to"], "op11_conversation_trie": ["parent_conv_id"]}.get(name, [])
    df = df.withColumns({c: F.col(c).cast("double") for c in nullable})
    assert differences(df, duck(sf_dir), sql) is None


def test_budget_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "domain string, lang string, supply long")
    plan = mixing.Mixture(share=33, epochs=1)  # 993 tokens
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, ("domain", "lang"), plan).collect()}
    assert got["a", "x"] == 10 and got["a", "x"] + got["a", "y"] in (496, 497) and sum(got.values()) == 993
    short = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 1000)], leaves.schema)
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(short, ("domain", "lang"), mixing.Mixture(share=50, epochs=1)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 485}


def test_prefixes_of_epochs(spark):
    rows = [(k, "a" if k < 90 else "b", 7 + k % 5) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    plan = mixing.Mixture(weights={"source": {"b": 5}}, share=100, epochs=3)
    got = mixing.select(docs, ("source",), plan).collect()
    supply = {s: sum(n for _, x, n in rows if x == s) for s in "ab"}
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.n_taken
    assert taken["b"] == 3 * supply["b"] and taken["a"] == sum(supply.values()) - taken["b"]
    assert Counter(r.epoch for r in got if r.source == "b") == {0: 10, 1: 10, 2: 10}
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert sum(r.n_taken < r.n_tokens for r in got) <= 2
    again = mixing.select(docs.repartition(7), ("source",), plan).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_of_repeated_and_missing_ids_is_the_same_in_any_partitioning(spark):
    rows = [(k % 3 if k % 2 else None, "s0", "en", f"{k} " + "w " * (k % 11)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    plan = mixing.Mixture(share=35, epochs=1)
    results = [Counter(map(tuple, mixing.mixture_rows(docs.repartition(n), plan).collect())) for n in (1, 3, 7)]
    assert results[0] == results[1] == results[2] and sum(r[6] < r[5] for r in results[0]) <= 1
    supply = sum(len(t.split()) for *_, t in rows)
    assert sum(r[6] * n for r, n in results[0].items()) == supply * 35 // 100
    # Brute force: rows in the stated order until the budget is used up.
    def order(r):
        tie = hashlib.md5(r[3].encode()).hexdigest()
        return hashlib.md5(f"7:0:{tie if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], tie

    left, expected = supply * 35 // 100, Counter()
    for r in sorted(rows, key=order):
        n = min(left, len(r[3].split()))
        if left:
            expected[r[0], n, r[3]] += 1
        left -= n
    assert Counter({(r[0], r[6], r[7]): n for r, n in results[0].items()}) == Counter(
        {(i, n, hashlib.md5(t.encode()).hexdigest()): c for (i, n, t), c in expected.items()})
    # Rows go by their own text, and whole.
    assert Counter((r.doc_id, r.text) for r in mixing.mix(docs, plan).collect()) == Counter((i, t) for i, _, t in expected.elements())


def test_rows_without_an_id_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, "s0", "en", f"text {k}") for k in range(500)], "doc_id long, source string, lang string, text string")
    key = F.md5(F.concat(F.lit("7:0:"), F.col(mixing.TIE)))
    buckets = mixing.rows_of(docs).groupBy(F.substring(key, 1, mixing.BUCKET_DIGITS)).count()
    assert buckets.count() > 400
    taken = mixing.mixture_rows(docs, mixing.Mixture(share=50, epochs=1)).collect()
    assert sum(r.n_taken for r in taken) == 500


def test_mixing_edges(edge, empty):
    rows = mixing.mixture_rows(edge).collect()
    assert rows and all(0 <= r.n_taken <= r.n_tokens for r in rows)
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count()
    assert mixing.mixture_rows(empty).count() == mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge, mixing.Mixture(weights={"lang": {"en": 0}}))


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nx", "WARC/1.1\r\n\r\n"),
         (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (7, "u", "line\r\n\r\nline")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit("own"))


def test_archive_round_trip(spark):
    got = {r.page_id: tuple(r)[1:] for r in warc.archived(pages(spark)).collect()}
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = {1: 2, 4: 5}.get(i)
        assert got[i] == (len(data), sha(data), "revisit" if first else "response", first)
    assert warc.archived(pages(spark).limit(0)).count() == 0
    apart = {r.page_id: r.record_type for r in warc.archived(pages(spark), least_bytes=10**6).collect()}
    assert set(apart.values()) == {"response"}
    odd = pages(spark, [(None, "u", "q"), (3, "u", "q"), (3, "u", "q")])
    assert Counter(map(tuple, warc.archived(odd).select("page_id", "record_type").collect())) == {
        (None, "revisit"): 1, (3, "response"): 2}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Whole records of one plain file."""
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_warc(pages(spark).coalesce(1), path, packed=False)
    return b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(archive, packed):
    whole = [archive[o : o + n] for o, n, headers, _, _ in warc.salvage(archive) if headers]
    assert len(whole) == len(PAGES) and b"".join(whole) == archive
    whole.sort(key=len)
    whole.insert(2, whole.pop())  # damage falls into its long block
    units = [gzip.compress(x, mtime=0) for x in whole] if packed else whole
    hurt = bytearray(units[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = units[0] + b"noise" + units[1] + bytes(hurt) + units[3] + units[4][: len(units[4]) // 2]
    found = list(warc.salvage(data))
    assert sum(n for _, n, *_ in found) == len(data) and found[0][0] == 0
    blocks = [block for _, _, headers, block, _ in found if headers]
    assert blocks == [next(warc.salvage(x))[3] for x in (whole[0], whole[1], whole[3])]
    assert [g is None for *_, g in found] == [True, False, True, False, True, False]
    assert list(warc.salvage(b"")) == []


def test_salvage_within_a_member(archive):
    whole = [archive[o : o + n] for o, n, *_ in warc.salvage(archive)]
    member = gzip.compress(archive)
    records = list(warc.salvage(member))
    assert len(records) == len(whole) and sum(n for _, n, *_ in records) == len(member)
    cut = list(warc.salvage(member[:-12] + gzip.compress(whole[0])))
    kept = [headers["warc-record-id"] for _, _, headers, _, _ in cut if headers]
    assert len(whole) - 1 <= len(kept) - 1 <= len(whole) and kept[-1] == records[0][2]["warc-record-id"]
    assert [r for *_, r in cut if r] and sum(n for _, n, *_ in cut) == len(member) - 12 + len(gzip.compress(whole[0]))


def spoiled(path):
    """One byte flipped and 4 kB zeroed at different places of the largest file below ``path``."""
    file = max(Path(path).glob("part-*"), key=lambda p: p.stat().st_size)
    data = bytearray(file.read_bytes())
    data[len(data) * 3 // 10] ^= 0x10
    data[len(data) * 6 // 10 : len(data) * 6 // 10 + 4096] = bytes(4096)
    file.write_bytes(data)
    for check in file.parent.glob(".part-*.crc"):
        check.unlink()


def many_pages(spark, n):
    rows = [(k, "u", " ".join(hashlib.md5(b"%d %d" % (k, x)).hexdigest() for x in range(60))) for k in range(n)]
    return pages(spark, rows).coalesce(1)


def test_damage_in_a_written_archive_costs_few_records(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    warc.write_warc(many_pages(spark, 2000), path)
    whole, gaps = warc.read_warc(spark, path)
    assert whole.count() == 2000 and gaps.count() == 0
    spoiled(path)
    found, gaps = warc.read_warc(spark, path)
    assert 2000 - 3 * 40 <= found.count() < 2000 and found.distinct().count() == found.count()
    assert 1 <= gaps.count() <= 4 and gaps.where("length > 0").count() == gaps.count()
    write = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda pages, path, *a: (write(pages, path, *a), spoiled(path)))
    rows = warc.archived(many_pages(spark, 2000)).collect()
    lost = [r for r in rows if r.record_type == "gap"]
    assert lost and all(r.page_id is None and r.payload_bytes > 0 for r in lost)
    assert len({r.page_id for r in rows} - {None}) >= 2000 - 3 * 40


def test_archive_of_a_record_beyond_16_mb(spark):
    html = "x" * (17 << 20)
    rows = warc.archived(pages(spark, [(1, "u", html), (2, "u", "y")])).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in rows) == [
        (1, len(html), "response"), (2, 1, "response")]


def test_reader_mixes_plain_and_packed_files(spark, archive, tmp_path):
    (tmp_path / "a.warc").write_bytes(archive)
    whole = [archive[o : o + n] for o, n, *_ in warc.salvage(archive)]
    (tmp_path / "b.warc.gz").write_bytes(b"\0" * 7 + b"".join(map(gzip.compress, whole)))
    (tmp_path / "c.warc").write_bytes(b"")
    records, gaps = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 2 * len(PAGES)
    assert [(r.offset, r.length) for r in gaps.collect()] == [(0, 7)]


def test_pipeline_stages(spark, sf_dir, documents, labels):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns
        docs = spark.createDataFrame(out.collect(), documents.schema)
        kept.append(docs.collect())
    bad = {r.doc_id for r in toxicity.toxicity(documents, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in documents.collect()}
    assert {r.doc_id for r in kept[0]} == set(rows) - bad
    first = {}
    for r in sorted(kept[0], key=lambda r: r.doc_id):
        first.setdefault(r.text or "", r.doc_id)
    assert sorted(r.doc_id for r in kept[1]) == sorted(first.values())
    near = near_dedup.decisions(spark.createDataFrame(kept[1], documents.schema)).collect()
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in near if r.kept}
    mixed = mixing.mixture_rows(spark.createDataFrame(kept[2], documents.schema)).collect()
    assert Counter(r.doc_id for r in kept[3]) == Counter(r.doc_id for r in mixed)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, final)) == Counter(map(tuple, encoded))
    assert all(r.decoded_sha256 == hashlib.sha256((rows[r.doc_id].text or "").encode()).hexdigest() for r in final)


def test_pipeline_of_an_empty_table(spark, sf_dir, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_a_written_stage_leaves_no_shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = held.getAllFiles()
        names = (files.apply(k).getName() for k in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(SHUFFLES_GO, "false")
    stages = Stages(spark, "test")
    rows = stages.write(spark.range(10_000).repartition(7).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    until = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(SHUFFLES_GO, "false") == setting and rows.count() == 100
    stages.drop("counts")
