"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, conversation_trie, exact_dedup, language, line_dedup, mixing, near_dedup, personal, quality, sharding, token_alignment, toxicity, warc
from millrace.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, sf_dir, "documents"), keep="largest")


ORACLES["op1_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def vocabulary(spark: SparkSession) -> byte_bpe.Vocabulary:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.load_vocabulary(spark, path, public_tokenizers.PATTERN)


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary(spark))


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decisions(read(spark, sf_dir, "documents"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(read(spark, sf_dir, "documents")).drop(mixing.TIE)


def _level(parents: list[str], level: str, weight: str, above: str) -> str:
    """SQL of one level of the budget tree, below the rows of ``above`` (parents, given)."""
    path = [*parents, level]
    on = " AND ".join(f"c.{p} = a.{p}" for p in parents) or "true"
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order = f"{by} ORDER BY capacity::DOUBLE / weight, {level}"
    names = ", ".join(path)
    return f"""
        SELECT {names}, CASE WHEN is_full THEN capacity
               ELSE (rest * upto) // open - (rest * (upto - weight)) // open END AS given
        FROM (SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by}) AS rest,
                     sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS open,
                     sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto
              FROM (SELECT *, capacity * (sum(weight) OVER ({by}) - before_w) <= (given - before_c) * weight AS is_full
                    FROM (SELECT *,
                                 coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_w,
                                 coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_c
                          FROM (SELECT {', '.join('c.' + p for p in path)}, sum(supply) * 3 AS capacity, any_value(a.given) AS given,
                                       {weight} AS weight
                                FROM leaves c JOIN ({above}) a ON {on} GROUP BY ALL))))
    """


_DOMAINS = _level([], "domain", "CASE c.domain WHEN 'encyclopedia' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END",
                  "SELECT sum(supply) * 90 // 100 AS given FROM leaves")
_LANGS = _level(["domain"], "lang", "CASE c.lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
                "SELECT * FROM domains")
_SOURCES = _level(["domain", "lang"], "source", "1", "SELECT * FROM langs")
ORACLES["op6_mixing"] = f"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, md5(coalesce(text, '')) AS text_md5,
               CASE coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 3
                    WHEN 0 THEN 'encyclopedia' WHEN 1 THEN 'forum' ELSE 'news' END AS domain,
               coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
        FROM documents),
    leaves AS MATERIALIZED (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM docs GROUP BY ALL HAVING supply > 0),
    domains AS MATERIALIZED ({_DOMAINS}), langs AS MATERIALIZED ({_LANGS}), budgets AS MATERIALIZED ({_SOURCES}),
    dealt AS (SELECT d.*, (b.given // l.supply)::BIGINT AS whole, (b.given % l.supply)::BIGINT AS part
              FROM docs d JOIN leaves l USING (domain, lang, source) JOIN budgets b USING (domain, lang, source)),
    ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                              ORDER BY md5('7:' || whole || ':' || coalesce(doc_id::VARCHAR, text_md5)), doc_id, text_md5, n_tokens
                              ROWS UNBOUNDED PRECEDING)::BIGINT - n_tokens AS start
                FROM dealt WHERE part > 0)
    SELECT doc_id, domain, lang, source, unnest(range(whole)) AS epoch, n_tokens, n_tokens AS n_taken
    FROM dealt WHERE whole > 0
    UNION ALL
    SELECT doc_id, domain, lang, source, whole, n_tokens, least(n_tokens, part - start) FROM ordered WHERE start < part
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


ORACLES["op9_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                      max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
    SELECT page_id, strlen(html) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), 'string_agg', '')
               AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           (CASE WHEN page_id <> first_id THEN first_id END)::DOUBLE AS refers_to
    FROM p
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(read(spark, sf_dir, "documents"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal(read(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(read(spark, sf_dir, "documents")).drop("text_hash")


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.decisions(read(spark, sf_dir, "documents"), [1.0] * 24)


# CRC-32 of text in SQL: the table of the reflected polynomial, then one step a byte.
_CRC_TABLE = """[list_reduce([k::BIGINT] || list_transform(range(8), lambda i: 0::BIGINT),
                    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for k in range(256)]"""


def _crc32(text: str, table: str) -> str:
    return f"""xor(list_reduce([4294967295::BIGINT] || [('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode({text})), '..')],
                    lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"""


def _bids(shards: int) -> str:
    bid = "-ln((('0x' || substr(md5(k::VARCHAR || ':' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"
    return f"list_min([{{'bid': {bid}, 'shard': k}} for k in range({shards})]).shard::INT"


ORACLES["op13_sharding"] = f"""
    WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS steps),
    rows AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 8 AS size,
                    {_crc32("coalesce(text, '')", "steps")} AS text_crc32 FROM documents, crc),
    dealt AS (SELECT *, {_bids(24)} AS shard, {_bids(25)} AS grown_shard,
                     md5(concat_ws(':', key, text_crc32, size)) AS spread FROM rows)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY spread, doc_id) - 1 AS slot
    FROM dealt
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.branched_trie(read(spark, sf_dir, "conversations"))


# Prefixes by aggregated texts of turn digests, subtrees by pairs of prefixes of one conversation.
ORACLES["op11_conversation_trie"] = f"""
    WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS steps),
    turns AS MATERIALIZED (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos, digest, words
        FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                     len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
              FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS MATERIALIZED (
        SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR", "steps")} % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turns), crc),
    rebuilt AS MATERIALIZED (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, digest, words
        FROM (SELECT c.conv_id, 0 AS own, t.pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= h
              UNION ALL
              SELECT c.conv_id, 1, t.pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h)),
    prefixes AS MATERIALIZED (
        SELECT conv_id, depth, words,
               md5(string_agg(digest, ',') OVER w) AS key,
               CASE WHEN depth > 1 THEN md5(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
                    ELSE 'root' END AS above,
               depth = max(depth) OVER (PARTITION BY conv_id) AS is_last
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
        UNION ALL
        SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
    nodes AS MATERIALIZED (
        SELECT key, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * any_value(words) AS saved,
               sha256(coalesce(string_agg(CASE WHEN is_last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM prefixes GROUP BY key),
    kids AS (SELECT above AS key, count(*) AS n_children FROM nodes GROUP BY above),
    pairs AS (SELECT DISTINCT u.key AS top, v.key FROM prefixes u JOIN prefixes v ON u.conv_id = v.conv_id AND u.depth <= v.depth),
    below AS (SELECT top AS key, sum(v.saved) AS saved_tokens, count(*) FILTER (v.key NOT IN (SELECT key FROM kids WHERE key IS NOT NULL)) AS n_leaves
              FROM pairs JOIN nodes v USING (key) GROUP BY top)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id::DOUBLE AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
           n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN nodes p ON p.key = n.above
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.decisions(read(spark, sf_dir, "documents"), token_alignment.Files.load(*paths))
