"""Two tokenizers aligned, against loops over the whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from millrace.llm import token_alignment as ta
from millrace.llm.queries import QUERIES

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def files():
    return ta.Files.load(*PATHS)


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte_of = ta.byte_alphabet()
    # The alphabet agrees with the library's own decoder.
    assert all(decoders.ByteLevel().decode([c]).encode() == bytes([v]) for c, v in byte_of.items() if v < 128)

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return 0, 0, []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        own_a = [bytes(byte_of[c] for c in a.id_to_token(k)) for k in ids_a]
        own_b = [piece(k) for k in ids_b]
        want = (" " + text).encode()
        if b"".join(own_a) != want or b"".join(own_b) != want:
            return 0, 0, []
        ends = [set(), set()]
        for side, own in zip(ends, (own_a, own_b)):
            at = 0
            for x in own:
                at += len(x)
                side.add(at)
        both, out = ends[0] & ends[1], []
        left, at_a, at_b = [], 0, 0
        right, queue = [], list(zip(ids_b, own_b))
        for k, x in zip(ids_a, own_a):
            left.append(k)
            at_a += len(x)
            if at_a in both:
                while at_b < at_a:
                    j, y = queue.pop(0)
                    right.append(j)
                    at_b += len(y)
                out.append((left, right))
                left, right = [], []
        return len(ids_a), len(ids_b), out

    def whole(rows):
        found = [(k, *groups(t)) for k, t in rows]
        counts = Counter((g[0][-1], g[1][-1]) for *_, gs in found for g in gs)
        highest = Counter()
        for (_, j), n in counts.items():
            highest[j] = max(highest[j], n)
        result = []
        for k, n_a, n_b, gs in found:
            pairs = [(g[0][-1], g[1][-1]) for g in gs]
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
            result.append((
                k, n_a, n_b, len(gs), len(gs), sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                hashlib.sha256(text.encode()).hexdigest() if gs else "",
            ))
        return result, counts

    return whole


def found(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_edges(edge, empty, files, brute, monkeypatch):
    odd = ["<|endoftext|> and <s> </s> <0x41>", "▁ under", "  two  spaces \n\t", "ﬁ ligature é é", "\x00nul", "한국어 \U0001f600", "x", " "]
    more = edge.sparkSession.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(more)
    want, counts = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(ta.decisions(docs, files)) == Counter(want)
    assert {((r.a, r.b), r.total) for r in ta.links(docs, files).collect()} == set(counts.items())
    assert found(ta.decisions(edge, files)) == Counter(brute([(r.doc_id, r.text) for r in edge.collect()])[0])
    assert ta.decisions(empty, files).count() == 0 and ta.links(empty, files).count() == 0
    shown = {r.doc_id: r for r in ta.groups(docs, files).collect()}
    assert shown[106].groups.count("|") == 1 and (shown[4].groups, shown[4].n_a) == ("", 0)


def test_pieces_and_chunks_change_nothing(edge, files, monkeypatch):
    """Pieces of few characters and many chunks give the same groups and totals."""
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    docs = edge.sparkSession.createDataFrame([(k, t[:20_000]) for k, t in rows], "doc_id long, text string").coalesce(1)
    want = found(ta.decisions(docs, files))
    for name, value in (("PIECE", 5), ("SLICE", 100), ("CHUNK", 300), ("REMEMBERED", 40), ("LONGEST", 6)):
        monkeypatch.setattr(ta, name, value)
    assert found(ta.decisions(docs, files)) == want


def test_query(spark, sf_dir, documents, brute):
    want, _ = brute([(r.doc_id, r.text) for r in documents.collect()])
    got = found(QUERIES["op12_token_alignment"](spark, sf_dir))
    assert got == Counter(want) and sum(r[3] > 0 for r in want) > len(want) / 2
