"""Encoding, decoding and counting against a plain dynamic program over all pieces."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import pieces as P
from wavemill.llm import sentencepiece_codec as codec
from wavemill.llm import token_counts


@pytest.fixture(scope="module")
def model(tok):
    return tok("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def held(model):
    return P.load(model), codec.Codec(model)


def plain(text, pieces):
    """Best score and tokens over the whole text at once; of equal ways the longest last piece."""
    if not text:
        return 0.0, 0
    s = "▁" + "".join("▁" if c == " " else "\0" if c == "▁" else c for c in text)
    best = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        top = None
        for start in range(max(0, end - pieces.longest), end):
            score = pieces.scores.get(s[start:end])
            if score is not None and (top is None or best[start][0] + score > top[0]):
                top = best[start][0] + score, best[start][1] + 1
        lost = best[-1][0] + pieces.unknown, best[-1][1] + len((" " + text)[end - 1].encode())
        best.append(lost if top is None or lost[0] > top[0] else top)
    return best[-1]


TEXTS = ["", "hello world", "  a  b\n c\t d  ", "▁ sign", "naïve café ☃ 日本語 🎉", "\n\n", " ", "a" * 3000, "the theory of  everything\r\nends", "x\0y", "▁▁"]


@pytest.mark.parametrize("text", TEXTS)
def test_best_and_exact(held, text):
    pieces, c = held
    ids = c.encode(text)
    score, n = plain(text, pieces)
    trie = token_counts.CountTrie(pieces)
    assert c.decode(ids) == text and len(ids) // 4 == n
    assert sum(trie.add(p) for p in P.split(text, pieces)) == n
    known = [pieces.by_id[i] for i in memoryview(ids).cast("I")]
    assert abs(sum(pieces.scores[p] for p in known if p in pieces.scores) - score) < 1e-6 or "<0x" in "".join(known)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(held, text):
    pieces, c = held
    ids = c.encode(text)
    assert c.decode(ids) == text and len(ids) // 4 == plain(text, pieces)[1]
    trie = token_counts.CountTrie(pieces)
    assert sum(trie.add(p) for p in P.split(text, pieces)) == len(ids) // 4


def test_shared_beginnings_are_scored_once(held):
    trie = token_counts.CountTrie(held[0])
    trie.add(" international")
    before = len(trie.best)
    trie.add(" internationally")
    assert len(trie.best) == before + 2


def test_frames_agree(spark, docs, corpus, nothing, model, held):
    from sentencepiece import SentencePieceProcessor

    got = {r.doc_id: r for r in codec.round_trip(docs, model).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model).collect()}
    assert len(got) == len(corpus) and all(r.round_trip for r in got.values())
    for i, text in corpus:
        assert got[i].n_tokens == counts[i] == plain(text or "", held[0])[1]
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(docs, model), model).collect()}
    assert back == {i: t or "" for i, t in corpus}
    assert SentencePieceProcessor(model_file=model).decode([int(x) for x in codec.encode(docs, model).filter("size(ids) > 0").first().ids])
    assert codec.round_trip(nothing, model).collect() == token_counts.token_counts(nothing, model).collect() == []
    empty = spark.createDataFrame([(1, None), (1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in codec.decode(empty, model).collect()] == ["", ""]
