"""Packing: whole ids, gapless sequences, few of them; each step by the rule of squares."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from wavemill.llm import packing
from wavemill.llm.common import Scratch


def test_pieces_and_places(docs, corpus, tok):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok("word_bpe_49k.json"))
    rows = packing.best_fit(docs, tok("word_bpe_49k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in corpus:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, k * 2048, len(ids[k * 2048 :][:2048]), zlib.crc32(ids[k * 2048 :][:2048].tobytes())) for k in range(-(-len(ids) // 2048))]
    assert not by_doc
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1


def squares(gaps, capacity):
    n = np.bincount([g for g in gaps if g], minlength=capacity + 1)
    return int((n * n).sum())


@pytest.mark.parametrize("seed", range(4))
def test_rule_of_squares(seed):
    """Every step makes the sum as small as any option would, whole sums computed for each option."""
    capacity = 40
    sizes = np.random.default_rng(seed).integers(1, capacity + 1, 80)
    order = np.argsort(-sizes, kind="stable")
    large, last = int((sizes > capacity // 8).sum()), int(len(sizes) * 0.95)
    if large < last:
        order[large:last] = np.random.default_rng(len(sizes)).permutation(order[large:last])
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    gaps = {}
    for i in order:
        s, options = int(sizes[i]), [squares([*gaps.values(), capacity - sizes[i]], capacity)]
        options += [squares([v - s * (k == b) for k, v in gaps.items()], capacity) for b, g in gaps.items() if g >= s]
        assert offsets[i] == capacity - gaps.get(bins[i], capacity) and gaps.get(bins[i], capacity) >= s
        gaps[bins[i]] = gaps.get(bins[i], capacity) - s
        assert squares(gaps.values(), capacity) == min(options)


@pytest.mark.parametrize("seed", range(4))
def test_closing_up_keeps_sequences_whole(seed):
    capacity = 40
    sizes = np.random.default_rng(seed).choice([3, 13, 14, 26, 40], 90)
    before, _ = packed = packing.sum_of_squares(sizes, capacity)
    bins, offsets = packing.closed_up(sizes, *packed, capacity)
    assert len(set(bins)) <= len(set(before)) and set(bins) == set(range(len(set(bins))))
    for b in set(bins):
        places = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert [o for o, _ in places] == [0, *np.cumsum([s for _, s in places])[:-1]] and sum(s for _, s in places) <= capacity
    fills = sorted(np.bincount(bins, weights=sizes))
    assert len(fills) < 2 or fills[0] + fills[1] > capacity


def test_shards_are_packed_again(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1500, 900)
    df = spark.createDataFrame([(int(k), int(s)) for k, s in enumerate(sizes)], "k long, length long")
    out = packing.pack(df, Scratch(spark), 2048, shard=60).toPandas()
    assert sorted(out["k"]) == list(range(900)) and out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= -(-int(sizes.sum()) // 2048) * 1.02 + 2


def test_what_cannot_be_filled_stays_in_bounded_shards(spark):
    """Pieces of over half a sequence never meet, so no later level gains anything."""
    sizes = np.random.default_rng(4).integers(1100, 1900, 1200)
    df = spark.createDataFrame([(int(k), int(s)) for k, s in enumerate(sizes)], "k long, length long")
    out = packing.pack(df, Scratch(spark), 2048, shard=60).toPandas()
    assert sorted(out["k"]) == list(range(1200)) and out["sequence_id"].nunique() == 1200
    assert out.groupby(out["sequence_id"].to_numpy() >> 24).size().max() <= 120


def test_equal_rows_meet_in_no_one_shard(spark):
    df = spark.range(1000).selectExpr("1L AS k", "700L AS length")
    out = packing.pack(df, Scratch(spark), 2048, shard=50).toPandas()
    assert len(out) == 1000 and out["sequence_id"].nunique() <= 520 and out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out.groupby(out["sequence_id"].to_numpy() >> 24).size().max() <= 120


ODD = ["l'été d’Été it's İstanbul ΣΑΣ ǅ ÀÇÈ", "x\x01y a\x1cb \u0085z \xa0é", "é <|endoftext|> 12,5 don't!'s K", "日本語 テスト ☃!!", "", " \n", "\tÄpfel\x0b(Öl), "]


def test_words_are_texts(tok):
    """Column-wise ids equal those of the whole tokenizer, odd signs and letters included."""
    from tokenizers import Tokenizer

    import pyarrow as pa

    rng = np.random.default_rng(3)
    signs = [chr(c) for c in [*range(1, 400), 0x130, 0x131, 0x3A3, 0x212A, 0x212B, 0x1E9E, 0x2028, 0x3000, 0x1F600, 0x301]] + [" "] * 60 + ["\n"] * 5
    texts = ODD + ["".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(300)]
    t, ids = Tokenizer.from_file(tok("word_bpe_49k.json")), packing.WordIds(tok("word_bpe_49k.json"), limit=100)
    for at in range(0, len(texts), 50):  # the small limit makes generations change
        got, starts = packing.document_ids(pa.array(texts[at : at + 50]), ids, 0)
        for k, text in enumerate(texts[at : at + 50]):
            assert got[starts[k] : starts[k + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_a_very_long_text(spark, tok):
    n = 300_000
    df = spark.createDataFrame([(1, "word " * n), (2, "x" * 100_000)], "doc_id long, text string")
    rows = packing.best_fit(df, tok("word_bpe_49k.json")).toPandas()
    assert rows[rows.doc_id == 1].length.sum() == n + 1 and (rows.length <= 2048).all()


def test_empty_and_repeats(spark, nothing, tok):
    assert packing.best_fit(nothing, tok("word_bpe_49k.json")).collect() == []
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.best_fit(df, tok("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1)] and len({(r.sequence_id, r.offset) for r in rows}) == 3
