"""Fingerprints against a plain Python version of the same hashes."""

import hashlib
import re

import xxhash

from wavemill.llm import syncmers as S


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def hash_text(s):
    return signed(xxhash.xxh64_intdigest(s.encode(), seed=42))


def hash_longs(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed=h)
    return signed(h)


def sketch(text):
    if not text:
        return {}
    runs = re.findall(r"\S{1,32}", text, re.ASCII)
    if len(runs) < S.FEW or len(text) > S.LONG * len(runs):
        runs = re.findall(r"\S", text, re.ASCII)
    h = [hash_text(w) for w in runs]
    m = [hash_longs(h[i : i + 2]) for i in range(len(h) - 1)]
    out = {}
    for i in range(len(h) - S.K + 1):
        inner = m[i : i + S.K - S.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(hash_longs(h[i : i + S.K]) & 0xFFFFFFFF, i)
    out = dict(sorted(out.items())[: S.SIZE])
    return out or {hash_text(text) & 0xFFFFFFFF: 0}


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    u = sorted(a.keys() | b.keys())[: S.SIZE]
    both = sorted((a[x], b[x]) for x in u if x in a and x in b)
    kept = sum(q[1] > p[1] for p, q in zip(both, both[1:]))
    return len(both) / len(u) * (kept / (len(both) - 1) if len(both) > 1 else 1)


def test_against_plain_version(spark, docs, corpus):
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda r: r[0])
    got = {r.doc_id: r for r in S.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        r, a, e = got[i], sketch(text), sketch(edited)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h:08x}@{p}" for h, p in a.items())
        assert r.edited_fingerprint == " ".join(f"{h:08x}@{p}" for h, p in e.items())
        assert abs(r.near_edited - likeness(a, e)) < 1e-12 and abs(r.near_next - likeness(a, sketch(after))) < 1e-12


def test_next_row_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 7)
    ids = [None, *range(0, 300, 3), *range(10**9, 10**9 + 60), -(2**62), 12, 12]
    df = spark.createDataFrame([(i, f"{k:03d}") for k, i in enumerate(ids)], "doc_id long, tie string").repartition(5)
    got = {(r.doc_id, r.tie): r.next_tie for r in S.with_next(df, ["tie"]).collect()}
    order = sorted(((i, f"{k:03d}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {a: b[1] for a, b in zip(order, order[1:] + order[:1])}


def test_context_free(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    a, b = sketch(f"x y z {passage} u v"), sketch(f"other words here and more {passage}")
    whole = set(sketch(passage))
    assert whole <= set(a) and whole <= set(b)


def test_order_matters(spark):
    """Halves that change places share most anchors, but not their order."""
    half = [" ".join(f"{c}{k}" for k in range(80)) for c in "ab"]
    df = spark.createDataFrame([(1, " ".join(half)), (2, " ".join(half[::-1])), (3, " ".join(half) + " c d e f"), (4, " ".join(half))], "doc_id long, text string")
    one, two, three, _ = (r.s for r in df.select("doc_id", S.sketch(df["text"]).alias("s")).orderBy("doc_id").collect())
    pairs = spark.createDataFrame([(1, one, two), (2, one, three), (3, one, one)], "k int, a array<long>, b array<long>")
    swapped, longer, same = (r.v for r in pairs.select("k", S.likeness(pairs["a"], pairs["b"]).alias("v")).orderBy("k").collect())
    assert same == 1.0 and longer > 0.9 and swapped < longer and swapped < 1.0


def test_short_and_unspaced_texts_share_anchors(spark):
    texts = ["a short text here", "日本語の長い文章です" * 30, "x" * 10 + "abcdefghijklmnop" * 20]
    df = spark.createDataFrame([(2 * k, t) for k, t in enumerate(texts)] + [(2 * k + 1, t + "!") for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(S.fingerprints(df).collect())
    assert all(r.near_next > 0.7 for r in got[::2]) and all(0 < r.near_edited < 1 for r in got if len(texts[r.doc_id // 2]) < 30)


def test_empty_single_and_repeats(spark, nothing):
    assert S.fingerprints(nothing).collect() == []
    (r,) = S.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.n_anchors == 1 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    df = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None), (2, ""), (3, "x" * 300_000)], "doc_id long, text string")
    got = S.fingerprints(df).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in got if not r.n_chars} == {""}


def test_plan_is_native(docs):
    plan = S.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
