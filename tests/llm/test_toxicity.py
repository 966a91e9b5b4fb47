"""The chain on planted words: held-out accuracy, out-of-fold inputs, defined edge cases."""

import random

import numpy as np
import pytest

from wavemill.llm import toxicity


def planted(n, seed=1):
    """Toxic documents hold one of a few insults or an inflected form of a rare stem; junk is loud."""
    rng, docs, labels = random.Random(seed), [], []
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if junk:
            w += ["zzbuynow"] * 3
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "clown"]) if k % 2 else "schmutz" + rng.choice(plain)
        docs.append((k, " ".join(w)))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = planted(1500)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = toxicity.toxicity(df, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")).collect()
    said = {r.doc_id: r for r in out}
    assert len(out) == 1500
    wrong = sum(said[i].toxic != bool(t) for i, _, t in labels[900:])
    assert wrong <= 3
    assert sum((said[i].p_low_quality > 0.5) != (not q) for i, q, _ in labels[900:]) <= 6
    kept = {r.doc_id for r in toxicity.without_toxic(df, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")).collect()}
    assert kept == {i for i, r in said.items() if not r.toxic}


def test_chain_feeds_out_of_fold_predictions():
    """A later category that equals an earlier one is learnt from its probability alone."""
    rng = np.random.default_rng(0)
    n, vocabulary = 600, [f"w{k}" for k in range(40)]
    doc = np.repeat(np.arange(n), 8)
    word = np.concatenate([rng.choice(40, 8, replace=False) for _ in range(n)])
    has = np.zeros(n, bool)
    has[doc[word == 3]] = True
    y = np.stack([has, has & (rng.random(n) < 0.9)], axis=1).astype(int)
    chain = toxicity.fit_chain(n, doc, word, vocabulary, y, ("a", "b"))
    assert chain.models[1][1].shape == (1,) and chain.models[1][1][0] > 0
    p = chain.predict([chain.columns["=w3"]])
    assert p[0] > 0.9 and p[1] > 0.6 and chain.predict([])[1] < 0.1


def test_linear_model_is_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.random((200, 3)), (rng.random(200) < 0.5).astype(float)
    w = toxicity.fit_linear(x, y)
    z = np.hstack([x, np.ones((200, 1))])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([toxicity.PENALTY] * 3 + [1e-3]) * w
    assert np.abs(gradient).max() < 1e-2


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (1, None, 1), (None, 1, 1), (2, None, None)]])
def test_without_labels_nothing_is_toxic(spark, docs, labels):
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == docs.count() and not any(r.toxic for r in out)


def test_nulls_empty_and_columns(spark, nothing, docs):
    docs2, labels = planted(400, 2)
    labelled = spark.createDataFrame([*labels, labels[0], (None, 1, 1)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([*docs2, docs2[0], (None, None), (9000, ""), (9001, "!!")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS quality")
    kept = toxicity.without_toxic(train, labelled)
    assert kept.columns == train.columns and {None, 9000, 9001} <= {r.doc_id for r in kept.collect()}
    assert toxicity.toxicity(nothing, labelled).collect() == []


def plainly(chain, text):
    """Probabilities of one text from the chain's weights, feature by feature."""
    import math
    import re

    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    present = {f"={w}" for w in words} | {w[:n] for w in words for n in toxicity.PREFIXES if len(w) >= n}
    out = []
    for w, chained, bias in chain.models:
        z = bias + sum(float(w[c]) for f, c in chain.columns.items() if f in present) + sum(a * b for a, b in zip(chained, out))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_scores_against_the_weights_read_plainly(spark):
    docs, labels = planted(300, 4)
    rows = [*docs, (9000, None), (9001, ""), (9002, "idiot " * 200_000), (9002, "Schmutzbal"), (None, "MORON")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    key = lambda r: (r[0], round(r[1], 6), round(r[2], 6))
    got = sorted(((str(r.doc_id), *r[1:]) for r in toxicity.score(df, chain).collect()), key=key)
    want = sorted(((str(i), *plainly(chain, t)) for i, t in rows), key=key)
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-9) and [g[0] for g in got] == [w[0] for w in want]
    assert len({g[2] for g in got}) > 5


def test_threshold_is_the_middle_of_the_best():
    p, y = np.array([0.95, 0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 1, 0, 0, 0])
    assert abs(toxicity.best_threshold(p, y) - 0.55) < 1e-12
    assert toxicity.best_threshold(np.array([0.9, 0.9, 0.1]), np.array([1, 0, 0])) <= 0.9


def test_which_of_several_texts_trains_is_stated(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, f"text number {w}") for w in ("one", "two", "three", "four")]
    seen = {tuple(r.words) for k in range(3) for r in toxicity.training_rows(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(k + 1), labels).collect()}
    assert len(seen) == 1
