"""Toxicity by a classifier chain of linear models.

The categories are predicted in a stated order. Each is a logistic regression on the presence of
words and word beginnings, and on the probabilities of the categories before it. While training,
those probabilities are out-of-fold predictions, so a later model never sees how well an earlier
one has learnt its own training rows. Beginnings of words are features as insults of inflecting
languages come in many forms.

Training takes at most ``SAMPLE`` labelled rows (those with the smallest hash of doc_id), joined
to whole texts; scoring reads every whole text of the corpus, one Arrow batch at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Shipped, map_rows, release, tidy

#: Labelled rows that train the chain, at most.
SAMPLE = 6000
#: Lengths of the word beginnings that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: Features of a category, at most, and the least evidence (G squared) for one.
FEATURES = 200
EVIDENCE = 15.0
FOLDS = 5
PENALTY = 0.5
#: Thresholds whose F1 on out-of-fold predictions is less than the best one by at most this share
#: are as good as it; the middle of them is taken.
PLATEAU = 0.005

_WORD = re.compile(r"[^\W\d_]+")


def words(text: bytes) -> set[str]:
    """The distinct lower-cased letter runs of a text."""
    return set(_WORD.findall(text.decode().lower()))


def beginning(word: str, n: int) -> str | None:
    """The feature of a word for length n: its beginning, the whole word for 0, none if shorter."""
    return f"={word}" if not n else word[:n] if len(word) >= n else None


def features(word: str) -> list[str]:
    return [f for n in (0, *PREFIXES) if (f := beginning(word, n))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of an L2-penalised logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return w


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Chain:
    """Fitted chain: ``columns`` maps a feature to its column, ``models`` holds for each
    category its weights by column, its weights of earlier probabilities, and its intercept."""

    categories: tuple[str, ...]
    columns: dict[str, int]
    models: list[tuple[np.ndarray, np.ndarray, float]]
    thresholds: list[float]

    def predict(self, present: list[int]) -> list[float]:
        before: list[float] = []
        for w, chained, bias in self.models:
            z = bias + (float(w[present].sum()) if present else 0.0) + sum(a * b for a, b in zip(chained, before))
            before.append(float(_sigmoid(np.float64(z))))
        return before


def fit_chain(n: int, doc: np.ndarray, word: np.ndarray, vocabulary: list[str], labels: np.ndarray, categories: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Fit on n documents' distinct words (pairs of a document and a place in the vocabulary) and
    a 0/1 matrix of labels, a column a category. A category of one class has a constant model.

    The features of one length are looked at together, then the best of all lengths are taken.
    """
    groups, found = [], [[] for _ in categories]
    for length in (0, *PREFIXES):
        ids: dict[str, int] = {}
        chosen: list[np.ndarray] = []
        of_word = np.fromiter((-1 if (f := beginning(w, length)) is None else ids.setdefault(f, len(ids)) for w in vocabulary), np.int32, len(vocabulary))
        names = list(ids)
        del ids
        often = np.bincount(of_word[word] + 1, minlength=len(names) + 1) >= 3  # rarer ones tell nothing
        often[0] = False
        pairs = of_word[word]
        used = often[pairs + 1]
        pairs = np.unique(doc[used].astype(np.int64) * max(len(names), 1) + pairs[used])
        at, feature = pairs // max(len(names), 1), pairs % max(len(names), 1)
        for j in range(len(categories)):
            g, best = _informative(at, feature, len(names), labels[:, j])
            found[j] += [(-score, names[f]) for score, f in zip(g, best)]
            chosen.append(best)
        wanted = np.unique(np.concatenate(chosen))
        keep = np.isin(feature, wanted)
        groups.append(({int(f): names[f] for f in wanted}, at[keep], feature[keep]))
    chosen = [sorted(x)[:FEATURES] for x in found]
    used = sorted({name for x in chosen for _, name in x})
    columns = {name: i for i, name in enumerate(used)}
    chosen = [np.array(sorted(columns[name] for _, name in x), np.int64) for x in chosen]
    x = np.zeros((n, len(used)), np.float32)
    for names, at, feature in groups:
        column = np.array([columns.get(names[f], -1) for f in feature], np.int64)
        x[at[column >= 0], column[column >= 0]] = 1

    fold = np.arange(n) % folds
    before, models, thresholds = np.zeros((n, 0)), [], []
    for j in range(len(categories)):
        y, cols = labels[:, j].astype(float), chosen[j]
        full, chained = np.zeros(len(used)), np.zeros(j)
        prior = (y.sum() + 0.5) / (n + 1)
        if len(np.unique(y)) < 2 or min(y.sum(), n - y.sum()) < folds:
            models.append((full, chained, float(np.log(prior / (1 - prior)))))
            before = np.hstack([before, np.full((n, 1), prior)])
            thresholds.append(0.5)
            continue
        z = np.hstack([x[:, cols], before]).astype(np.float64)
        out, w = np.empty(n), fit_linear(z, y)
        for k in range(folds):
            out[fold == k] = _apply(z[fold == k], fit_linear(z[fold != k], y[fold != k], w))
        full[cols], chained = w[: len(cols)], w[len(cols) : -1]
        models.append((full, chained, float(w[-1])))
        before = np.hstack([before, out[:, None]])
        thresholds.append(best_threshold(out, y))
    return Chain(tuple(categories), columns, models, thresholds)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds of best F1, or nearly so."""
    order = np.argsort(-p, kind="stable")
    hits, said = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    f1 = 2 * hits / (said + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    good = np.flatnonzero(f1 >= (1 - PLATEAU) * f1.max())
    after = p[order][good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
    return float((p[order][good[0]] + after) / 2)


def _informative(doc: np.ndarray, feature: np.ndarray, n_features: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features whose presence says most about y, and their G squared (of the 2 x 2 table)."""
    n, pos = float(len(y)), float(y.sum())
    total = np.bincount(feature, minlength=n_features).astype(float)
    a = np.bincount(feature, weights=y[doc], minlength=n_features)
    g = np.zeros(n_features)
    for got, of, all_ in ((a, total, pos), (total - a, total, n - pos), (pos - a, n - total, pos), (n - pos - total + a, n - total, n - pos)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(got > 0, 2 * got * np.log(got * n / np.maximum(of * all_, 1e-9)), 0)
    g[total < 3] = 0
    order = np.lexsort((np.arange(n_features), -g))[:FEATURES]
    order = order[g[order] >= EVIDENCE]
    return g[order], order


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """words, quality, toxic of the labelled documents that train.

    Labels that are null take no part; where a doc_id is labelled repeatedly, one toxic label
    and one of low quality suffice.
    """
    one = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most SAMPLE rows: safe to broadcast
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(one), "doc_id")
    # Of several texts under one doc_id the one of smallest hash trains, whatever the order of rows.
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def make():
        return lambda doc_id, quality, toxic, text: (doc_id, sorted(words(text)), quality, toxic)

    return map_rows(rows.select("doc_id", "quality", "toxic", "text"), make, "doc_id long, words array<string>, quality int, toxic int")


#: The categories of the ``labels`` table, in the chain's order: what the first says helps the next.
CATEGORIES = {
    "low_quality": lambda quality, toxic: quality == 0,
    "toxic": lambda quality, toxic: toxic == 1,
    "toxic_low_quality": lambda quality, toxic: (toxic == 1) & (quality == 0),
}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    rows = training_rows(docs, labels, sample).orderBy("doc_id").toArrow()
    quality, toxic = (rows[c].to_numpy() for c in ("quality", "toxic"))
    y = np.stack([np.asarray(f(quality, toxic), int) for f in CATEGORIES.values()], axis=1) if rows.num_rows else np.zeros((0, len(CATEGORIES)), int)
    lists = rows["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    n, doc = len(lists), np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    word, vocabulary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    del rows, lists, coded
    chain = fit_chain(n, doc, word, vocabulary, y, tuple(CATEGORIES))
    del doc, word, vocabulary
    release()  # the driver goes on with much less
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability of each category; a row for each input row.

    Null, empty and wordless texts get the chain's probabilities for no features.
    """
    model = Shipped(docs.sparkSession, chain)  # some hundred features a category

    def make():
        chain = model.value
        found = Memo(lambda w: [c for h in features(w) if (c := chain.columns.get(h)) is not None])

        def one(doc_id, text):
            hits: set[int] = set()
            for w in words(text or b""):
                if got := found[w]:
                    hits.update(got)
            return (doc_id, *chain.predict(sorted(hits)))

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float | None = None) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, p_toxic_low_quality, toxic: a row for each input row.

    A document is toxic if its p_toxic reaches the threshold (by default the one of best F1 out
    of fold). Null and empty texts have no features and are not toxic unless most labelled
    documents are. Rows that repeat are scored alike; where one doc_id has several texts, each is
    scored and one of them trains. Very long texts are read whole. An empty table gives an empty result; without labels all probabilities are one half
    and nothing is toxic.
    """
    out = score(docs, chain := fit(docs, labels, sample))
    informed = any(np.any(w) for w, _, _ in chain.models)
    return out.withColumn("toxic", (F.col("p_toxic") >= (threshold or chain.thresholds[chain.categories.index("toxic")])) & F.lit(informed))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float | None = None) -> DataFrame:
    """The documents that aren't toxic, with all their columns, in one pass and without a join."""
    chain = fit(docs, labels, sample)
    if not any(np.any(w) for w, _, _ in chain.models):
        return docs
    model = Shipped(docs.sparkSession, chain)
    at = chain.categories.index("toxic")
    threshold = threshold or chain.thresholds[at]

    def run(batches):
        import pyarrow as pa

        chain = model.value
        found = Memo(lambda w: [c for h in features(w) if (c := chain.columns.get(h)) is not None])
        for t in batches:
            keep = []
            for x in t["text"]:
                hits: set[int] = set()
                for w in words((x.as_py() or "").encode()):
                    if got := found[w]:
                        hits.update(got)
                keep.append(chain.predict(sorted(hits))[at] < threshold)
            yield t.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
