"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt into shards. A shard keeps, for each dimension and sign, posting segments:
the rows whose component falls into one level of impact, with the level's bounds. A query takes
the segments of all dimensions in descending order of the most they can add to a score, and adds
each segment's lower bound to its rows' accumulators. After every few segments it sums up what
the segments still to come can add at most; it stops as soon as that proves that few rows remain
possible: those whose upper bound reaches the bar, the k-th best score that is proven. These alone
are scored exactly, from their whole vectors.

All shards of a query share a bar: the k-th best of exact scores against one shard, found first.

Components are whole numbers in doubles, and so are scores while all sums stay below 2**53, which
is looked at for each shard. A shard with larger ones is scored in Python's integers, which have
no bound. So results are exact, ties included; a score beyond 64 bits is ranked by its value and
written as the nearest 64-bit one.
"""

from __future__ import annotations

from math import floor, isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, about, and queries of a block; a task holds one shard and one block, and both
#: tables are repeated as often as the other has pieces.
SHARD, BLOCK = 8192, 4096
#: Levels of impact of a dimension's positive and of its negative components.
LEVELS = 8
#: Segments between two tries to stop, and the share of rows that may remain possible.
STEP, ENOUGH = 64, 0.05
SCALE = 256
#: Sums below this are exact in doubles.
_EXACT = 2.0**53
_LONG = 2**63


def quantised(vectors: DataFrame, vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, x (doubles): rows with null or non-finite parts go."""
    x = F.transform(F.col(column), lambda e: e.cast("double"))
    whole = F.col(vector_id).isNotNull() & F.col(column).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(vector_id).cast("long").alias("vec_id"), x.alias("x"))


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python's integers where a double times the scale may be none."""
    if not x.size or np.abs(x).max() < _EXACT / scale:
        return np.floor(x * scale)
    return np.array([[floor(v * scale) if isfinite(v * scale) else int(v) * scale for v in row] for row in x.tolist()], object)


def products(rows: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products."""
    if rows.dtype == object or q.dtype == object or (len(rows) and np.abs(rows).max() * np.abs(q).max() * len(q) >= _EXACT):
        ints = [int(v) for v in q.tolist()]
        return [sum(int(a) * b for a, b in zip(row, ints)) for row in rows.tolist()]
    return (rows @ q).astype(np.int64).tolist()


class ImpactIndex:
    """The posting segments of one shard: arrays of rows with the bounds of their components."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        self.ids, self.rows, self.rescored = ids, rows, 0
        self.postings: list[np.ndarray] = []
        dims, low, high = [], [], []
        self.large = float(np.abs(rows).max()) if rows.dtype != object and rows.size else float("inf") if rows.size else 0.0
        for d in range(rows.shape[1] if isfinite(self.large) else 0):
            c = rows[:, d]
            for part in (np.flatnonzero(c > 0), np.flatnonzero(c < 0)):
                size = np.abs(c[part])
                level = np.floor(size * levels / (size.max(initial=0) + 1))
                for v in range(levels - 1, -1, -1):
                    seg = part[level == v]
                    if len(seg):
                        dims.append(d)
                        low.append(c[seg].min())
                        high.append(c[seg].max())
                        self.postings.append(seg)
        self.sizes = np.array([len(p) for p in self.postings], np.int64)
        self.dims, self.low, self.high = np.array(dims, np.int64), np.array(low, float), np.array(high, float)

    def possible(self, query_id: int, q: np.ndarray, k: int, bar: float) -> np.ndarray:
        """The rows that can be among the k best, of which the k-th scores ``bar`` at least."""
        n, others = len(self.ids), self.ids != query_id
        if q.dtype == object or self.large * np.abs(q).max(initial=0) * len(q) >= _EXACT:
            return np.flatnonzero(others)
        w = q[self.dims]
        least = np.where(w >= 0, w * self.low, w * self.high)
        most = np.where(w >= 0, w * self.high, w * self.low)
        order = np.argsort(-np.maximum(np.abs(least), np.abs(most)), kind="stable")
        order = order[w[order] != 0]
        acc, loose = np.zeros(n), np.zeros(len(q))
        for at in range(0, len(order) + 1, STEP):
            some, rest = order[at : at + STEP], order[at + STEP :]
            if len(some):
                acc += np.bincount(np.concatenate([self.postings[s] for s in some]), np.repeat(least[some], self.sizes[some]), n)
            # A row has one segment of a dimension, so it scores at most so much more than its bounds.
            np.maximum.at(loose, self.dims[some], most[some] - least[some])
            # What each dimension's segments to come can still add to one row, at least and at most.
            up, down = np.zeros(len(q)), np.zeros(len(q))
            np.maximum.at(up, self.dims[rest], most[rest])
            np.minimum.at(down, self.dims[rest], least[rest])
            if n > k + 1 and (bar == -float("inf") or not len(rest)):
                known = acc[others]
                bar = max(bar, np.partition(known, len(known) - k)[len(known) - k] + down.sum()) if len(known) > k else bar
            found = np.flatnonzero(others & (acc >= bar - loose.sum() - up.sum()))
            if len(found) <= max(8 * k, ENOUGH * n):
                break
        return found

    def top(self, query_id: int, q: np.ndarray, k: int, bar: float = -float("inf")) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows but the query's own; ties to the smaller id. Rows that
        score less than the bar may be left out."""
        rows = self.possible(query_id, q, k, bar)
        self.rescored += len(rows)
        scores, ids = products(self.rows[rows], q), self.ids[rows].tolist()
        best = sorted(zip([-s for s in scores], ids))[:k]
        return [i for _, i in best], [-s for s in [b for b, _ in best]]


_FOUND = "query_id long, vec_id long, score long, beyond int, wide binary"


def _searched(queries: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a shard for each query; where a score is beyond 64 bits, on which side, and its order there."""
    out = []
    if len(queries) and len(held):
        index = ImpactIndex(held["vec_id"].to_numpy(), whole_numbers(np.stack(held["x"].to_numpy())))
        for query_id, x, bar in zip(queries["vec_id"], queries["x"], queries["bar"]):
            ids, scores = index.top(int(query_id), whole_numbers(np.asarray(x)[None])[0], k, -float("inf") if pd.isna(bar) else float(bar))
            for i, s in zip(ids, scores):
                beyond = 0 if -_LONG <= s < _LONG else 1 if s > 0 else -1
                out.append((query_id, i, min(max(s, -_LONG), _LONG - 1), beyond, (s + (1 << 2175)).to_bytes(272, "big") if beyond else None))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond", "wide"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector_id: str = "vec_id", column: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best other rows of every query.

    Queries are the rows whose id is divisible by ``every``. Vectors that are null or hold null
    or non-finite components take no part, nor do rows without an id; vectors of another length
    than the query's are no candidates. Fewer than k candidates are all returned; an empty table
    gives an empty result. Rows that repeat an id are candidates each, but never of their own id.
    Components of any size are exact; a score beyond 64 bits is written as the nearest such one.

    Query blocks meet row shards in tasks of bounded size; each yields k rows a query.
    """
    rows = quantised(vectors, vector_id, column).withColumn("dim", F.size("x")).filter("dim > 0")
    n = rows.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * block)))
    place = lambda count, *c: F.pmod(F.xxhash64(*c), F.lit(count)).cast("int")
    held = rows.withColumn("shard", place(shards, "vec_id", "x"))
    data = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).dropDuplicates(["vec_id", "x"]).withColumn("block", place(blocks, "vec_id"))
    keys = ["dim", "shard", "block"]

    def search(queries: DataFrame, among: DataFrame) -> DataFrame:
        own = lambda df: df.toDF(*df.columns)  # both come from one table: names alone must tell them apart
        return own(queries).groupBy(*keys).cogroup(own(among).groupBy(*keys)).applyInPandas(lambda q, d: _searched(q, d, k), _FOUND)

    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    if shards > 1:  # the bar: the k-th best in the first shard, where k rows of it were found
        first = search(asked.withColumn("shard", F.lit(0)).withColumn("bar", F.lit(None).cast("double")), data.filter("shard = 0"))
        bars = first.groupBy("query_id").agg(F.min("score").cast("double").alias("bar"), F.count("*").alias("n"), F.max(F.abs("beyond")).alias("wide"))
        bars = bars.filter((F.col("n") == k) & (F.col("wide") == 0) & (F.abs("bar") < _EXACT)).select("query_id", "bar")
        asked = asked.join(bars.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    else:
        asked = asked.withColumn("bar", F.lit(None).cast("double"))
    found = search(asked.withColumn("shard", every_shard), data)
    w = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("wide"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
