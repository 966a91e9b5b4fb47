"""Document fingerprints of closed syncmers.

A text is a row of tokens: runs of up to 32 signs without white space or, for texts of few or of
very long runs, single signs. A window of ``K`` tokens is a closed syncmer if, of the hashes of its ``K - S + 1`` inner windows of ``S`` tokens, the
smallest stands first or last. That depends on the window alone, so both texts that share a
passage choose the same anchors in it, whatever stands around. About two windows in five are
chosen. The fingerprint is the ``SIZE`` smallest distinct anchor hashes with the token position
at which each first occurs. The likeness of two fingerprints matches anchors by position: it is
the estimated Jaccard similarity of the anchor sets, times the share of neighbouring common
anchors that stand in the same order in both texts. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 6
S = 2
SIZE = 64
#: Rows of a stretch of neighbouring doc_ids, about, and the most stretches; beyond that many rows a
#: stretch grows, but its task streams it, sorted on disk, and looks one row ahead.
STRETCH, STRETCHES = 1000, 20_000
#: Texts of fewer runs, or of more signs a run on average, are read sign by sign.
FEW, LONG = 12, 24
_POSITION_BITS = 31


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sketch(text: Column) -> Column:
    """Sorted array of ``hash << 24 | position``; a text without anchors has its own hash, '' none."""
    inner = K - S + 1

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        small = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
        return _let(small, lambda m: of_windows(h, m, n))

    # slice() copies its whole array first, so windows read their elements one by one.
    def of_windows(h: Column, m: Column, n: Column) -> Column:
        edges = lambda i: F.least(F.get(m, i), F.get(m, i + (inner - 1)))
        within = lambda i: F.least(*(F.get(m, i + k) for k in range(1, inner - 1)))
        chosen = F.filter(F.sequence(F.lit(0), n - K), lambda i: edges(i) <= within(i))
        anchor = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(K))).bitwiseAND(F.lit(0xFFFFFFFF))
        return _let(chosen, lambda at: _let(F.transform(at, anchor), lambda a: of_anchors(a, at)))

    def of_anchors(a: Column, at: Column) -> Column:
        least = F.slice(F.sort_array(F.array_distinct(a)), 1, SIZE)
        position = lambda x: F.get(at, F.array_position(a, x).cast("int") - 1)
        return F.transform(least, lambda x: F.shiftleft(x, _POSITION_BITS) + position(x))

    runs = F.regexp_extract_all(text, F.lit(r"\S{1,32}"), F.lit(0))
    signs = F.regexp_extract_all(text, F.lit(r"\S"), F.lit(0))
    tokens = _let(runs, lambda r: F.when((F.size(r) >= FEW) & (F.char_length(text) <= LONG * F.size(r)), r).otherwise(signs))
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    own = F.array(F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), _POSITION_BITS))
    empty = F.array().cast("array<long>")
    found = _let(hashes, lambda h: F.when(F.size(h) >= K, of_hashes(h)).otherwise(empty))
    return F.when(text == "", empty).otherwise(_let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(own)))


def written(s: Column) -> Column:
    """A sketch as a string: eight hexadecimal digits and a position of each anchor."""
    one = lambda x: F.concat_ws("@", F.lpad(F.lower(F.hex(F.shiftright(x, _POSITION_BITS))), 8, "0"), x.bitwiseAND(F.lit(2**_POSITION_BITS - 1)).cast("string"))
    return F.array_join(F.transform(s, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of the smallest hashes of either sketch, the share that both have, times the share of those
    next to each other that keep their order; 1 if both are empty."""
    hashes = lambda s: F.transform(s, lambda x: F.shiftright(x, _POSITION_BITS))
    places = lambda s: F.transform(s, lambda x: x.bitwiseAND(F.lit(2**_POSITION_BITS - 1)))

    def of(x: Column, y: Column) -> Column:
        least = F.slice(F.sort_array(F.array_union(x, y)), 1, SIZE)
        return _let(least, lambda u: _let(F.array_intersect(u, F.array_intersect(x, y)), lambda both: F.size(both) / F.size(u) * in_order(both, x, y)))

    def in_order(both: Column, x: Column, y: Column) -> Column:
        at = lambda s, of, h: F.get(places(s), F.array_position(of, h).cast("int") - 1)
        pairs = F.sort_array(F.transform(both, lambda h: F.struct(at(a, x, h).alias("a"), at(b, y, h).alias("b"))))
        kept = lambda p: F.size(F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i)["b"] > F.get(p, i - 1)["b"]))
        return F.when(F.size(both) < 2, 1.0).otherwise(_let(pairs, lambda p: kept(p) / (F.size(p) - 1)))

    same = _let(hashes(a), lambda x: _let(hashes(b), lambda y: of(x, y)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def with_next(rows: DataFrame, columns: list[str], order: str = "doc_id", tie: str = "tie") -> DataFrame:
    """Adds ``next_<column>`` of the next row by (order, tie); after the last comes the first.

    Rows are dealt into stretches of neighbouring keys, and the first row of a stretch also goes,
    as a guest, to the end of the one before. So no task holds more than a stretch, and texts
    move once. Null keys come first.
    """
    key = F.coalesce(F.col(order), F.lit(-(2**63)).cast("long"))
    n, least = rows.select(F.count("*"), F.min(key)).first()
    if not n:
        return rows.select("*", *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(f"next_{c}") for c in columns))
    parts = min(STRETCHES, max(1, n // STRETCH))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    bounds = [least] if parts == 1 else sorted({least, *rows.select(F.percentile_approx(key, shares, max(10_000, 10 * parts))).first()[0]})
    held, steps = F.array(*(F.lit(b).cast("long") for b in bounds)), max(1, len(bounds) - 1).bit_length()

    def halved(at: Column, i: Column) -> Column:
        to = at + F.pow(F.lit(2.0), F.lit(steps - 1) - i).cast("int")
        return F.when(F.get(held, to) <= F.col("__key"), to).otherwise(at)

    own = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), halved)
    place = lambda stretch, guest: F.struct(stretch.alias("stretch"), F.lit(guest).alias("guest"))
    dealt = rows.withColumn("__key", key).withColumn("__own", own)
    before = F.pmod(F.col("__own") - 1, F.lit(len(bounds)))
    places = F.when(F.get(held, F.col("__own")) == F.col("__key"), F.array(place(F.col("__own"), 0), place(before, 1))).otherwise(F.array(place(F.col("__own"), 0)))
    dealt = dealt.select("*", F.explode(places).alias("__place"))
    w = Window.partitionBy("__place.stretch").orderBy("__place.guest", "__key", tie)
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out.filter("__place.guest = 0").drop("__key", "__own", "__place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_anchors; a row for each input row.

    The edited text has its last quarter replaced by the beginning of the next document. Null
    texts are empty; an empty text has the empty fingerprint, which is like another empty one
    (1) and unlike any other (0). Rows that repeat a doc_id follow each other in the order of
    their texts' hashes. A single row is its own next one. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("sketch", sketch(F.col("text")))
    n = F.char_length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - moved), F.substr("next_text", F.lit(1), moved))
    out = with_next(rows, ["text", "sketch"]).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").alias("n_anchors"),
    )
