"""Near-duplicate documents by min-max hashing.

Every permutation yields two signature values, its minimum and its maximum over the document's
shingles, so 80 hash evaluations a shingle give 160 values. Minima and maxima match with
probability equal to the Jaccard similarity, and as they are (nearly) independent the mean of
both kinds estimates it without bias and with less variance than minima alone. Bands of four
values propose pairs; minimum and maximum of one permutation never share a band.

Links are confirmed on whole shingle sets. A shingle is told by a 64-bit hash, so of n shingles of
two documents some two pass for one with a probability of n**2 / 2**65; equal sets are told by 128
bits. A pair of similarity 0.75 misses all 40 bands with probability (1 - 0.75**4)**40 = 2.5e-7,
and is taken for less similar by the signatures with about 2e-7; one of higher similarity still
more rarely.

No group is ever expanded into its pairs. Equal sets are one class from the start. Then a set is
tested against the smallest members of its buckets, two at most (linear); after components are
known, only buckets that still hold several components are looked at again: their members' signatures
are compared block by block. First each member is confirmed against the few in other components
that look most similar. What still looks similar across components then meets in groups, whose
texts are dealt in blocks: all pairs across components are confirmed where two blocks meet, and no
row is made of a pair but of one that joins components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, in_row, split_words, text_chunks, tidy

SHINGLE_WORDS = 5
BANDS = 40
BAND_ROWS = 4
#: A pair is confirmed if its estimates reach the similarity less these: first that of the 160
#: values, then that of so many more permutations: over five standard deviations of either.
MARGIN = 0.18
FINE, FINE_MARGIN = 384, 0.085
#: Of the smallest members of its buckets, a set is first tested against those it meets most often,
#: and at least so often.
STARS, MEETINGS = 2, 4
#: The partners in other components that a set is first tested against, for each of its buckets.
FIRST = 4
#: Members, and about the shingles, of a block of a group whose texts are compared in one piece.
GROUP, GROUP_SHINGLES = 512, 2_000_000
#: Members of a bucket that are compared in one piece.
BLOCK = 2048
#: A representative's text goes to up to so many tasks, each with part of its candidates.
SALTS = 64

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on wrapping 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(text: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; A-Z lower-cased, words part at ASCII space.

    With fewer words than a shingle has, the whole sequence is one; without words, none.
    """
    import xxhash

    counts, places, distinct = split_words(pc.ascii_lower(text))
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[places]
    c, ends, out = _odd(words, 11), np.cumsum(counts), []
    whole = np.full(max(0, len(h) - words + 1), words, np.uint64)  # of every run of words, over ends of texts too
    for j in range(words):
        whole += h[j : len(whole) + j] * c[j]
    whole = _mix(whole)
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= words:
            x = np.sort(whole[end - n : end - words + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(_mix(np.uint64(n) + (h[end - n : end] * c[:n]).sum(keepdims=True, dtype=np.uint64)) if n else h[:0])
    return out


def sets_of(text: pa.Array, words: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of any number of texts, some at a time."""
    for a, b in text_chunks(text):
        yield from shingle_sets(text[a:b], words)


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = 21) -> np.ndarray:
    """Minima, then maxima, under ``bands * rows / 2`` permutations of the 64-bit hashes."""
    n = bands * rows // 2
    a, b = _odd(n, seed)[:, None], _odd(n, seed + 1)[:, None]
    low, high = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
    step = 80_000 // n
    for at in range(0, len(shingles), step):
        x = a * shingles[at : at + step] + b
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    v = _mix(sig).reshape(bands, rows)
    return _mix((v * _odd(rows, 31)).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _odd(1, 32)[0]).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """The class of equal sets, as 128 bits."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity as the share of equal signature bytes, minima and maxima alike."""
    return (a == b).mean(axis=-1)


def _short(sig: np.ndarray) -> bytes:
    """A byte of each value."""
    return (_mix(sig) & _U(255)).astype(np.uint8).tobytes()


def told(docs: DataFrame) -> DataFrame:
    """The documents and a hash of each text, which tells rows of one (or no) doc_id apart."""
    return documents(docs).withColumn("told", F.xxhash64("text"))


def signatures(docs: DataFrame, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, told, n_shingles, digest (null without words), keys (band keys), sig (a byte of each
    value, then four of each band key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("told", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, b in text_chunks(t["text"], 1_000_000):
                out = []
                for s in shingle_sets(t["text"][a:b], words):
                    if not len(s):
                        out.append((0, None, [], b""))
                        continue
                    v = signature(s, bands, rows)
                    keys = band_keys(v, bands, rows)
                    out.append((len(s), digest(s), keys, _short(v) + keys.astype(np.uint32).tobytes()))
                made = [pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[2:])]
                yield pa.RecordBatch.from_arrays([t["doc_id"][a:b], t["told"][a:b], *made], schema=schema)

    return told(docs).select("doc_id", "told", "text").mapInArrow(tidy(run), "doc_id long, told long, n_shingles long, digest binary, keys array<long>, sig binary")


def classes_of(sig: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The signatures with the node of their class (sid, 64 bits of its digest, null without words),
    and the classes. Where two classes share a node, all but one get another one."""
    sig = sig.withColumn("sid", F.xxhash64("digest")).withColumn("sid", F.when(F.col("digest").isNotNull(), F.col("sid")))
    for k in itertools.count(1):
        any_ = [F.first(c).alias(c) for c in ("keys", "sig", "n_shingles")]
        row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "told")).alias("row")
        found = sig.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), row, F.count("*").alias("n"), F.min("digest").alias("digest"), F.max("digest").alias("other"), *any_)
        found = scratch.save(found, f"classes-{k}")
        clash = found.filter("digest <> other").select("sid", F.col("digest").alias("stays"))
        if not clash.limit(1).count():
            return sig, found.drop("other")
        moved = F.when(F.col("stays") != F.col("digest"), F.xxhash64("digest", F.lit(k))).otherwise(F.col("sid"))
        sig = scratch.save(sig.join(clash, "sid", "left").withColumn("sid", moved).drop("stays"), f"sig-{k}")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sid, label): the smallest node that the edges (a, b) reach, for every node with an edge.

    Every node points at its smallest neighbour, or itself; pointers jump to their pointers until
    all point at roots; edges between different roots remain and are treated likewise. Edges only
    get fewer, and the rounds grow with the logarithm of the longest chain.
    """
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges-0")
    labels = None
    for k in itertools.count(1):
        both = edges.select(F.col("a").alias("sid"), F.col("b").alias("to")).union(edges.select("b", "a"))
        roots = scratch.save(both.groupBy("sid").agg(F.min("to").alias("to")).select("sid", F.least("sid", "to").alias("label")), f"{name}-roots-{k}-0")
        for j in itertools.count(1):  # a jump halves what is left of the way
            over = roots.select(F.col("sid").alias("at"), F.col("label").alias("next"))
            jumped = scratch.save(roots.join(over, F.col("label") == F.col("at")).select("sid", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), f"{name}-roots-{k}-{j}")
            scratch.drop(f"{name}-roots-{k}-{j - 1}")
            roots = jumped.select("sid", "label")
            if not jumped.filter("moved").limit(1).count():
                break
        labels = roots if labels is None else scratch.save(relabelled(labels, roots), f"{name}-labels-{k}")
        of = lambda c: roots.select(F.col("sid").alias(c), F.col("label").alias(f"root_{c}"))
        left = edges.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        edges = scratch.save(left.distinct(), f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}")
        if not edges.limit(1).count():
            break
    return labels


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels that ``roots`` knows as nodes become their roots."""
    new = roots.select(F.col("sid").alias("at"), F.col("label").alias("root"))
    return labels.join(new, F.col("label") == F.col("at"), "left").select("sid", F.coalesce("root", "label").alias("label"))


def merged(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels of all nodes after new edges, which join whole components."""
    of = lambda c: labels.select(F.col("sid").alias(c), F.col("label").alias(f"label_{c}"))
    across = found.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return scratch.save(relabelled(labels, components(across, scratch, name)), name)


def _values(sigs: list[bytes], values: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the signatures' values, and their short band keys."""
    whole = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    return whole[:, :values], np.ascontiguousarray(whole[:, values:]).view(np.uint32)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.

    The text of a goes once to each task that confirms a part of its candidates.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    first = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("sid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = salted.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "text")
    dealt = first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in batches:
            out = []
            a, salt, b = (t[c].to_pylist() for c in ("a", "salt", "b"))
            for key, other, s in zip(zip(a, salt), b, sets_of(t["text"], words)):
                if other is None:
                    now, held = key, s
                elif key == now:
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if denominator * both >= numerator * (len(held) + len(s) - both):
                        out.append((key[0], other))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return dealt.mapInArrow(tidy(run), "a long, b long")


def _across(members: DataFrame, most: int | None, values: int, ratio: float) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose sizes and signatures agree.

    members: key, band, sid, label, n_shingles, sig, fine, blocks (of the bucket). Of two components in
    a bucket, the members of the smaller one look for partners in the other. Each proposes its
    ``most`` best ones. None: as many pairs as connect whatever has any such pair here, so fewer
    than members. Of the buckets that a pair shares only the first band's looks at it. Blocks of a
    large bucket meet pairwise, each pair of blocks in a task of its own.
    """
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sid"), F.col("blocks"))).otherwise(F.lit(0))
    dealt = (
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "band", "label", "n_shingles", "sig", "fine")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def pairs(sid: np.ndarray, band: int, label: np.ndarray, n: np.ndarray, sigs: list[bytes], fines: list[bytes]) -> set:
        found, (sig, keys) = set(), _values(sigs, values)
        fine = np.frombuffer(b"".join(fines), np.uint8).reshape(len(fines), -1)
        _, of, count = np.unique(label, return_inverse=True, return_counts=True)
        rank = np.lexsort((np.arange(len(count)), count)).argsort()[of]  # of a component, by its members here
        tree = np.arange(len(sid))  # what the pairs so far connect
        for x in np.flatnonzero(rank < rank.max()):
            near = np.flatnonzero((rank > rank[x]) & (np.minimum(n, n[x]) >= ratio * np.maximum(n, n[x])))
            near = near[tree[near] != tree[x]] if most is None else near
            near = near[(keys[near] == keys[x]).argmax(axis=1) == band] if len(near) else near
            near = near[estimate(sig[x], sig[near]) >= ratio - MARGIN]
            est = estimate(fine[x], fine[near])
            near, est = near[est >= ratio - FINE_MARGIN], est[est >= ratio - FINE_MARGIN]
            for y in near[np.lexsort((sid[near], -est))][:most]:
                if most is None and tree[y] == tree[x]:
                    continue
                found.add((min(sid[x], sid[y]), max(sid[x], sid[y])))
                tree[tree == tree[y]] = tree[x]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(rows: list) -> pa.RecordBatch:
            sid, band, label, n, sigs, fines = zip(*rows)
            got = list(pairs(np.array(sid), band[0], np.array(label), np.array(n), list(sigs), list(fines))) if len(set(label)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(g[k]) for g in got], pa.int64()) for k in (0, 1)], schema=schema)

        now, rows = None, []
        for t in batches:
            cols = [t[c].to_pylist() for c in ("key", "i", "j", "sid", "band", "label", "n_shingles", "sig", "fine")]
            for key, i, j, *row in zip(*cols):
                if (key, i, j) != now:
                    if rows:
                        yield done(rows)
                    now, rows = (key, i, j), []
                rows.append(row)
        if rows:
            yield done(rows)

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _joined(groups: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) that join all components of a group which have a similar enough pair in it.

    groups: group, sid, label (component), n_shingles. The members of a group's largest component need
    not meet each other: they are dealt into blocks of their own, which only meet the others' blocks.
    """
    by_label = groups.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    of = by_label.groupBy("group").agg(F.max(F.struct("n", "label", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.lit(1).cast("long"), F.ceil(n / GROUP), F.ceil(size / GROUP_SHINGLES))
    of = of.select("group", F.col("most.label").alias("largest"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("few"), blocks(F.col("most.n"), F.col("most.size")).alias("many"))
    hashed = F.xxhash64("sid")
    block = F.when(F.col("label") == F.col("largest"), F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few")))
    last = F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
    dealt = (
        groups.join(of, "group")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "label")
        .join(texts, "sid")
        .repartition("group", "i", "j")
        .sortWithinPartitions("group", "i", "j")
    )

    def pairs(i: int, j: int, rows: list) -> list[tuple[int, int]]:
        block, sid, label, sets = zip(*rows)
        block, sizes, found = np.array(block), np.array([len(s) for s in sets]), []
        tree = np.unique(label, return_inverse=True)[1]  # a number for what is one component by now
        ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(theirs) or (tree == tree[0]).all():
            return found
        # The holders of each distinct shingle of theirs.
        shingles, which = np.unique(np.concatenate([sets[y] for y in theirs]), return_inverse=True)
        holders = np.repeat(theirs, sizes[theirs])[np.argsort(which, kind="stable")]
        starts = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(shingles)))))
        for x in ours:
            if (tree[theirs] == tree[x]).all():
                continue
            at = np.minimum(np.searchsorted(shingles, sets[x]), len(shingles) - 1)
            both = np.bincount(in_row(at[shingles[at] == sets[x]], holders, starts)[0], minlength=len(sizes))
            for y in np.flatnonzero((both > 0) & (denominator * both >= numerator * (sizes + sizes[x] - both)) & (tree != tree[x])):
                if tree[y] != tree[x]:
                    found.append((sid[x], sid[y]))
                    tree[tree == tree[y]] = tree[x]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        made = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
        for t in batches:
            group, i, j, *rest = (t[c].to_pylist() for c in ("group", "i", "j", "block", "sid", "label"))
            for key, *row in zip(zip(group, i, j), *rest, sets_of(t["text"], words)):
                if key != now:
                    out += pairs(*now[1:], rows) if rows else []
                    now, rows = key, []
                rows.append(row)
            yield made(out)
            out = []
        yield made(pairs(*now[1:], rows) if rows else [])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: tuple[int, int] = (75, 100), bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept; one row per input row.

    Documents are linked where ``similarity[1] * |A & B| >= similarity[0] * |A | B|`` for their
    sets of distinct word shingles. Null or blank texts have the empty set, are linked with
    nothing and are kept. Rows that repeat a doc_id with the same text share a class. A null
    doc_id takes its component's smallest id, or stays null; it is kept if that is null.
    Columns besides doc_id and text are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    sig, classes = classes_of(scratch.save(signatures(docs, words, bands, rows), "sig"), scratch)
    in_band = classes.select("sid", F.posexplode("keys").alias("band", "key"))
    shared = scratch.save(in_band.groupBy("key").agg(F.min("sid").alias("least"), F.count("*").alias("n")).filter("n > 1"), "shared")
    members = scratch.save(in_band.join(shared, "key").select("key", "band", "sid", "least", "n"), "members")

    of = members.select("sid").distinct().join(classes.select("sid", "row", "digest", "sig", "n_shingles"), "sid")
    of = of.select("sid", F.col("row.doc_id").alias("row_id"), F.col("row.told").alias("row_told"), "digest", "sig", "n_shingles")
    own = told(docs).join(of, (F.col("told") == F.col("row_told")) & F.col("doc_id").eqNullSafe(F.col("row_id"))).select("sid", "digest", "text", "sig", "n_shingles")
    own = scratch.save(_own(own, words).dropDuplicates(["sid"]), "texts")
    texts, sigs = own.select("sid", "text"), own.drop("text", "digest")

    often = members.filter("sid <> least").groupBy("sid", "least").agg(F.count("*").alias("times")).groupBy("sid").agg(F.collect_list(F.struct("times", "least")).alias("stars"))
    stars = F.explode(F.slice(F.sort_array("stars", asc=False), 1, STARS))
    often = often.select("sid", F.filter("stars", lambda s: s["times"] >= MEETINGS).alias("stars"))
    tested = scratch.save(often.select(F.col("sid").alias("b"), stars.alias("star")).select(F.col("star.least").alias("a"), "b"), "tested-0")
    edges = scratch.save(_confirmed(tested, texts, words, *similarity), "edges-0")
    labels = merged(classes.select("sid", F.col("sid").alias("label")), edges, scratch, "labels-0")
    # The best few partners first; then, where components still look similar in a bucket, all the rest.
    for k, most in enumerate((FIRST, None), 1):
        labelled = scratch.save(members.join(labels, "sid").select("key", "band", "sid", "label", "n"), "labelled")
        mixed = scratch.save(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "mixed")
        again = labelled.join(mixed, "key").join(sigs, "sid").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        alike = _across(again, most, bands * rows, similarity[0] / similarity[1])
        if most:
            alike = scratch.save(alike.join(tested, ["a", "b"], "left_anti"), "tested-1")
            found = _confirmed(alike, texts, words, *similarity)
        else:
            groups = components(alike, scratch, "groups").withColumnRenamed("label", "group")
            found = _joined(scratch.save(groups.join(labels, "sid").join(sigs.select("sid", "n_shingles"), "sid"), "groups"), texts, words, *similarity)
        found = scratch.save(found, f"edges-{k}")
        if found.limit(1).count():
            labels = merged(labels, found, scratch, f"labels-{k}")
    scratch.drop("texts", "members", "shared", "labelled", "mixed", "groups")

    linked = classes.select("sid", "rep", "n").join(labels, "sid")
    least = linked.groupBy("label").agg(F.min("rep").alias("component"), F.sum("n").alias("n")).filter("n > 1")
    of_class = scratch.save(linked.select("sid", "label").join(least, "label").select(F.col("sid").alias("class"), "component"), "of-class")
    scratch.keep("of-class", *(n for n in scratch.names if n.startswith("sig")))
    out = sig.select("doc_id", "n_shingles", "sid").join(of_class, F.col("sid") == F.col("class"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _own(texts: DataFrame, words: int) -> DataFrame:
    """The rows whose text has the class they came with, and their fine signatures."""
    schema = T.StructType([*texts.schema.fields, T.StructField("fine", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            fine = [_short(signature(x, 2 * FINE, 1, seed=41)) if digest(x) == d else None for d, x in zip(t["digest"].to_pylist(), sets_of(t["text"], words))]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(fine, pa.binary())], names=[*t.schema.names, "fine"]).filter(pa.array([f is not None for f in fine], pa.bool_()))

    return texts.mapInArrow(tidy(run), schema)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, without those whose component has a smaller doc_id.

    Rows that repeat a doc_id and its text become one. Rows without a doc_id can't be told apart
    by a decision and all stay, and so do other texts under a doc_id that is kept.
    """
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    known = docs.filter(docs["doc_id"].isNotNull())
    first = known.join(kept, known["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return first.union(docs.filter(docs["doc_id"].isNull()))
