"""Sum-of-squares packing of tokenised documents into sequences.

A document is its ids and one end id; only documents longer than a sequence are cut, into full
pieces and a rest. A piece goes into the open sequence (or a new one) that makes the sum over all
residual gaps g of (open sequences with gap g) squared smallest, so that no gap piles up.

Pieces are dealt to shards by a hash, so that a shard is a bounded task at any input size. Open
sequences that fit into others' gaps then move there as they are. What a shard leaves half full is
taken out and packed again with that of other shards, in ever fewer shards, until one is left or
nothing is gained.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, in_row, split_words, text_chunks, tidy

CAPACITY = 2048
#: Bytes of text whose words are coded at once.
TEXT_BYTES = 4_000_000
#: Pieces of a shard, about.
SHARD = 16_384
#: Sequences with a larger gap are opened again and packed with other shards' ones.
LOOSE = 16


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    Pieces over an eighth of a sequence come first, from the largest; then smaller ones in mixed
    order, so that all kinds of gaps meet all sizes; the smallest twentieth fills what is left.
    """
    order = np.argsort(-sizes, kind="stable")
    large, last = int((sizes > capacity // 8).sum()), int(len(sizes) * 0.95)
    if large < last:
        order[large:last] = np.random.default_rng(len(sizes)).permutation(order[large:last])
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    none = np.iinfo(np.int64).max
    for i in order:
        s = int(sizes[i])
        gap = capacity
        if s < capacity:
            # A bin of gap g adds 2 (N(g - s) - N(g)) + 2 to the sum, a new one 2 N(capacity - s) + 1;
            # full bins do not count, so one that becomes full adds 1 - 2 N(s): it comes first of equal ones.
            cost = count[: capacity - s] - count[s:capacity]
            cost[0] = -count[s]
            cost[count[s:capacity] == 0] = none
            best = int(cost.argmin())
            if cost[best] < count[capacity - s]:
                gap = best + s
        if gap < capacity:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b = opened
            opened += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets


def closed_up(sizes: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The same, after open bins moved as they are into the smallest gap of another one that holds them.

    The rule of squares keeps open bins of every gap for what may come; nothing more comes.
    """
    fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    to, shift = np.arange(len(fill)), np.zeros(len(fill), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    for b in np.argsort(-fill, kind="stable"):
        f = int(fill[b])
        gap = f + int(some[f:].argmax())
        if some[gap]:
            to[b] = by_gap[gap].pop()
            shift[b], left = capacity - gap, gap - f
            some[gap] = bool(by_gap[gap])
        else:
            left = capacity - f
        by_gap[left].append(int(to[b]))
        some[left] = left > 0
    return np.unique(to, return_inverse=True)[1][bins], offsets + shift[bins]


#: A word of Latin letters whose lower case the tokenizer's normaliser leaves alone, then ASCII signs
#: but the apostrophe.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


class Recent:
    """Values by key, the latest two generations of at most ``limit`` (and one call's) entries."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def values(self, keys: list, compute) -> list:
        """The values of distinct keys; ``compute`` gives those of a list of unknown ones."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        got = list(map(self.now.get, keys))
        away = [i for i, v in enumerate(got) if v is None]
        if away and self.old:
            for i in away:
                got[i] = self.old.get(keys[i])
        lacking = [i for i in away if got[i] is None]
        for i, v in zip(lacking, compute([keys[i] for i in lacking]) if lacking else ()):
            got[i] = v
        self.now.update((keys[i], got[i]) for i in away)
        return got


class WordIds:
    """Ids of words without ASCII white space, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins text across it, so a document's ids are its
    words' ids in a row. Most words are letters and then signs, which the tokenizer parts; their
    letters are lower-cased here and go through its merges many at a time, a mark between them.
    All other words go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 80_000):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}))
        self.letters = _byte_letters() | {32: 32}
        self.mark_id = self.merges.encode(chr(self.letters[1])).ids[0]
        self.letter_runs, self.others = Recent(limit), Recent(limit)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def _merged(self, words: list[str], most: int = 1000) -> list[bytes]:
        out = []
        for at in range(0, len(words), most):
            text = " \x01 ".join(words[at : at + most]).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])]
        return out

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin (and the last one's end)."""
        plain = pc.extract_regex(words, _PLAIN)
        told = pc.is_valid(plain)
        letters = pc.utf8_lower(pc.struct_field(plain, "letters")).filter(told).dictionary_encode()
        signs = pc.struct_field(plain, "signs").filter(told).dictionary_encode()
        odd = words.filter(pc.invert(told))
        parts = [
            *self.letter_runs.values(letters.dictionary.to_pylist(), self._merged),
            *self.others.values(signs.dictionary.to_pylist(), self._whole),
            *self.others.values(odd.to_pylist(), self._whole),
        ]
        n_letters, n_signs = len(letters.dictionary), len(signs.dictionary)
        is_plain = told.to_numpy(zero_copy_only=False)
        row = np.full((len(words), 2), len(parts), np.int64)  # the last part has no ids
        row[is_plain, 0] = letters.indices.to_numpy()
        row[is_plain, 1] = n_letters + signs.indices.to_numpy()
        row[~is_plain, 0] = n_letters + n_signs + np.arange(len(odd))
        ids, counts = in_row(row.ravel(), np.frombuffer(b"".join(parts), "<u4"), _starts([*map(len, parts), 0], 4))
        return ids, _starts(counts.reshape(-1, 2).sum(axis=1))


def _starts(counts, unit: int = 1) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64) // unit)))


def document_ids(text: pa.Array, ids: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts in a row, each with the end id after it, and where each one's begin."""
    counts, places, words = split_words(text)
    flat, starts = ids.of(words)
    row = np.insert(places.astype(np.int64), np.cumsum(counts), len(words))  # an end after each text's words
    got, per_word = in_row(row, np.append(flat, np.uint32(end_id)).astype("<u4"), np.append(starts, starts[-1] + 1))
    run = _starts(per_word)
    return got, run[np.concatenate(([0], np.cumsum(counts + 1)))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row (null text: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, step = WordIds(tokenizer), 4 * capacity
        for t in batches:
            for begin, end in text_chunks(t["text"], TEXT_BYTES):
                got, starts = document_ids(t["text"][begin:end], ids, end_id)
                data, rows = got.tobytes(), []
                for doc_id, a, b in zip(t["doc_id"][begin:end].to_pylist(), (4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist()):
                    rows += [(doc_id, (at - a) // step, (at - a) // 4, (min(b, at + step) - at) // 4, zlib.crc32(data[at : min(b, at + step)])) for at in range(a, b, step)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return documents(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(table: DataFrame, scratch: Scratch, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The rows of ``table`` (with a ``length``) and their sequence_id and offset.

    ``shard``, ``filled``, ``sequence_id`` and ``offset`` are names of this function's own.
    """
    schema = f"{', '.join(f'{n} {t}' for n, t in table.dtypes)}, sequence_id long, offset long, filled long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(level: int):
        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(list(pdf.columns), ignore_index=True)
            sizes = pdf["length"].to_numpy(np.int64)
            bins, pdf["offset"] = closed_up(sizes, *sum_of_squares(sizes, capacity), capacity)
            pdf["filled"] = np.bincount(bins, weights=sizes).astype(np.int64)[bins] if len(bins) else bins
            pdf["sequence_id"] = (level << 56) + (pdf["shard"].to_numpy(np.int64) << 24) + bins
            return pdf[names]

        return packed

    done, rest, loose, before = None, scratch.save(table, "pieces-0"), None, 0
    shards = max(1, -(-rest.count() // shard))
    for level in range(64):
        # Rows that repeat go to different shards by their place in the written table.
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(*table.columns, F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)))
        out = scratch.save(dealt.groupBy("shard").applyInPandas(run(level), schema), f"packed-{level}")
        if loose is not None and out.select("sequence_id").distinct().count() >= before:
            done = done.union(loose)  # nothing was gained: what can't be filled stays as it was
            break
        loose = out.filter(F.col("filled") < capacity - LOOSE)
        n = loose.count() if shards > 1 else 0
        keep = out.filter(F.col("filled") >= capacity - LOOSE) if n else out
        done = keep if done is None else done.union(keep)
        if not n:
            break
        before = loose.select("sequence_id").distinct().count()
        rest, shards = loose.select(table.columns), -(-n // shard)
    else:
        done = done.union(loose)
    return done.drop("filled")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A null text is empty and has the end id alone. Rows that repeat are packed each on its own.
    An empty table gives an empty result. Other columns than doc_id and text are not read.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), Scratch(docs.sparkSession), capacity)
