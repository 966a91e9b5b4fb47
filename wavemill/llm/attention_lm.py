"""Language-model scores of whole documents, and a counted base line.

The model reads subword ids of the lower-cased words. Ids are grouped into units (each frequent
id is one, the others share a few), and units into classes, by counts over all training
documents. A causal self-attention layer with relative positions predicts the next class; it is
trained here, in numpy: it starts on windows drawn from all parts, then each part goes on over all
its training documents, each position once, and the parts' layers are averaged. The probability
of a unit is that of its class times its share of the class, mixed with how often it follows its
predecessor.

A word's first unit is predicted in its context, among the units that can begin a word. Given
that unit, the word is either one that was counted (its discounted share of the words with that
unit), or it is spelled, unit by unit and to its end. All counts come from all training
documents. The sum over the words and the end is a log probability of the text.

Texts are scored in windows that overlap by half: each position of a window's second half is
scored once and attends to at least half a window before it.

Documents are cut into parts of bounded size where they lie, and coded once: a part's row has its
distinct words, their ids and counts, and its documents as places among them. Each later pass
reads these rows. Words are summed over parts in buckets by their hash, and the sums of words that
several parts have go back to those parts; a row is a part's words in a bucket, not a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import LARGE_ROWS, Scratch, Shipped, in_row, release, runs, split_words, text_chunks, tidy

UNITS, SHARED_UNITS, CLASSES, SHARED_CLASSES = 512, 8, 64, 16
WINDOW, STRIDE, WIDTH = 32, 16, 16
STEPS, BATCH, RATE = 500, 96, 0.01
#: Windows on which the layer starts, before it sees all documents: as many as its steps look at.
FIRST_WINDOWS = STEPS * BATCH
#: The rate and batch over all documents, and about the positions that are looked at in one piece.
LATER_RATE, LATER_BATCH, PIECE = 0.004, 256, 400_000
#: Parameters are averaged as whole multiples of one over this.
FINE = 1 << 20
#: Bytes of text of a part, about.
PART_BYTES = 8_000_000
#: Words of a bucket, over all parts, about.
BUCKET_WORDS = 500_000
#: Numbers of a block of sums that tasks send.
SENT = 512
#: Prior observations of a unit after each other one.
PRIOR = 20.0
#: What a counted word gives up for words that were never counted.
DISCOUNT = 0.75
END = 0


# --- the attention layer -----------------------------------------------------------------------


def initial(classes: int = CLASSES, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    small = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return {"query": small(classes + 1, WIDTH), "key": small(classes + 1, WIDTH), "value": small(classes + 1, WIDTH), "own": small(classes + 1, WIDTH), "near": np.zeros(WINDOW, np.float32), "out": small(WIDTH, classes), "bias": np.zeros(classes, np.float32)}


#: Distance of each of a window's inputs from each scored position; below 0 are later ones.
_AT = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_BACK, _SEEN = np.maximum(_AT, 0), (_AT >= 0).astype(np.float32)
_SCALE = np.float32(1 / np.sqrt(WIDTH))
#: The type of a class in windows.
_CLASS = np.uint8


def _tables(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a key's class for a query's one (none for padding), and of their distance (none for later ones).

    An input has no position of its own, so all attention before its norm is a product of the two.
    """
    meet = m["query"] @ m["key"].T
    meet *= _SCALE
    np.exp(np.clip(meet, -30, 30, out=meet), out=meet)
    meet[:, -1] = 0
    return meet.ravel(), np.exp(np.clip(m["near"], -30, 30)).take(_BACK) * _SEEN


def attend(m: dict[str, np.ndarray], x: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, ...]:
    """x: classes of windows, the last class for padding. Gives the places of pairs of classes, the
    attention, the values and the hidden states."""
    meet, near = tables or _tables(m)
    ask, n = x[:, WINDOW - STRIDE :], len(m["own"])
    left, right = np.ones((len(x), STRIDE, 2), np.float32), np.ones((len(x), 2, WINDOW), np.float32)
    left[:, :, 0], right[:, 1] = ask, x
    left[:, :, 0] *= n
    pair = np.matmul(left, right).astype(np.intp)  # sums of each two as a product, whole numbers far below 2**24
    a = meet.take(pair, mode="clip")
    a *= near
    a *= (1 / (np.einsum("bqk->bq", a) + np.float32(1e-30)))[..., None]
    v = m["value"].take(x, axis=0)
    h = np.matmul(a, v)
    h += m["own"].take(ask, axis=0)
    return pair, a, v, np.tanh(h, out=h)


def weights(m: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes, a row for each hidden state, and a factor of each class that they lack."""
    w = np.matmul(h, m["out"])  # window by window, as are all such products: small ones need no packing
    if (np.abs(m["out"]).sum(axis=0) + np.abs(m["bias"])).max() <= 40:  # no weight over another's factor is beyond a float
        return np.exp(w, out=w), np.exp(m["bias"])
    w += m["bias"]
    return np.exp(np.clip(w, -60, 60, out=w), out=w), np.ones_like(m["bias"])


def forward(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states of windows and, a row for each scored position, log-weights of classes."""
    h = attend(m, x)[-1]
    w, lift = weights(m, h)
    return h, (np.log(w) + np.log(lift)).reshape(-1, len(lift))


def gradient(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -log p over the scored positions, those whose target in y isn't -1."""
    pair, a, v, h = attend(m, x)
    n, classes, target = len(m["own"]), len(m["bias"]), y.ravel()
    p, lift = weights(m, h)  # weights, and below what they lack of their sum at the target
    total = np.matmul(p, lift).ravel()
    norm = np.float32(1 / max(1, np.count_nonzero(target >= 0))) / total
    norm[target < 0] = 0
    hit = np.maximum(target, 0)
    p.reshape(-1)[np.arange(0, p.size, classes) + hit] -= total / lift[hit]  # what isn't scored has no norm
    norm = norm.reshape(-1, STRIDE, 1)
    rows = np.empty((len(x), STRIDE, WIDTH + 1), np.float32)  # hidden states and a one, by the norm
    np.multiply(h, norm, out=rows[:, :, :WIDTH])
    rows[:, :, WIDTH:] = norm
    out = np.einsum("bij->ij", np.matmul(_blocks(rows).transpose(0, 2, 1), _blocks(p))) * lift
    dz = np.matmul(p, np.ascontiguousarray((m["out"] * lift).T))
    dz *= norm
    h *= h
    dz *= np.subtract(1, h, out=h)
    ds = np.matmul(dz, v.transpose(0, 2, 1))
    ds -= np.einsum("bqk,bqk->bq", a, ds)[..., None]
    ds *= a
    meet = np.bincount(pair.ravel(), ds.ravel(), n * n).reshape(n, n).astype(np.float32) * _SCALE
    g = {"query": meet @ m["key"], "key": meet.T @ m["query"], "out": out[:WIDTH], "bias": out[WIDTH]}
    g["own"] = _scatter(x[:, WINDOW - STRIDE :].ravel(), dz.reshape(-1, WIDTH), n)
    g["value"] = _scatter(x.ravel(), np.matmul(a.transpose(0, 2, 1), dz).reshape(-1, WIDTH), n)
    g["near"] = np.bincount(_BACK.ravel(), (np.einsum("bqk->qk", ds) * _SEEN).ravel(), WINDOW).astype(np.float32)
    return g


def _blocks(rows: np.ndarray) -> np.ndarray:
    """Windows' rows in blocks of eight windows, if they come to that."""
    return rows.reshape(-1, 8 * STRIDE if len(rows) % 8 == 0 else STRIDE, rows.shape[-1])


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    order, counts = np.argsort(index, kind="stable"), np.bincount(index, minlength=n)
    out, some = np.zeros((n, rows.shape[1]), np.float32), counts > 0
    if len(index):
        out[some] = np.add.reduceat(rows.take(order, axis=0), (np.cumsum(counts) - counts)[some], axis=0)
    return out


class Fit:
    """A layer's parameters, all in a row and by name, and the state of Adam."""

    def __init__(self, m: dict[str, np.ndarray]):
        self.row, self.steps = np.concatenate([v.ravel() for v in m.values()]), 0
        self.m = {k: v.reshape(m[k].shape) for k, v in zip(m, np.split(self.row, np.cumsum([v.size for v in m.values()])))}
        self.first, self.second = np.zeros_like(self.row), np.zeros_like(self.row)

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        g = gradient(self.m, x, y)
        g = np.concatenate([g[k].ravel() for k in self.m])
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.99 * self.second + 0.01 * g**2
        self.row -= rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-8)


def train(windows: np.ndarray, targets: np.ndarray, classes: int = CLASSES, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam on random batches of windows; targets of -1 are not scored."""
    fit_, r = Fit(initial(classes, seed)), np.random.default_rng(seed)
    for step in range(1, steps + 1 if len(windows) else 1):
        pick = r.integers(0, len(windows), BATCH)
        fit_.step(windows[pick], targets[pick], RATE * min(1.0, 2 * (1 - step / (steps + 1))))
    return fit_.m


def train_on_all(docs: list[np.ndarray], groups: Grouping, start: dict[str, np.ndarray], seed: int = 7) -> tuple[dict[str, np.ndarray], int]:
    """Go on from ``start`` over all documents (their ids), each position scored once; and the
    number of windows."""
    fit_, r = Fit(start), np.random.default_rng(seed)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    windows, done = int((-(-sizes // STRIDE)).sum()), 0
    pieces = np.cumsum(sizes) // PIECE
    for piece in np.unique(pieces):
        x, y = examples([docs[i] for i in np.flatnonzero(pieces == piece)], groups)
        order = r.permutation(len(x))
        for at in range(0, len(x), LATER_BATCH):
            pick = order[at : at + LATER_BATCH]
            fit_.step(x[pick], y[pick], LATER_RATE * (1 - done / windows))
            done += len(pick)
    return fit_.m, windows


def windowed(units: np.ndarray, lengths: np.ndarray, pad: int, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Windows over each document's inputs (the end, then all but the last) and the place in
    ``units`` of each scored position, -1 beyond a document.

    Inputs are laid out in rows of a stride, a row of padding before each document; a window is two.
    """
    counts = 1 - (-lengths // STRIDE)
    first = np.cumsum(counts) - counts + 1  # row of each document
    at = np.arange(len(units)) + np.repeat(first * STRIDE - (np.cumsum(lengths) - lengths), lengths)
    inputs, place = np.full(int(counts.sum()) * STRIDE, pad, units.dtype), np.full(int(counts.sum()) * STRIDE, -1)
    inputs[at[1:]] = units[:-1]
    inputs[first[lengths > 0] * STRIDE] = end
    place[at] = np.arange(len(units))
    inputs, place = inputs.reshape(-1, STRIDE), place.reshape(-1, STRIDE)
    rows = np.delete(np.arange(len(inputs)), first - 1)
    return np.concatenate([inputs[rows - 1], inputs[rows]], axis=1), place[rows]


# --- words, ids and units ------------------------------------------------------------------------


@dataclass
class Grouping:
    """unit of each id, class of each unit, and which ids begin a word."""

    unit: np.ndarray
    klass: np.ndarray
    begins: np.ndarray


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Frequent ids are units, the others share some, by frequency. Unit 0 is the end alone."""
    own = UNITS - 1 - SHARED_UNITS
    order = np.lexsort((np.arange(len(counts)), -counts))
    unit = np.zeros(len(counts), np.int32)
    unit[order[:own]] = np.arange(1, own + 1)
    rest = order[own:]
    unit[rest] = own + 1 + np.arange(len(rest)) * SHARED_UNITS // max(1, len(rest))
    return unit


def neighbours(docs: list[np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often units follow units in documents (an end before and after each), and how often
    they stand up to 8 places after them."""
    far, pad = 8, UNITS
    row = [np.full(far, pad, np.int32)]
    for d in docs:
        row += [unit[d], np.array([END] + [pad] * far, np.int32)]
    row = np.concatenate(row).astype(np.int64)
    counts = lambda a, b: np.bincount(a * (UNITS + 1) + b, minlength=(UNITS + 1) ** 2).reshape(UNITS + 1, UNITS + 1)[:UNITS, :UNITS]
    before = np.where(row[:-1] == pad, END, row[:-1])
    return counts(before, row[1:]), sum(counts(row[:-gap], row[gap:]) for gap in range(1, far + 1))


def by_company(weight: np.ndarray, company: np.ndarray, seed: int = 3, rounds: int = 15) -> np.ndarray:
    """Class of each unit: the frequent ones have their own, the others share classes with units
    that stand near the same frequent ones (k-means). Class 0 is the end alone."""
    weight = weight.astype(float)
    weight[END] = -1
    order = np.lexsort((np.arange(UNITS), -weight))[: UNITS - 1]
    own = CLASSES - 1 - SHARED_CLASSES
    klass = np.zeros(UNITS, np.int32)
    klass[order[:own]] = np.arange(1, own + 1)
    near = (company + company.T) @ np.eye(CLASSES)[klass]
    rest, near = order[own:], near[:, 1 : own + 1] + 0.05
    x = np.sqrt(near[rest] / near[rest].sum(axis=1, keepdims=True))
    centre = x[np.random.default_rng(seed).permutation(len(x))[:SHARED_CLASSES]]
    for _ in range(rounds):
        place = (x @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
        centre = np.stack([x[place == k].mean(axis=0) if (place == k).any() else centre[k] for k in range(len(centre))])
    klass[rest] = own + 1 + place
    return klass


@dataclass
class Model:
    groups: Grouping
    layer: dict[str, np.ndarray]
    in_unit: np.ndarray  # log10 of an id in its unit
    in_class: np.ndarray  # of a unit in its class
    follows: np.ndarray  # of a unit after another one
    starts: np.ndarray  # share of a unit that begins words
    words: np.ndarray  # training words by their first unit
    kinds: np.ndarray  # and distinct ones
    mix: float = 0.3  # of what follows a unit by count, against the layer

    def score(self, units: np.ndarray, lengths: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each unit, given those before it in its document, and that of any
        unit that begins a word (or of the end) at its place."""
        total, begun = np.zeros(len(units), np.float32), np.zeros(len(units), np.float32)
        start_class = np.bincount(self.groups.klass, self.in_class * self.starts, CLASSES).astype(np.float32)
        start_after = self.mix * (self.follows @ self.starts.astype(np.float32))
        klass, tables = self.groups.klass.astype(_CLASS), _tables(self.layer)
        of = klass[units]
        x, place = windowed(of, lengths, CLASSES, klass[END])
        before = np.concatenate(([END], units[:-1]))
        before[np.cumsum(lengths)[:-1]] = END
        now_after, any_after = self.mix * self.follows[before, units], start_after[before]
        for at in range(0, len(x), chunk):
            own = np.flatnonzero(place[at : at + chunk].ravel() >= 0)
            here = slice(int(place[at, 0]), int(place[at, 0]) + len(own))  # windows follow one another
            w, lift = weights(self.layer, attend(self.layer, x[at : at + chunk], tables)[-1])
            sums = w.reshape(-1, CLASSES) @ np.stack([lift, lift * start_class], axis=1)
            share = (1 - self.mix) / sums[own, 0]
            total[here] = w.reshape(-1).take(own * CLASSES + of[here]) * share * (lift[of[here]] * self.in_class[units[here]]) + now_after[here]
            begun[here] = sums[own, 1] * share + any_after[here]
        return np.log10(total).astype(float), np.log10(begun).astype(float)

    def text_scores(self, ids: np.ndarray, per_word: np.ndarray, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 probability of documents: their words' ids in a row, how many ids each word and
        how many words each document has, and each word's count in training."""
        units, lengths = with_end(ids, words, per_word, self.groups)
        single, begun = self.score(units, lengths)
        doc = np.repeat(np.arange(len(words)), words)
        close = np.cumsum(lengths) - 1
        first = np.concatenate(([0], np.cumsum(per_word)))[:-1]
        at, after = first + doc, first + doc + per_word  # places among the units, an end after each document
        run = np.concatenate(([0.0], np.cumsum(single)))
        inner = np.concatenate(([0.0], np.cumsum(self.in_unit[ids])))
        spelled = run[after] - run[at + 1] + inner[first + per_word] - inner[first] + begun[after]
        u = units[at]
        kept = np.maximum(count - DISCOUNT, 0) / np.maximum(self.words[u], 1)
        left = np.where(self.words[u] > 0, DISCOUNT * self.kinds[u] / np.maximum(self.words[u], 1), 1.0)
        with np.errstate(divide="ignore"):
            word = np.logaddexp(np.log(kept), np.log(np.minimum(left, 1.0)) + spelled * np.log(10)) / np.log(10)
        return np.bincount(doc, single[at] - begun[at] + word, len(words)) + single[close] - begun[close]


def with_end(ids: np.ndarray, words: np.ndarray, per_word: np.ndarray, groups: Grouping) -> tuple[np.ndarray, np.ndarray]:
    """Units of documents in a row with the end after each; ``words`` counts each one's words."""
    ends = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(words)]
    return np.insert(groups.unit[ids], ends, END), np.diff(np.concatenate(([0], ends))) + 1


def follow_table(pairs: np.ndarray) -> np.ndarray:
    """P(unit | unit before), drawn to the unit's own frequency where little was seen."""
    single = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    return ((pairs + PRIOR * single) / (pairs.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)


def examples(docs: list[np.ndarray], groups: Grouping) -> tuple[np.ndarray, np.ndarray]:
    """The classes of documents' windows and of what is scored in them."""
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    ends = np.cumsum(lengths - 1)
    klass = groups.klass.astype(_CLASS)
    units = np.insert(klass[groups.unit[np.concatenate(docs) if docs else np.zeros(0, np.int32)]], ends, klass[END])
    x, place = windowed(units, lengths, CLASSES, klass[END])
    return x, np.where(place >= 0, units.astype(np.int16).take(place, mode="clip"), np.int16(-1)) if len(units) else place.astype(np.int16)


def beginnings(tokenizer: str) -> np.ndarray:
    """Which ids begin a word."""
    from sentencepiece import SentencePieceProcessor

    encoder = SentencePieceProcessor(model_file=tokenizer)
    return np.array([encoder.id_to_piece(i).startswith("▁") for i in range(encoder.get_piece_size())])


def counted_model(groups: Grouping, layer: dict[str, np.ndarray], of_id: np.ndarray, pairs: np.ndarray, words: np.ndarray, kinds: np.ndarray) -> Model:
    """The model of the layer and the corpus' counts (of ids, units after units, words)."""
    of_unit = pairs.sum(axis=0) + 0.5
    total = np.maximum(np.bincount(groups.unit, of_id, UNITS), 1e-9)
    starts = np.bincount(groups.unit, of_id * groups.begins, UNITS) / total
    starts[END] = 1.0
    in_class = (of_unit / np.bincount(groups.klass, of_unit, CLASSES)[groups.klass]).astype(np.float32)
    return Model(groups, layer, np.log10(of_id / total[groups.unit]), in_class, follow_table(pairs), starts, words, kinds)


# --- the corpus ----------------------------------------------------------------------------------


_PART = "part long, doc_id array<long>, held binary, n_words binary, places binary, ids binary, n_ids binary, keys binary, counts binary, ends long, windows long, words long"


def _planes(x: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32 as planes of bytes, as many as the largest needs; first how many."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 4), np.uint8)
    whole[:, : len(planes)] = planes.T
    return whole.view("<u4").ravel().astype(np.int64)


@dataclass
class Part:
    """A stretch of the corpus: its documents as places in its distinct words, and those words' ids."""

    held: np.ndarray
    n_words: np.ndarray  # of each document
    places: np.ndarray  # of all documents' words, in a row
    flat: np.ndarray  # ids of all distinct words in a row
    starts: np.ndarray  # where each word's begin

    @staticmethod
    def read(row: dict) -> Part:
        flat, counts = _from_planes(row["ids"]), _from_planes(row["n_ids"])
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        return Part(held, _from_planes(row["n_words"]), _from_planes(row["places"]), flat, np.concatenate(([0], np.cumsum(counts))))

    def documents(self, most: int = 100_000, training: bool = True, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of documents (of at most so many words, or one): their words' places, how many words
        each has, all their ids, and how many ids each word has."""
        ends = np.cumsum(self.n_words)
        if which is None:
            which = np.flatnonzero(~self.held) if training else np.arange(len(ends))
        for a, b in runs(self.n_words[which], most):
            some = which[a:b]
            n = self.n_words[some]
            places = np.concatenate([self.places[e - k : e] for e, k in zip(ends[some], n)])
            yield places, n, *in_row(places, self.flat, self.starts)

    def windows(self) -> np.ndarray:
        """How many windows each document has."""
        run, ends = np.concatenate(([0], np.cumsum(np.diff(self.starts)[self.places]))), np.cumsum(self.n_words)
        return -(-(run[ends] - run[ends - self.n_words] + 1) // STRIDE)

    def training_ids(self, most: int = 100_000, which: np.ndarray | None = None) -> Iterator[list[np.ndarray]]:
        """Runs of training documents' ids, or those of some documents."""
        for _, n, ids, per_word in self.documents(most, which=which):
            yield np.split(ids, np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(n)][:-1])


def made_part(part: int, doc_id: pa.Array, held: pa.Array, text: pa.Array, encoder) -> dict:
    """A row of ``_PART``: counts are of training documents only."""
    import xxhash

    n_words, places, words = split_words(pc.ascii_lower(text))
    flat, n_ids, words = [], [], words.to_numpy(zero_copy_only=False).tolist()
    for at in range(0, len(words), 10_000):
        some = [ids or [encoder.unk_id()] for ids in encoder.encode(words[at : at + 10_000], num_threads=1)]
        n_ids.append(np.fromiter(map(len, some), np.int64, len(some)))
        flat.append(np.fromiter(chain.from_iterable(some), np.int64, int(n_ids[-1].sum())))
    n_ids, flat = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_ids, flat))
    out = held.to_numpy(zero_copy_only=False).astype(bool)
    counts = np.bincount(places[np.repeat(~out, n_words)], minlength=len(words))
    run = np.concatenate(([0], np.cumsum(n_ids[places])))
    ends = np.cumsum(n_words)
    lengths = run[ends] - run[ends - n_words] + 1
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return {
        "part": part, "doc_id": doc_id.to_pylist(), "held": out.astype(np.uint8).tobytes(), "n_words": _planes(n_words), "places": _planes(places), "ids": _planes(flat), "n_ids": _planes(n_ids),
        "keys": keys.tobytes(), "counts": _planes(counts), "ends": int((~out).sum()), "windows": int((-(-lengths[~out] // STRIDE)).sum()), "words": len(words),
    }


def parts(docs: DataFrame, tokenizer: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents in parts of about so many bytes, as they lie: no shuffle, so no key is hot."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", held.alias("held"), "text")
    schema = to_arrow_schema(StructType.fromDDL(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from sentencepiece import SentencePieceProcessor

        encoder, place = SentencePieceProcessor(model_file=tokenizer), TaskContext.get().partitionId() << 24
        waiting, size = [], 0

        def done() -> pa.RecordBatch:
            columns = [pa.concat_arrays([b.column(c) for b in waiting]) for c in ("doc_id", "held", "text")]
            return pa.RecordBatch.from_pylist([made_part(place, *columns, encoder)], schema=schema)

        for t in batches:
            for a, b in text_chunks(t["text"], part_bytes):
                waiting.append(t.slice(a, b - a))
                size += pc.sum(pc.binary_length(t["text"][a:b])).as_py() or 0
                if size >= part_bytes // 2:
                    yield done()
                    waiting, size, place = [], 0, place + 1
        if waiting:
            yield done()

    return rows.mapInArrow(tidy(run), _PART)


def each_part(table: DataFrame, schema: str, f: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``f`` over a task's parts, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(t.slice(i, 1).to_pylist()[0] for t in batches for i in range(t.num_rows))

    return table.mapInArrow(tidy(run), schema)


def word_blocks(table: DataFrame, buckets: int) -> DataFrame:
    """A row for each part's distinct words in each bucket (by ranges of their keys): the keys in
    order, their places in the part, first ids and training counts."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            keys, counts, starts = np.frombuffer(r["keys"], np.uint64), _from_planes(r["counts"]), np.cumsum(_from_planes(r["n_ids"]))
            first = _from_planes(r["ids"])[np.concatenate(([0], starts[:-1]))] if len(keys) else counts
            order = np.argsort(keys)
            keys, first, counts = keys[order], first[order], counts[order]
            cuts = np.append(np.searchsorted(keys, edges), len(keys))
            some = np.flatnonzero(np.diff(cuts))
            planes = [pa.array([f(x[a:b]) for a, b in zip(cuts[some], cuts[some + 1])], pa.binary()) for x, f in ((keys, np.ndarray.tobytes), (order, _planes), (first, _planes), (counts, _planes))]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), r["part"])), *planes], names=["bucket", "part", "keys", "places", "firsts", "counts"])

    return each_part(table.select("part", "ids", "n_ids", "keys", "counts"), "bucket long, part long, keys binary, places binary, firsts binary, counts binary", run)


def _merged(keys: np.ndarray, first: np.ndarray, n: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with its first id and the sums of its counts and parts."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], first[order][at], np.add.reduceat(n[order], at), np.add.reduceat(parts[order], at)


def word_totals(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket: the keys of training words that several parts hold, in order, and their
    counts in all; and the first ids of all its training words, with their counts and how many they are.

    A task holds a bucket's distinct words, and of those that are yet to be added at most as many or
    ``BUCKET_WORDS``.
    """

    def row(bucket: int, waiting: list) -> pa.RecordBatch:
        keys, first, n, parts = _merged(*map(np.concatenate, zip(*waiting)))
        several, known = (n > 0) & (parts > 1), n > 0
        ids, which = np.unique(first[known], return_inverse=True)
        sums = np.zeros(len(ids), np.int64)
        np.add.at(sums, which, n[known])
        values = [keys[several], n[several], ids, sums, np.bincount(which, minlength=len(ids))]
        return pa.RecordBatch.from_arrays([pa.array([bucket]), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["bucket", "keys", "totals", "firsts", "sums", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, size, most = None, [], 0, BUCKET_WORDS
        for t in batches:
            for b, keys, first, n in zip(*(t[c].to_pylist() for c in ("bucket", "keys", "firsts", "counts"))):
                if waiting and b != bucket:
                    yield row(bucket, waiting)
                    waiting, size, most = [], 0, BUCKET_WORDS
                keys = np.frombuffer(keys, np.uint64)
                waiting.append((keys, _from_planes(first), _from_planes(n), np.ones(len(keys), np.int64)))
                bucket, size = b, size + len(keys)
                if size > 2 * most:
                    waiting = [_merged(*map(np.concatenate, zip(*waiting)))]
                    size = len(waiting[0][0])
                    most = max(BUCKET_WORDS, size)
        if waiting:
            yield row(bucket, waiting)

    dealt = blocks.select("bucket", "keys", "firsts", "counts").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(run), "bucket long, keys binary, totals binary, firsts binary, sums binary, kinds binary")


def words_back(blocks: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """part, places, totals: words that several parts hold, for each of those and each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sums = None
        for t in batches:
            for part, mine, places, told in zip(*(t[c].to_pylist() for c in ("part", "keys", "places", "totals"))):
                mine = np.frombuffer(mine, np.uint64)
                if part is None:  # the bucket's sums come before its parts
                    keys, sums = mine, np.frombuffer(told, np.int64)
                elif len(keys):
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    found = keys[at] == mine
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_planes(_from_planes(places)[found])], pa.binary()), pa.array([sums[at[found]].tobytes()], pa.binary())], names=["part", "places", "totals"])

    both = blocks.select("bucket", "part", "keys", "places").unionByName(totals.select("bucket", "keys", "totals"), allowMissingColumns=True)
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("part")).mapInArrow(tidy(run), "part long, places binary, totals binary")


def summed(table: DataFrame, size: int, columns: list[str], add: Callable[[np.ndarray, dict], None]) -> np.ndarray:
    """Whole numbers that ``add`` sums up over all parts: tasks send them in blocks, those that are
    not all zero, at most ``size`` numbers, whatever the corpus."""

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for r in rows:
            add(sums, r)
        some = [k for k in range(0, size, SENT) if sums[k : k + SENT].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([sums[k : k + SENT].tobytes() for k in some], pa.binary())], names=["at", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}  # of the upper and lower halves, so that whole numbers may be of any size
        for t in batches:
            for k, n in zip(t["at"].to_pylist(), t["n"].to_pylist()):
                n = np.frombuffer(n, np.int64)
                upper, lower = sums.setdefault(k, np.zeros((2, len(n)), np.int64))
                upper += n >> 32
                lower += n & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "n"])

    got = each_part(table.select(*columns), "at long, n binary", run).repartition("at").mapInArrow(tidy(total), "at long, n binary").toPandas()
    sums = np.zeros(size)
    for k, n in zip(got["at"], got["n"]):
        upper, lower = np.frombuffer(n, np.int64).reshape(2, -1).astype(float)
        sums[k : k + len(upper)] = upper * 2.0**32 + lower
    return sums


_TEXTS = ["part", "held", "n_words", "places", "ids", "n_ids"]


def id_counts(table: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in training documents."""

    def add(sums: np.ndarray, r: dict) -> None:
        weights = np.repeat(_from_planes(r["counts"]), _from_planes(r["n_ids"]))
        sums += np.bincount(_from_planes(r["ids"]), weights, size).astype(np.int64)  # exact below 2**53

    return summed(table, size, ["counts", "ids", "n_ids"], add)


def first_counts(totals: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How often training words begin with each id, and how many distinct ones do."""

    def add(sums: np.ndarray, r: dict) -> None:
        ids, n, kinds = (np.frombuffer(r[c], np.int64) for c in ("firsts", "sums", "kinds"))
        sums[ids] += n
        sums[size + ids] += kinds

    return tuple(summed(totals, 2 * size, ["firsts", "sums", "kinds"], add).reshape(2, size))


def neighbour_counts(table: DataFrame, unit: Shipped) -> tuple[np.ndarray, np.ndarray]:
    """``neighbours`` of all training documents."""

    def add(sums: np.ndarray, r: dict) -> None:
        u = unit.value.astype(np.int32)
        for docs in Part.read(r).training_ids(400_000):
            for at, n in enumerate(neighbours(docs, u)):
                sums[at * UNITS * UNITS : (at + 1) * UNITS * UNITS] += n.ravel()

    return tuple(summed(table, 2 * UNITS * UNITS, _TEXTS, add).reshape(2, UNITS, UNITS))


def drawn(part: Part, groups: Grouping, draw: np.random.Generator, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """About a share of the training documents' windows and targets, and the chance of each;
    documents that none is drawn from are not put together."""
    train = np.flatnonzero(~part.held)
    doc = np.repeat(train, part.windows()[train])
    chance = draw.random(len(doc))
    some = np.unique(doc[chance < share])
    chance, at = chance[np.isin(doc, some)], 0
    for docs in part.training_ids(which=some):
        x, y = examples(docs, groups)
        take = np.flatnonzero(chance[at : at + len(x)] < share)
        yield chance[at + take], x[take], y[take]
        at += len(x)


def first_windows(table: DataFrame, groups: Shipped, total: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``wanted`` windows and targets drawn evenly from all parts, at most so many."""
    share = min(1.0, 3 * wanted / max(1, total))

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        g = groups.value
        for r in rows:
            draw = np.random.default_rng(r["part"])
            for chance, x, y in drawn(Part.read(r), g, draw, share):
                yield pa.RecordBatch.from_arrays([pa.array(chance), pa.array([v.tobytes() for v in x.astype(np.int16)], pa.binary()), pa.array([v.tobytes() for v in y.astype(np.int16)], pa.binary())], names=["chance", "x", "y"])

    got = each_part(table.select(*_TEXTS), "chance double, x binary, y binary", run).orderBy("chance", "x", "y").limit(wanted).toPandas()
    read = lambda c, width: np.frombuffer(b"".join(got[c]), np.int16).reshape(-1, width)
    return read("x", WINDOW).astype(_CLASS), read("y", STRIDE).astype(np.int16)


def fit_on_all(table: DataFrame, groups: Grouping, total: int, first: int = FIRST_WINDOWS) -> dict[str, np.ndarray]:
    """The attention layer: a start on windows from all parts, then all training documents of each
    part, and the mean of the parts' layers by their windows, summed as whole numbers."""
    spark, shared = table.sparkSession, Shipped(table.sparkSession, groups)
    start = train(*first_windows(table, shared, total, first))
    begin, names = Shipped(spark, start), list(start)
    size = sum(v.size for v in start.values())

    def add(sums: np.ndarray, r: dict) -> None:
        m, n = train_on_all(list(chain.from_iterable(Part.read(r).training_ids())), shared.value, begin.value)
        sums[:size] += np.rint(np.concatenate([m[k].ravel() for k in names]).astype(float) * FINE).astype(np.int64) * n
        sums[size] += n

    sums = summed(table, size + 1, _TEXTS, add)
    if not sums[size]:
        return start
    mean, at = sums[:size] / sums[size] / FINE, np.cumsum([0, *(v.size for v in start.values())])
    return {k: mean[a : a + start[k].size].reshape(start[k].shape).astype(np.float32) for k, a in zip(names, at)}


def score(docs: DataFrame, tokenizer: str, part_bytes: int = PART_BYTES, first: int = FIRST_WINDOWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each input row.

    Documents whose crc32 of the id (as text) is divisible by 10 are held out; a null id never
    is. Null texts are empty: the end is their only token. Rows that repeat count and are scored
    each. An empty table gives an empty result; with no training document nothing is known, and
    the base score is that of an unseen token alone. Other columns are not read. Words are told
    apart by a 64-bit hash.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    table = scratch.save(parts(docs, tokenizer, part_bytes), "parts", "zstd", **LARGE_ROWS)  # zstd's buffers stay small for long values
    n_parts, ends, windows, n_words = (int(v or 0) for v in table.select(F.count("*"), F.sum("ends"), F.sum("windows"), F.sum("words")).first())
    buckets = max(1, -(-n_words // BUCKET_WORDS))
    blocks = word_blocks(table, buckets)
    totals = scratch.save(word_totals(blocks, buckets), "totals", **LARGE_ROWS)

    begins = beginnings(tokenizer)
    by_first = first_counts(totals, len(begins))
    kinds, tokens = (int(v.sum()) for v in by_first[::-1])
    n_train, vocabulary = tokens + ends, kinds + (ends > 0)
    of_id = id_counts(table, len(begins))
    unit = by_frequency(of_id)
    pairs, company = neighbour_counts(table, Shipped(spark, unit))
    groups = Grouping(unit, by_company(pairs.sum(axis=0), company), begins)
    layer = fit_on_all(table, groups, windows, first)
    words_by, kinds_by = (np.bincount(unit, v, UNITS) for v in by_first)
    model = Shipped(spark, counted_model(groups, layer, of_id + 0.5, pairs, words_by, kinds_by))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(texts: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for r in texts.drop_columns(["doc_id"]).to_pylist():
            m, part, c = model.value, Part.read(r), _from_planes(r["counts"])
            for places, sums in zip(others["places"].to_pylist(), others["totals"].to_pylist()):  # words of this part alone have its own counts
                c[_from_planes(places)] = np.frombuffer(sums, np.int64)
            bottom = np.log10(n_train + 0.1 * (vocabulary + 1))
            logs, end_log = np.log10(c + 0.1) - bottom, np.log10(ends + 0.1) - bottom
            for places, n, ids, per_word in part.documents(training=False):
                doc = np.repeat(np.arange(len(n)), n)
                base = np.bincount(doc, logs[places], len(n)) + end_log
                out.append(np.stack([n + 1, np.bincount(doc, c[places] > 0, len(n)) + (ends > 0), base, m.text_scores(ids, per_word, n, c[places])]))
        got = np.concatenate([np.zeros((4, 0)), *out], axis=1)
        doc_ids = pa.chunked_array([c.flatten() for c in texts["doc_id"].chunks], pa.int64())
        held = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(h, np.uint8) for h in texts["held"].to_pylist())]).astype(bool)
        release()
        whole = [pa.array(got[k].astype(np.int64)) for k in (0, 1)]
        return pa.table([doc_ids, pa.array(held), *whole, pa.array(np.full(len(held), n_train)), pa.array(got[2]), pa.array(got[3])], schema=schema)

    # A word goes back to the parts that hold it, unless it is in one alone.
    back = words_back(blocks, totals.select("bucket", "keys", "totals"), buckets)
    dealt = table.select(*_TEXTS, "doc_id", "counts").repartition(max(1, n_parts), "part")
    return dealt.groupBy("part").cogroup(back.repartition(max(1, n_parts), "part").groupBy("part")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
