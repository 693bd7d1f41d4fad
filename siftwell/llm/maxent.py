"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Frequent words are
classes of their own; every other word falls into a class by its shape (what follows
its letters, and a hash of its last two bytes).

P(class | history) is a log-linear model over three hashed features: the last word's
class, the class before it (a skip feature) and the pair of both (an n-gram feature).
The corpus is reduced once to counts of (history, class), at most 7 million cells;
every gradient is computed from those counts in parallel.

P(word | class, history) is log-linear over hashed features of whole words, whose
number grows with the corpus: the last word with this one (n-gram), and, where the
last word was never seen before this class, the one before it with this one (skip).
It is the distribution nearest to the class's unigrams, in the sense of maximum
entropy, under which each seen feature is expected as often as it was counted, less a
discount d, plus the unigram's share of what all discounts freed:

    E[f(history, w)] = c - d + d t p(w),   n tokens, t distinct words of the class behind the history

The features of one history exclude each other, so the gradient (this target less the
expectation) is zero at once at exp(weight) = 1 + (c - d) / (d t p(w)), Z = n / (d t);
that is the one update this part needs, computed where a history's counts meet.

Word and feature counts stay distributed. Texts are encoded once, into blocks with a
vocabulary each. A block sends each part of the hash space one sorted, compressed list
of its distinct keys with their counts; a part sums them and sends back what was asked
for, in the same order. No key occurs twice in a block, so none makes a hot key; what
frequent words precede is dealt by the whole feature, and their few sums are added up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, prepare, utf8

HEAD, TAIL = 128, 64
CLASSES = HEAD + TAIL
START = CLASSES
HISTORY = CLASSES + 1
PAIRED = 4096
#: Share of the training tokens that a head word has at least, as one over this.
FREQUENT = 20_000
#: Text bytes of a block.
BLOCK = 4 << 20
ADD = 0.1
#: Keys of a part of the hash space, about, and the number of parts at least.
PART, PARTS = 4_000_000, 64
#: Bits of a key: 36 of a context (any last word but a frequent one, and a class) and 20
#: of a word; or, behind a frequent word, 46 of both and 16 of the context's number.
CONTEXT, WORD, WIDE = 36, 20, 16
NARROW_BITS, WIDE_BITS = CONTEXT + WORD, 46 + WIDE
NGRAM, SKIP = 0, 1
SYMBOLS = b"#$%&*|<>"
#: The end of a text: the only token with white space, so no word's hash stands for it by rule.
END = xxhash.xxh64_intdigest(b"\n", 42)
#: The counts of histories are dealt to so many gradient tasks; each returns 3.4 MB. It
#: goes through so many histories at a time.
GRADIENT_TASKS, TOGETHER = 4, 4096

BLOCKS = "block long, ids array<long>, held binary, lengths binary, vocabulary binary, seen binary, tail binary, codes binary, tokens long, train long, words long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, class_score double"


def tail_class(word: bytes) -> int:
    """The shape class of a word that is no head word."""
    base = word.rstrip(b".,;:!?)]}\"'" + SYMBOLS)
    after = word[len(base) : len(base) + 1]
    if after and after in SYMBOLS:
        return SYMBOLS.index(after)
    kind = zlib.crc32(base[-2:])
    return 8 + kind % 16 if after else 24 + kind % 40


def pack(codes: np.ndarray) -> bytes:
    """Codes byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal lengths, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def expand(blob: bytes, *kinds: str) -> list[np.ndarray]:
    types = [np.dtype(k) for k in kinds]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _parts(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Bounds in sorted keys of ``width`` bits of the 2 ** bits parts, by leading bits."""
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist() + [len(keys)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list[bool] = []
    codes: list[np.ndarray] = []
    size = 0
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__

    def block() -> pa.RecordBatch:
        names = list(index)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64)
        tails = np.array([tail_class(w) for w in names], np.uint8)
        lengths = np.array([len(c) for c in codes], np.int32)
        flat = np.concatenate(codes)
        train = ~np.repeat(np.array(held), lengths)
        seen = np.bincount(flat[train], minlength=len(names)).astype(np.int32)
        values = (task << 16 | number, ids, np.array(held).tobytes(), lengths.tobytes(), hashes.tobytes(), seen.tobytes(), tails.tobytes(), pack(flat), len(flat), int(train.sum()), len(names))
        kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, *[pa.int64()] * 3)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    for batch in batches:
        for doc, out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = text.lower().split()
            words.append(b"\n")
            codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            held.append(out)
            size += len(text) + 16
            if size >= BLOCK:
                yield block()
                ids, held, codes, size, number = [], [], [], 0, number + 1
                index.clear()
    if ids:
        yield block()


DEALT = "part int, block long, payload binary"
TOTALS = "block long, part int, payload binary, word long, tail int, n long, t long"
#: Rows of totals that are no answer to a block.
CANDIDATE, BY_TAIL, CONTEXT_SUM, REPEATS = -1, -2, -3, -4


def _dealt(block: int, keys: np.ndarray, bits: int, width: int, more: list[np.ndarray], first: int = 0) -> list[tuple]:
    """Rows of DEALT: sorted keys and what belongs to them, by part (numbered from ``first``)."""
    bounds, gaps = _parts(keys, bits, width), None
    out = []
    for part, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if i < j:
            gaps = _gaps(keys[i:j])
            out.append((first + part, block, squeeze(gaps, *(m[i:j] for m in more))))
    return out


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _vocabulary(bits: int):
    """Deal the words of blocks: hash, training tokens, shape class."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v, s, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h = np.frombuffer(v, np.uint64)
                order = np.argsort(h)
                yield _rows(_dealt(block, h[order], bits, 64, [np.frombuffer(s, np.int32)[order], np.frombuffer(t, np.uint8)[order]]), DEALT)

    return dealt


def _meet(table: pa.Table, *kinds: str) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
    """Distinct keys of a part, every entry's place among them, bounds of the blocks' entries, and the rest."""
    own = [expand(p, "<u8", *kinds) for p in table["payload"].to_pylist()]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in own]
    bounds = [0, *np.cumsum([len(k) for k in keys]).tolist()]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, at, bounds, [np.concatenate([x[1 + k] for x in own]) for k in range(len(kinds))]


def _count_words(tokens: int):
    """Sum the words of a part: each block's totals, words that may be heads, and sums by shape class."""

    def counted(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        words, at, bounds, (seen, tails) = _meet(table, "<i4", "u1")
        total = np.bincount(at, seen, len(words)).astype(np.int64)
        tail = np.zeros(len(words), np.int64)
        tail[at] = tails
        rows = [(b, part, squeeze(total[at[i:j]]), None, None, None, None) for b, i, j in zip(table["block"].to_pylist(), bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero((total > 0) & (total * FREQUENT >= tokens)).tolist():
            rows.append((CANDIDATE, part, None, int(words[k].astype(np.int64)), int(tail[k]), int(total[k]), 1))
        n, t = np.bincount(tail, total, TAIL), np.bincount(tail[total > 0], minlength=TAIL)
        rows += [(BY_TAIL, part, None, None, k, int(n[k]), int(t[k])) for k in range(TAIL)]
        return pa.Table.from_batches([_rows(rows, TOTALS)])

    return counted


class Tokens:
    """A block's tokens with their classes and the keys of their word features."""

    def __init__(self, row: dict, head: np.ndarray):
        self.hashes, tails = np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["tail"], np.uint8)
        self.of = _word_classes(self.hashes, tails, head)
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        self.codes = unpack(row["codes"])
        self.classes = self.of[self.codes]
        self.held = np.repeat(np.frombuffer(row["held"], bool), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.flatnonzero(self.classes >= HEAD)

    def previous(self, relation: int) -> np.ndarray:
        """The code of the last word, or of the one before it; -1 before the text."""
        out = np.concatenate([[-1], self.codes[:-1]])
        out[self.starts] = -1
        if relation == SKIP:
            out = np.concatenate([[-1], out[:-1]])
            out[self.starts] = -1
        return out

    def features(self, relation: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the tokens ``at``: whether a frequent word (or none) is before them, and their keys."""
        before, word, tail = self.previous(relation)[at], self.hashes[self.codes[at]], (self.classes[at] - HEAD).astype(np.uint64)
        left = np.where(before < 0, HEAD, self.of[before])
        wide = left <= HEAD - (before >= 0)
        out = np.empty(len(at), np.uint64)
        number = (np.uint64(relation * (HEAD + 1)) + left[wide].astype(np.uint64)) * np.uint64(TAIL) + tail[wide]
        out[wide] = mix(word[wide] + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WIDE_BITS + WIDE) << np.uint64(WIDE) | number
        context = mix(self.hashes[before[~wide]] + (tail[~wide] + np.uint64(1 + relation * TAIL)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CONTEXT)
        out[~wide] = context << np.uint64(WORD) | word[~wide] >> np.uint64(64 - WORD)
        return wide, out


def _features(head: np.ndarray, bits: int):
    """Deal the word features of blocks: key, training tokens, and whether the block wants the total.

    Skip features are wanted for held-out texts alone: behind a training token's last word
    its class was seen, by itself at least.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                t = Tokens(row, head)
                held, both = t.held[t.at], [t.features(r, t.at) for r in (NGRAM, SKIP)]
                rows = []
                for kind, width in ((False, NARROW_BITS), (True, WIDE_BITS)):
                    keys = []
                    for relation, (wide, key) in enumerate(both):
                        own = wide == kind
                        wanted = held[own] if relation == SKIP else np.ones(int(own.sum()), bool)
                        keys.append(key[own] << np.uint64(2) | wanted.astype(np.uint64) << np.uint64(1) | ~held[own])
                    flat = np.sort(np.concatenate(keys))
                    if not len(flat):
                        continue
                    key = flat >> np.uint64(2)
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    seen = np.add.reduceat((flat & np.uint64(1)).astype(np.int32), first, dtype=np.int32)
                    wanted = np.maximum.reduceat((flat >> np.uint64(1) & np.uint64(1)).astype(np.uint8), first)
                    rows += _dealt(row["block"], key[first], bits, width, [seen, wanted], kind << bits)
                yield _rows(rows, DEALT)

    return dealt


def _count_features(bits: int):
    """Sum the features of a part and answer the blocks: a feature's tokens and, where all of
    its context is in this part, the context's tokens and distinct words; else those are
    summed over the parts by the context's number."""

    def counted(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, at, bounds, (seen, wanted) = _meet(table, "<i4", "u1")
        total = np.bincount(at, seen, len(keys)).astype(np.int64)
        known, rows = total > 0, []
        if part >> bits:
            of = (keys & np.uint64((1 << WIDE) - 1)).astype(np.int64)
            n, t = np.bincount(of, total), np.bincount(of[known])
            rows = [(CONTEXT_SUM, part, None, k, None, int(n[k]), int(t[k])) for k in np.flatnonzero(n).tolist()]
            answer = [total]
        else:
            context = keys >> np.uint64(WORD)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.diff(np.concatenate([first, [len(keys)]]))
            answer = [total, np.repeat(np.add.reduceat(total, first), size), np.repeat(np.add.reduceat(known.astype(np.int64), first), size)]
        rows.append((REPEATS, part, None, None, None, int((total == 1).sum()), int((total == 2).sum())))
        for b, i, j in zip(table["block"].to_pylist(), bounds, bounds[1:], strict=False):
            own = at[i:j][wanted[i:j] > 0]
            if len(own):
                rows.append((b, part, squeeze(*(a[own] for a in answer)), None, None, None, None))
        return pa.Table.from_batches([_rows(rows, TOTALS)])

    return counted


def _word_classes(hashes: np.ndarray, tails: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Class of each word; ``head`` is sorted."""
    if not len(head):
        return HEAD + tails.astype(np.int64)
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, at, HEAD + tails.astype(np.int64))


def _histories(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every token its history: last class * HISTORY + the class before."""
    starts = np.cumsum(lengths) - lengths
    one = np.concatenate([[START], classes[:-1]])
    one[starts] = START
    two = np.concatenate([[START], one[:-1]])
    two[starts] = START
    return one * HISTORY + two


def _count(head: np.ndarray):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for held, lens, v, t, c in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                lengths = np.frombuffer(lens, np.int32)
                of = _word_classes(np.frombuffer(v, np.uint64), np.frombuffer(t, np.uint8), head)
                classes = of[unpack(c)]
                cell = (_histories(classes, lengths) * CLASSES + classes)[~np.repeat(np.frombuffer(held, bool), lengths)]
                got = np.bincount(cell, minlength=HISTORY * HISTORY * CLASSES).astype(np.int32)
                total = got if total is None else total + got
        if total is not None:
            cell = np.flatnonzero(total)
            t = pa.table({"history": pa.array((cell // CLASSES).astype(np.int32)), "class": pa.array((cell % CLASSES).astype(np.int32)), "n": pa.array(total[cell].astype(np.int64))})
            yield from t.to_batches(max_chunksize=65536)

    return cells


@dataclass
class Weights:
    """Bias and one table per feature, float32."""

    bias: np.ndarray
    last: np.ndarray
    skip: np.ndarray
    pair: np.ndarray

    @classmethod
    def zero(cls) -> Weights:
        return cls(*(np.zeros(s, np.float32) for s in ((CLASSES,), (HISTORY, CLASSES), (HISTORY, CLASSES), (PAIRED, CLASSES))))

    def log_probabilities(self, history: np.ndarray) -> np.ndarray:
        one, two, pair = features(history)
        x = self.last[one]
        x += self.skip[two]
        x += self.pair[pair]
        x += self.bias
        x -= x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        return x


def features(history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return history // HISTORY, history % HISTORY, history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)


def _by_feature(history: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    out = []
    for index, size in zip(features(history), (HISTORY, HISTORY, PAIRED), strict=True):
        index = index.astype(np.int64)
        order = np.argsort(index, kind="stable")
        found, at = np.unique(index[order], return_index=True)
        total = np.zeros((size, CLASSES), np.float32)
        total[found] = np.add.reduceat(values[order], at, axis=0)
        out.append(total)
    return out


def _expect(weights: Weights | None):
    """Feature totals of a task's histories: as counted (no weights) or as the model expects them."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not sum(b.num_rows for b in tables):
            return
        t = pa.Table.from_batches(tables)
        history, at = np.unique(t["history"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, of, n = at[order], t["class"].to_numpy()[order], t["n"].to_numpy()[order]
        loss, sums = 0.0, [np.zeros_like(x) for x in vars(Weights.zero()).values()]
        for first in range(0, len(history), TOGETHER):
            own = history[first : first + TOGETHER]
            i, j = np.searchsorted(at, [first, first + len(own)])
            values = np.bincount((at[i:j] - first) * CLASSES + of[i:j], n[i:j], len(own) * CLASSES).reshape(-1, CLASSES)
            if weights:
                logs = weights.log_probabilities(own)
                loss -= float((values * logs).sum())
                values = values.sum(axis=1, keepdims=True) * np.exp(logs)
            for total, x in zip(sums, (values.sum(axis=0), *_by_feature(own, values.astype(np.float32))), strict=True):
                total += x.astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), *(pa.array([s.tobytes()], pa.binary()) for s in sums)], names=["loss", "bias", "last", "skip", "pair"])

    return expected


def _totals(cells: DataFrame, weights: Weights | None) -> tuple[float, list[np.ndarray]]:
    """Sum of the tasks' partial totals (GRADIENT_TASKS rows of 3.4 MB at most)."""
    out, loss = [x.astype(np.float64) for x in vars(Weights.zero()).values()], 0.0
    for row in cells.mapInArrow(_expect(weights), "loss double, bias binary, last binary, skip binary, pair binary").collect():
        loss += row["loss"]
        for total, name in zip(out, ("bias", "last", "skip", "pair"), strict=True):
            total += np.frombuffer(row[name], np.float32).reshape(total.shape)
    return loss, out


def fit(cells: DataFrame, steps: int = 8, rate: float = 0.5, prior: float = 2.0) -> tuple[Weights, list[float]]:
    """Weights by preconditioned gradient ascent on the log likelihood of ``cells(history, class, n)``.

    A step along (counted - expected), each coordinate over the larger of both plus
    ``prior`` (which keeps rare features near zero). Returns the losses in nats too.
    """
    # A history's counts may lie in several tasks: each expects its own share of them.
    dealt = materialise(cells, "cells").coalesce(GRADIENT_TASKS)
    weights, losses = Weights.zero(), []
    _, counted = _totals(dealt, None)
    share = (counted[0] + 0.01) / (counted[0] + 0.01).sum()
    weights.bias = np.log(share).astype(np.float32)
    for _ in range(steps):
        loss, expected = _totals(dealt, weights)
        losses.append(loss)
        for name, c, e in zip(("bias", "last", "skip", "pair"), counted, expected, strict=True):
            table = getattr(weights, name)
            if name != "bias":
                table += (rate * np.clip((c - e) / (np.minimum(np.maximum(c, e), 3 * e + prior) + prior), -1.5, 1.5)).astype(np.float32)
    return weights, losses


@dataclass
class Model:
    """What scoring needs besides the answers to a block; 5 MB at any corpus size."""

    weights: Weights
    head: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: float
    #: tokens and distinct words behind frequent words, by the number of the context
    behind: np.ndarray
    #: 2 ** bits is the number of parts of each kind of features
    bits: int


_tables: dict[bytes, np.ndarray] = {}


def _class_table(weights: Weights) -> np.ndarray:
    """log10 P(class | history) of all histories; 29 MB, kept by the worker that made it."""
    key = zlib.crc32(weights.last.tobytes()).to_bytes(4) + weights.pair.tobytes()[:4096]
    if key not in _tables:
        _tables.clear()
        out = np.empty((HISTORY * HISTORY, CLASSES), np.float32)
        for at in range(0, len(out), 4096):
            out[at : at + 4096] = weights.log_probabilities(np.arange(at, min(at + 4096, len(out)))) / np.float32(np.log(10))
        _tables[key] = out
    return _tables[key]


def _within(t: Tokens, model: Model, unigram: np.ndarray, narrow: list[np.ndarray], wide: list[np.ndarray]) -> np.ndarray:
    """log10 P(word | class, history) of the tokens ``t.at``; ``unigram`` is P(word | class) of a vocabulary."""
    held = np.flatnonzero(t.held[t.at])
    kinds, keys = zip(*(t.features(r, t.at[w]) for r, w in ((NGRAM, slice(None)), (SKIP, held))), strict=True)
    kind, key = np.concatenate(kinds), np.concatenate(keys)
    n_f, n_c, t_c = (np.zeros(len(key), np.int64) for _ in range(3))
    own = np.flatnonzero(~kind)
    if len(own):
        at = np.unique(key[own], return_inverse=True)[1]
        n_f[own], n_c[own], t_c[own] = (a[at] for a in narrow)
    own = np.flatnonzero(kind)
    if len(own):
        at = np.unique(key[own], return_inverse=True)[1]
        n_f[own] = wide[0][at]
        n_c[own], t_c[own] = model.behind[:, (key[own] & np.uint64((1 << WIDE) - 1)).astype(np.int64)]
    p = unigram[t.codes[t.at]]
    all_ = np.arange(len(t.at))
    for place, rows in ((held, slice(len(all_), None)), (all_, slice(None, len(all_)))):  # the n-gram, where known, counts
        n = n_c[rows]
        seen = np.flatnonzero(n)
        f, n, many, place = n_f[rows][seen], n[seen], t_c[rows][seen], place[seen]
        p[place] = np.maximum(f - model.discount, 0) / n + model.discount * many / n * unigram[t.codes[t.at[place]]]
    return np.log10(p)


def _score(model: Model):
    def answers(got: list[tuple], kinds: int) -> list[np.ndarray]:
        parts = [expand(p, *["<i8"] * kinds) for _, p in sorted(got)]
        return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(kinds)]

    def scored(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        table, out = _class_table(model.weights), []
        got: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
        for kind, part, payload in zip(*(totals[c].to_pylist() for c in ("kind", "part", "payload")), strict=True):
            got[kind + (kind and part >> model.bits)].append((part, payload))
        for row in blocks.to_pylist():  # one
            t = Tokens(row, model.head)
            c = np.zeros(len(t.of), np.int64)
            c[np.argsort(t.hashes)] = answers(got[0], 1)[0]
            base = np.log10((c + ADD) / (model.tokens + ADD * (model.distinct + 1)))
            unigram = (c + ADD) / (model.class_tokens[t.of] + ADD * (model.class_words[t.of] + 1))
            full = table[_histories(t.classes, t.lengths), t.classes].astype(np.float64)
            by_class = np.add.reduceat(full, t.starts)
            full[t.at] += _within(t, model, unigram, answers(got[1], 3), answers(got[2], 1))
            columns = {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(np.frombuffer(row["held"], bool)),
                "n_tokens": pa.array(t.lengths.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[t.codes], t.starts)),
                "base_score": pa.array(np.add.reduceat(base[t.codes], t.starts)),
                "score": pa.array(np.add.reduceat(full, t.starts)),
                "class_score": pa.array(by_class),
            }
            out.append(pa.table(columns))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known")), *((n, pa.float64()) for n in ("base_score", "score", "class_score"))]).empty_table()

    return scored


def parts_for(keys: int) -> int:
    """Bits that number the parts for so many keys."""
    return (max(PARTS, -(-keys // PART)) - 1).bit_length()


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of encoded texts, written once. Held out: CRC-32 of the doc_id's text divisible by 10 (null: as empty)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), utf8("text").alias("text"))
    return materialise(raw.mapInArrow(_encode, BLOCKS), "blocks")


def language_model(docs: DataFrame, steps: int = 8) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, ...)`` that are not held out, score all.

    Null and blank texts are the end token alone; a null doc_id counts as an empty
    text, so it is held out; repeated rows count as often as they occur; other
    columns are ignored; no rows give no rows. With nothing to learn from, all
    words are unknown and both scores still are finite. ``class_score`` is the part of
    ``score`` that P(class | history) has.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = encode(docs)
    size = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "train", "words"))).first()
    tokens = size[1]
    words = blocks.select("block", "vocabulary", "seen", "tail").mapInArrow(_vocabulary(parts_for(size[2])), DEALT)
    totals = materialise(words.groupBy("part").applyInArrow(_count_words(tokens), TOTALS), "words")
    # FREQUENT rows at most pass, HEAD come to the driver.
    heads = sorted(totals.where(F.col("block") == CANDIDATE).orderBy(F.desc("n"), "word").limit(HEAD).select("word", "tail", "n").collect(), key=lambda r: r["word"] % (1 << 64))
    head = np.array([r["word"] for r in heads], np.int64).view(np.uint64)
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals.where(F.col("block") == BY_TAIL).groupBy("tail").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():  # TAIL rows
        class_tokens[HEAD + r["tail"]], class_words[HEAD + r["tail"]] = r["n"], r["t"]
    for k, r in enumerate(heads):
        for table, n in ((class_tokens, r["n"]), (class_words, 1)):
            table[k] = n
            table[HEAD + r["tail"]] -= n
    cells = blocks.select("held", "lengths", "vocabulary", "tail", "codes").mapInArrow(_count(head), "history int, class int, n long")
    weights, _ = fit(cells.groupBy("history", "class").agg(F.sum("n").alias("n")), steps)
    bits = parts_for(2 * size[0])
    dealt = blocks.select("block", "held", "lengths", "vocabulary", "tail", "codes").mapInArrow(_features(head, bits), DEALT)
    found = materialise(dealt.groupBy("part").applyInArrow(_count_features(bits), TOTALS), "features")
    behind = np.zeros((2, 2 * (HEAD + 1) * TAIL), np.int64)
    for r in found.where(F.col("block") == CONTEXT_SUM).groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():  # 2 (HEAD + 1) TAIL rows at most
        behind[:, r["word"]] = r["n"], r["t"]
    once, twice = found.where(F.col("block") == REPEATS).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "t"))).first()
    discount = min(max(once / max(1, once + 2 * twice), 0.1), 0.95)
    model = Model(weights, head, tokens, int(class_words.sum()), class_tokens, class_words, discount, behind, bits)
    answers = totals.select("block", F.lit(0).alias("kind"), "part", "payload").unionByName(found.select("block", F.lit(1).alias("kind"), "part", "payload")).where("block >= 0")
    scored = blocks.select("block", "ids", "held", "lengths", "vocabulary", "tail", "codes").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model), SCORED)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
