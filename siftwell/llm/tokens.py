"""Exact, memoised encoding with a public word-level BPE tokenizer.

The tokenizer normalises a text (NFC, lower case), cuts it into pre-tokens and
encodes each by itself; no pre-token holds white space. So Arrow lowers a batch, sets
blanks around all pre-tokens that are not letters, splits at white space and finds
the distinct pre-tokens; each is looked up in a bounded memo once, and the new ones
are encoded many at a time. Texts for which the cut is not certain to be the tokenizer's own (control
characters, literal special tokens, scripts whose character classes depend on the
Unicode version) are handed to it as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Anything but Latin letters, general punctuation and currency signs; white space that
#: one side does not know as such; a letter whose lower case is two; special tokens.
#: None of the other characters is changed by NFC, alone or behind another.
ODD = "[^\x00-\x1b -\x84\x86-įı-ſ‐-‧‰-⁞₠-₿]|<\\|"
_ODD = re.compile(ODD)
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: Pre-tokens other than letters. ``\s`` is not the same everywhere: the white space that ODD allows is named.
_APART = f"[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\\t-\\r \xa0{_L}{_N}]+"
_PRE_TOKEN = re.compile(f"[{_L}]+|{_APART}")
#: Memory bounds of the memo: that many pre-tokens of so many characters at most are
#: kept (some 200 bytes each), then it starts anew.
MEMO, LONGEST = 400_000, 256
#: New pre-tokens are encoded so many at a time: the tokenizer needs some kilobytes for each.
AT_ONCE = 8192
#: Texts are encoded together up to so many bytes.
TOGETHER = 4 << 20


def pre_tokens(text: str) -> list[str] | None:
    """The tokenizer's normalised pre-tokens; None if they can't be told for sure."""
    return None if _ODD.search(text) else _PRE_TOKEN.findall(text.lower())


class _Memo(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens."""
        if len(self) > MEMO:
            self.clear()
        found = [*map(self.get, pieces)]
        if None in found:
            new = [k for k, ids in enumerate(found) if ids is None]
            self.learn({pieces[k] for k in new})
            for k in new:
                found[k] = self[pieces[k]]
            for k in new:
                if len(pieces[k]) > LONGEST:
                    self.pop(pieces[k], None)
        return found

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens that are not in the memo, AT_ONCE in a call."""
        joined = [p for p in pieces if p and "<" not in p and len(p) <= LONGEST]
        for part in (joined[at : at + AT_ONCE] for at in range(0, len(joined), AT_ONCE)):
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1  # a pre-token's last token says that it is the last
            if len(cuts) == len(part):
                raw, bounds = got.tobytes(), [0, *(4 * cuts).tolist()]
                self.update({p: raw[i:j] for p, i, j in zip(part, bounds, bounds[1:], strict=False)})
        for p in pieces:
            if p not in self:
                self[p] = self.ids(p)


_encoders: dict[str, _Memo] = {}


def together(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of some TOGETHER bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def as_text(texts: pa.Array) -> pa.Array:
    """Texts from UTF-8; what is not UTF-8 is replaced."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        if path not in _encoders:
            _encoders[path] = _Memo(Tokenizer.from_file(path))
        self.memo = _encoders[path]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], dict[int, bytes]]:
        """Bounds of each text's pre-tokens, every pre-token's number, the ids of each number,
        and the ids of texts that must be encoded as a whole (they have no pre-tokens)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        whole = {k: self.memo.ids(texts[k].as_py()) for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        lowered = pc.utf8_lower(pc.if_else(odd, "", texts) if whole else texts)
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(lowered, f"({_APART})", " \\1 "))
        bounds = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        return bounds - bounds[0], pieces.indices.to_numpy(), self.memo.of(_strings(pieces.dictionary)), whole

    def encode(self, texts: pa.Array) -> list[memoryview | bytes]:
        """The ids of each text."""
        bounds, pieces, ids, whole = self._pieces(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.concatenate([[0], np.cumsum(sizes[pieces])])[bounds].tolist()
        flat = memoryview(pa.array(ids, pa.large_binary()).take(pa.array(pieces)).buffers()[2] or b"").cast("B")
        return [whole.get(k, flat[i:j]) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False))]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        bounds, pieces, ids, whole = self._pieces(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        out = np.diff(np.concatenate([[0], np.cumsum(sizes[pieces])])[bounds])
        for k, own in whole.items():
            out[k] = len(own) // 4
        return out

    def count(self, text: str) -> int:
        """The number of tokens of one text."""
        own = pre_tokens(text)
        return len(self.memo.ids(text)) // 4 if own is None else sum(map(len, self.memo.of(own))) // 4

    def whole(self, s: str) -> bytes:
        """The ids by the tokenizer alone."""
        return self.memo.ids(s)


def _strings(values: pa.Array) -> list[str]:
    """The values of a string array without line feeds; one conversion for all, not one for each."""
    if not len(values):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\n")
    return joined[0].as_py().split("\n")
