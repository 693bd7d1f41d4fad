"""Edit-aware token counts.

A document's text is cut behind blanks and line feeds into leaves of some 256
characters. A tree over the leaves keeps, for every node, the characters and the
tokens below it. No pre-token reaches across such a cut, so an edit only changes the
leaves it touches and the one its neighbouring character lies in: their text is
joined, edited and encoded again, and the sums above are updated. The rest of the
text is never read. A leaf that an insertion makes long is cut anew. Kept trees hold the leaves' bounds, so later edits start from
them and encode no more than that either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import prepare
from siftwell.llm.tokens import ChunkEncoder, together

LEAF = 256
#: An edit's leaves are cut into more than they were beyond so many times that size.
GROWN = 4
_CUT = re.compile(r"[ \n]+")


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in parts of at least ``size`` characters that end in a blank or line feed, but for the last."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size - 1)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class Tree:
    """Sums of characters and tokens over leaves; node k has children 2k and 2k + 1."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.encoded = 0
        self._build(parts, tokens)

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.parts = parts or [""]
        self.size = 1 << (len(self.parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(self.parts)] = map(len, self.parts)
        self.tokens[self.size : self.size + len(self.parts)] = tokens or [0]
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def restore(cls, text: str, chars: bytes, tokens: bytes, n_leaves: int) -> Tree:
        """The tree that these sums were kept of; nothing is encoded."""
        size, ends, at = len(chars) // 16, [], 0
        for n in np.frombuffer(chars, "<i8")[size : size + n_leaves].tolist():
            at += n
            ends.append(at)
        if at != len(text):
            raise ValueError("the kept sums are not those of the text")
        parts = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return cls(parts, np.frombuffer(tokens, "<i8")[size : size + n_leaves].tolist())

    def sums(self) -> tuple[bytes, bytes, str]:
        """What :meth:`restore` needs: token sums, character sums, text."""
        return np.array(self.tokens, "<i8").tobytes(), np.array(self.chars, "<i8").tobytes(), self.text()

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where that leaf begins; the end lies in the last leaf."""
        if at >= self.chars[1]:
            k = len(self.parts) - 1
            while k and not self.chars[self.size + k]:
                k -= 1
            return k, self.chars[1] - self.chars[self.size + k]
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if at - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def replace(self, start: int, length: int, insert: str, count) -> None:
        """Replace ``length`` characters at ``start``; ``count`` gives a text's tokens."""
        start = max(0, min(start, self.length))
        end = min(start + max(0, length), self.length)
        first, begin = self.find(max(start - 1, 0))
        last, last_begin = self.find(end)
        joined = "".join(self.parts[first : last + 1])
        edited = joined[: start - begin] + insert + joined[end - begin :]
        self.encoded += len(edited)
        parts, room = leaves(edited), last + 1 - first
        if len(parts) > room and len(edited) <= GROWN * LEAF * room:
            parts[room - 1 :] = ["".join(parts[room - 1 :])]
        tokens = [count(p) for p in parts]
        if len(parts) > room:
            known = self.tokens[self.size : self.size + len(self.parts)]
            self._build(self.parts[:first] + parts + self.parts[last + 1 :], known[:first] + tokens + known[last + 1 :])
            return
        spare = room - len(parts)
        for k, (own, n) in enumerate(zip(parts + [""] * spare, tokens + [0] * spare, strict=True), first):
            self._set(k, own, n)

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        k = self.size + leaf
        chars, tokens = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def text(self) -> str:
        return "".join(self.parts)


def _trees(texts: list[str], encoder: ChunkEncoder) -> list[Tree]:
    cut = [leaves(t) for t in texts]
    counts, at, out = encoder.counts(pa.array([p for parts in cut for p in parts], pa.string())).tolist(), 0, []
    for parts in cut:
        out.append(Tree(parts, counts[at : at + len(parts)]))
        at += len(parts)
    return out


EDITS = "array<struct<start:long,length:long,insert:string>>"
COUNTED = "doc_id long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, reencoded_chars long"


KEPT = "token_tree binary, char_tree binary, edited_text string"


def _edit(tree: Tree, edits: list | None, encoder: ChunkEncoder, keep: bool) -> tuple:
    """A row of COUNTED (and KEPT) behind its doc_id."""
    before = tree.total
    for e in edits or ():
        if e is not None:
            tree.replace(e["start"] or 0, e["length"] or 0, e["insert"] or "", encoder.count)
    return before, len(tree.parts), tree.length, tree.total, tree.encoded, *(tree.sums() if keep else ())


def _batch(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in (COUNTED + f", {KEPT}" * keep).split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.binary(), pa.string()] * keep
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _count(tokenizer: str, keep: bool):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        for batch in together(batches):
            docs, edits = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            trees = _trees([t or "" for t in batch.column(1).to_pylist()], encoder)
            yield _batch([(d, *_edit(t, e, encoder, keep)) for d, t, e in zip(docs, trees, edits, strict=True)], keep)

    return counted


def _count_again(tokenizer: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(d, *_edit(Tree.restore(t or "", c, k, n), e, encoder, True)) for d, t, c, k, n, e in rows], True)

    return counted


def count_edits(docs: DataFrame, tokenizer: str, edits: str = "edits", keep: bool = False) -> DataFrame:
    """Tokens of ``docs(doc_id, text, <edits>, ...)`` before and after each row's edits, in order.

    An edit ``(start, length, insert)`` counts in characters of the text as the ones
    before it left it; it is cut to the text's bounds, null fields are zero or empty,
    null edits and lists are none. ``n_leaves`` counts after the edits. Null texts are empty; repeated rows stay repeated;
    other columns are ignored; no rows give no rows. ``keep`` adds the trees (64-bit
    sums, root at 1) and the edited text, from which :func:`edit_again` goes on.
    """
    prepare(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(edits).cast(EDITS).alias("edits"))
    return raw.mapInArrow(_count(tokenizer, keep), COUNTED + f", {KEPT}" * keep)


def edit_again(kept: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """Further edits of ``kept``, rows of :func:`count_edits` or of this function with kept
    trees and a column of new edits. Only the leaves that these touch are encoded.

    ``n_tokens`` are the tokens before the new edits, ``reencoded_chars`` the characters
    that they made be encoded. Edits are read as there; rows whose trees are not those
    of their text are refused.
    """
    prepare(kept.sparkSession)
    raw = kept.select("doc_id", "edited_text", "char_tree", "token_tree", "n_leaves", F.col(edits).cast(EDITS).alias("edits"))
    return raw.mapInArrow(_count_again(tokenizer), f"{COUNTED}, {KEPT}")


def sample_edits(text: str = "text", key: str = "doc_id") -> Column:
    """Three edits that depend on a row alone: a deletion, an insertion and a replacement."""
    n, k = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"), F.coalesce(F.col(key).cast("string"), F.lit(""))
    edit = lambda at, length, insert: F.struct(at.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(edit(F.floor(n / 3), 5, F.lit("")), edit(F.floor(n / 2), 0, F.concat(F.lit(" revision "), k, F.lit(" "))), edit(F.floor(n * 3 / 4), 7, F.lit("Don't-"))).cast(EDITS)
