"""SimHash near duplicates by bit-sliced comparison.

Fingerprints that differ in at most four of 64 bits agree, by the pigeonhole
principle, on at least two of six bit blocks; the 15 pairs of blocks are the keys
of an exact candidate search. Distinct fingerprints with a key in common are
compared bit-sliced: 64 fingerprints fill one machine word per bit position, a
query flips the planes where it has a one, and three carry-save counters plus an
overflow plane hold the 64 distances at once. Words whose lanes have all exceeded
the radius are abandoned between groups of planes.

A key shared by very many fingerprints is cut into a grid of cells that are
compared apart. Of each cell only a spanning forest leaves the worker, so a group
of n copies costs n edges, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import lean, materialise, prepare, utf8
from siftwell.llm.components import components

#: Widths of the six bit blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
PAIRS = list(combinations(range(len(BLOCKS)), 2))
#: Fingerprints of one key that are compared in one cell of the grid.
CELL = 4096
_U = np.uint64


def shingle_hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of a text's lower-cased word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :], strict=False)]


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """A bit is one where over half of the shingle hashes have it; no words give zero."""
    hashes = [shingle_hashes(t, width) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):  # as many texts at a time as have some 100,000 shingles
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 100_000, side="right")))
        own = full[at:upto]
        flat = np.array([x for k in own for x in hashes[k]], np.uint64)
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.cumsum(sizes[own]) - sizes[own]
        ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * ones > sizes[own][:, None], axis=1).view(">u8").ravel()
        at = upto
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprints(batch.column(1).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within a group whose fingerprints differ in at most ``radius`` (< 8) bits.

    ``group`` is sorted. Bit-sliced: see the module's description.
    """
    n = len(prints)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    blocks = -(-size // 64)
    block_at = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(first)), size)
    lane = np.arange(n) - first[of]
    word, bit = block_at[of] + (lane >> 6), (lane & 63).astype(_U)
    total = int(blocks.sum())
    planes = np.zeros((64, total), np.uint64)
    for p in range(64):  # lanes of a word are distinct bits, so their sum is their union
        ones = (prints >> _U(p)) & _U(1)
        np.add.at(planes[p], word, ones << bit)
    valid = np.zeros(total, np.uint64)
    np.add.at(valid, word, _U(1) << bit)
    query_blocks = blocks[of] - (lane >> 6)  # words at or behind the query's own: each pair once
    keep = size[of] > 1
    left, right = [], []
    ends = np.cumsum(np.where(keep, query_blocks, 0))
    at = 0
    while at < n:  # some 200,000 (query, word) pairs at a time
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, side="right")))
        own = np.arange(at, upto)[keep[at:upto]]
        at = upto
        if not len(own):
            continue
        q = np.repeat(own, query_blocks[own])
        w = word[q] + (np.arange(len(q)) - np.repeat(np.cumsum(query_blocks[own]) - query_blocks[own], query_blocks[own]))
        behind = np.where(w == word[q], (~_U(0) << bit[q]) << _U(1), ~_U(0))
        over = ~(valid[w] & behind)
        c0, c1, c2 = np.zeros_like(over), np.zeros_like(over), np.zeros_like(over)
        for p in range(64):
            x = planes[p][w] ^ (_U(0) - ((prints[q] >> _U(p)) & _U(1)))
            carry = c0 & x
            c0 ^= x
            x = c1 & carry
            c1 ^= carry
            over |= c2 & x
            c2 ^= x
            if p % 8 == 7:
                for d in range(radius + 1, 8):
                    over |= (c0 if d & 1 else ~c0) & (c1 if d & 2 else ~c1) & (c2 if d & 4 else ~c2)
                live = np.flatnonzero(over != ~_U(0))
                if len(live) < 0.8 * len(q):
                    q, w, over, c0, c1, c2 = q[live], w[live], over[live], c0[live], c1[live], c2[live]
                if not len(q):
                    break
        hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(hits)
        group_of = of[q[row]]
        left.append(q[row])
        right.append(first[group_of] + 64 * (w[row] - block_at[group_of]) + col)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    parent, out = {}, []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a_root, b_root = root(a), root(b)
        if a_root != b_root:
            parent[max(a_root, b_root)] = min(a_root, b_root)
            out.append((a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among rows (cell, fp) that arrive sorted by cell."""
    rest = None

    def edges(t: pa.Table) -> pa.RecordBatch:
        cell, fp = t["cell"].to_numpy(), t["fp"].to_numpy()
        a, b = close_pairs(fp.view(np.uint64), cell)
        pairs = forest(len(fp), a, b)
        u, v = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 100_000:
            continue
        t = pa.Table.from_batches(held)
        cell = t["cell"].to_numpy()
        upto = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if upto:
            yield edges(t.slice(0, upto))
            t = t.slice(upto)
        held, rows = t.to_batches(), t.num_rows
    if held:
        yield edges(pa.Table.from_batches(held))


def _keys() -> list:
    """The 15 keys of a fingerprint: number of the pair of blocks and the bits of both."""
    starts = [0, *accumulate(BLOCKS)]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << n) - 1) for s, n in zip(starts, BLOCKS, strict=False)]
    return [F.lit(k << 44).bitwiseOR(F.shiftleft(block[i], 22)).bitwiseOR(block[j]) for k, (i, j) in enumerate(PAIRS)]


def links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct ``fp`` at four or fewer differing bits.

    They are a spanning forest per key, so two linked fingerprints are always
    connected, though not always by an edge of their own.
    """
    keyed = prints.select("fp", F.explode(F.array(*_keys())).alias("key"))
    # Keys that one cell can't hold; each is at least `cell` rows, so they are few.
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("g"))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    other = F.explode(F.when(F.col("g").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("g") - 1)))
    grid = keyed.join(hot, "key", "left").withColumn("mine", mine).withColumn("other", other)
    at = F.when(F.col("g").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    cells = grid.select(at.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(lean(_compare), "u long, v long")


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every row, written once."""
    prepare(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.xxhash64(F.col("text")).alias("text_hash"))
    return materialise(raw.mapInArrow(lean(_sign), "doc_id long, fp long, text_hash long"), "signatures")


def classes(signed: DataFrame) -> DataFrame:
    """``(fp, component_id)``: the least doc_id of all rows that a fingerprint is connected with."""
    prints = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    spark = prints.sparkSession
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 65536)  # rows of 16 bytes
    roots = components(links(prints.select("fp")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    rooted = materialise(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "rooted")
    alone = rooted.where("root is null").select("fp", F.col("least").alias("component_id"))
    linked = rooted.where("root is not null")
    # Written, so that a class with a third of all fingerprints is split in the join.
    lowest = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    return materialise(alone.unionByName(linked.join(lowest, "root").select("fp", "component_id")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: its fingerprint and class.

    Null and blank texts have fingerprint zero and link like any other; texts of
    fewer than four words are one shingle; a null doc_id is kept but is no
    component's number unless nothing else is reachable; repeated rows stay
    repeated; other columns are ignored; no rows give no rows.
    """
    signed = signatures(docs)
    found = signed.join(classes(signed), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one with the
    least doc_id (ties: least text hash; nulls last) stays, once, with all its columns.
    """
    signed = signatures(docs)
    known = signed.join(classes(signed), "fp").select("doc_id", "text_hash", "component_id")
    best = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("b"))
    chosen = best.select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_text"))
    copies = signed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"))
    chosen = chosen.join(copies, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_hash"))).select("_id", "_text", "_n")
    # An unnamed key column: `docs` may have columns of any name.
    key = F.struct(F.col("doc_id").cast("long").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.col("text")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    wanted = chosen.select(F.struct(F.col("_id").isNull(), F.coalesce("_id", F.lit(0)), F.col("_text")).alias("key"), "_n")
    # The kept keys grow with the corpus: they are never broadcast, at no size.
    once = packed.join(materialise(wanted.where("_n = 1"), "kept").hint("merge"), "key").select("row")
    # Only rows that occur several times with the same doc_id and text need a choice.
    again = packed.join(materialise(wanted.where("_n > 1"), "repeated"), "key").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(again).select("row.*")

