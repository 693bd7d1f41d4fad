"""Best-fit packing of token pieces by minimum bin slack.

Only the *histogram* of piece lengths matters to a packing, and it has at most
``capacity`` rows whatever the corpus holds. So the packing itself is planned on
that bounded histogram: the largest remaining length seeds a bin, a bitset
subset-sum over the lengths still available finds the fullest completion, and the
pattern is removed as often as the histogram allows. Pieces then look up their
place by their rank among the pieces of the same length. The task that cuts pieces
ranks its own of each length as it goes; what the tasks before it hold is added.
So nothing is sorted to rank it, and a length that most pieces have is dealt over
as many tasks as read the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import lean, materialise, prepare, release, utf8
from siftwell.llm.tokens import ChunkEncoder, as_text, together

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """The multiset of available lengths with the largest sum up to ``room``.

    ``lengths`` is in descending order. Bit s of the running integer says that sum
    s can be reached; the steps are kept for walking back.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        if size > room:
            continue
        left, part = min(counts[size], room // size), 1
        while left:
            take = min(part, left)
            steps.append((size, take, bits))
            bits |= (bits << (size * take)) & mask
            left, part = left - take, part * 2
        if bits >> room & 1:
            break
    at, found = bits.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            found[size] = found.get(size, 0) + take
            at -= size * take
    return sorted(found.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(bins, [(length, copies), ...])`` that use up the histogram."""
    counts = {size: n for size, n in histogram.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    if lengths and (lengths[0] > capacity or lengths[-1] < 1):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        rest = dict(fullest(capacity - seed, [x for x in lengths if counts[x]], counts))
        counts[seed] += 1
        rest[seed] = rest.get(seed, 0) + 1
        pattern = sorted(rest.items(), reverse=True)
        times = min(counts[size] // copies for size, copies in pattern)
        for size, copies in pattern:
            counts[size] -= times * copies
        lengths = [x for x in lengths if counts[x]]
        out.append((times, pattern))
    return out


class Places:
    """Where the r-th piece of a length goes: a sorted table of rank intervals."""

    SHIFT = 40

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for times, pattern in patterns:
            offset = 0
            for size, copies in pattern:
                rank = used.get(size, 0)
                rows.append((size << self.SHIFT | rank, rank, copies, base, offset))
                used[size] = rank + times * copies
                offset += size * copies
            base += times
        self.bins = base
        self.rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.rows[np.searchsorted(self.rows[:, 0], length << self.SHIFT | rank, side="right") - 1]
        within = rank - row[:, 1]
        return row[:, 3] + within // row[:, 2], row[:, 4] + within % row[:, 2] * length


def _cut(tokenizer: str, capacity: int, separator: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        end, step = int(separator).to_bytes(4, "little"), 4 * capacity
        task, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for batch in together(batches):
            cols: list[list] = [[] for _ in kinds]
            encoded = encoder.encode(as_text(batch.column(1)))
            release()  # encoding takes many times what it leaves
            for doc, own in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = bytes(own) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    length = len(part) // 4
                    for col, v in zip(cols, (doc, k, at // 4, length, zlib.crc32(part), task, met[length]), strict=True):
                        col.append(v)
                    met[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    return lean(pieces)


def _place(places: Places):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            where, offset = places.find(t["length"].to_numpy(), t["rank"].to_numpy())
            yield from t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset)).to_batches()

    return lean(placed)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Pack all rows of ``docs(doc_id, text, ...)`` into sequences of ``capacity`` tokens.

    One row per piece. Null and blank texts become one piece holding the separator
    alone; a null doc_id stays null; repeated rows are packed as often as they
    occur; other columns are ignored; no rows give no rows. ``sequence_id`` numbers
    are dense from 0, ``offset`` is gapless within a sequence.
    """
    spark = docs.sparkSession
    prepare(spark)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    # Written once: a task that is run again counts as one, so ranks stay distinct.
    pieces = materialise(raw.mapInArrow(_cut(tokenizer, capacity, separator), PIECES), "pieces")
    groups = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # At most `capacity` rows come to the driver, at any corpus size.
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    # One row per reading task in each length's window.
    before = groups.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(places), PLACED)
