"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Bulk-synchronous best-fit, longest documents first.  Pieces are range-sorted by length and ranked in
Spark; gaps of open sequences are kept sorted as runs of equal gaps.  One step takes all pieces of one
length: a sweep over the gaps from the smallest that fits matches them, pieces that want the same gap
are told apart by rank, the gaps are updated, and what is left opens new sequences.  As lengths are whole
numbers up to ``capacity``, the steps need no more than the count of pieces by length (at most
``capacity`` rows) and yield runs of ranks with their places (a few thousand); tasks place each piece
by its rank.  The result is that of best-fit decreasing over all pieces, one at a time.

Longer documents are cut into pieces of ``capacity`` tokens, the first one shorter.

Edge cases: a null or empty text has the end id alone; rows with equal ids are packed each; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structmine.llm import spans
from structmine.llm.shared import kept, texts_of
from structmine.llm.token_ids import AT_ONCE, encoder, with_end

CAPACITY = 2048
ROWS_PER_TASK = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of every whole text with ``end_id`` appended."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in spans.slices(batches, "text", AT_ONCE):
            ids, ends = with_end(*coder.encode(spans.texts(batch.column("text"))), end_id)
            raw, rows = memoryview(ids.astype("<u4")).cast("B"), []
            for doc, first, n in zip(batch.column("doc_id").to_pylist(), ends.tolist(), np.diff(ends).tolist()):
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, i, a, b - a, zlib.crc32(raw[4 * (first + a) : 4 * (first + b)])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return texts_of(docs).mapInArrow(cut, PIECES)


class Run(NamedTuple):
    """Pieces of ranks ``rank`` and up: ``each`` a sequence from ``sequence`` on, the first at ``offset``."""

    rank: int
    length: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over ``counts`` of pieces by length; ranks count from the longest piece."""
    gaps: list[int] = []
    open_runs: dict[int, deque[tuple[int, int]]] = {}  # by gap: (first sequence, sequences)
    found: list[Run] = []
    rank = sequences = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_runs:
                open_runs[gap] = deque()
                insort(gaps, gap)
            open_runs[gap].append((first, n))

    def put(length: int, gap: int, first: int, n: int, left: int) -> int:
        """Up to ``left`` pieces into ``n`` sequences with equal gaps; how many went in."""
        each = gap // length
        taken = min(left, n * each)
        found.append(Run(rank, length, first, each, capacity - gap))
        full, rest = divmod(taken, each)
        leave(gap - each * length, first, full)
        if rest:
            leave(gap - rest * length, first + full, 1)
        leave(gap, first + full + (rest > 0), n - full - (rest > 0))
        return taken

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                n = -(-left // (capacity // length))
                taken = put(length, capacity, sequences, n, left)
                sequences += n
            else:
                gap = gaps[i]
                first, n = open_runs[gap].popleft()
                if not open_runs[gap]:
                    del open_runs[gap], gaps[i]
                taken = put(length, gap, first, n, left)
            rank += taken
            left -= taken
    return found


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` gives it) with ``sequence_id`` and ``offset``."""
    cut = kept(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = max(1, -(-sum(counts.values()) // ROWS_PER_TASK))
    order = [F.desc("length"), "doc_id", "piece"]
    ranged = cut.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the place in the sorted table: partition in the upper bits, row in the lower 33
    ranked = kept(ranged.withColumn("place", F.monotonically_increasing_id()), "ranked-pieces")
    part = F.shiftright("place", 33)
    sizes = {r["part"]: r["n"] for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    runs = plan(counts, capacity)
    sent = cut.sparkSession.sparkContext.broadcast(
        (np.array(runs, np.int64).reshape(-1, 5), np.array(sorted(before)), np.array([before[p] for p in sorted(before)]))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (run_table, parts, starts) = sent.value
        first, length, sequence, each, offset = run_table.T
        for batch in batches:
            at = batch.column("place").to_numpy()
            rank = starts[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1))
            r = np.searchsorted(first, rank, side="right") - 1
            bin_, slot = np.divmod(rank - first[r], each[r])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[r] + bin_), pa.array(offset[r] + slot * length[r])],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
