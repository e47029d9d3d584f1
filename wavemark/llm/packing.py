"""Best-fit packing of documents into fixed token budgets by exact-complement hashing.

Only the number of pieces of each length decides how they are packed, so the plan is made on the driver from a
histogram of at most `capacity` rows, with an index of the sums of one, two and three lengths, and each piece finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Table
from .tokens import crc, encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank_in_part long"


class Sums:
    """Index of what one, two and three free pieces can sum to, kept up to date while pieces are taken.

    `pairs` counts the pairs of lengths of each sum, `triples` the lengths that complete a pair to it. Pieces are only
    taken, so every length and every sum leaves the index once, and each time costs a pass over the sums.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is outside 1..{capacity}")
            self.free[length] += n
        self.has = self.free > 0
        one = self.has.astype(np.int64)
        twice = np.zeros(capacity + 1, np.int64)
        half = np.arange(capacity // 2 + 1)
        twice[2 * half] = self.has[half]
        self.pairs = (np.convolve(one, one)[: capacity + 1] + twice) // 2
        self.pairs[2 * half] -= self.free[half] == 1  # a length is its own partner from two pieces on
        self.triples = np.convolve(one, (self.pairs > 0).astype(np.int64))[: capacity + 1]

    def _lose(self, sums: np.ndarray) -> None:
        """A pair less for each of the sums."""
        self.pairs[sums] -= 1
        for s in sums[self.pairs[sums] == 0].tolist():
            self.triples[s:] -= self.has[: len(self.has) - s]

    def take(self, length: int, n: int) -> None:
        before, end = int(self.free[length]), len(self.free)
        self.free[length] -= n
        if before >= 2 > before - n and 2 * length < end:
            self._lose(np.array([2 * length]))
        if before == n:
            self.has[length] = False
            self.triples[length:] -= self.pairs[: end - length] > 0
            self._lose(length + np.flatnonzero(self.has[: end - length]))

    def _two(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs of lengths of this sum, the longest piece first."""
        a = np.arange(total - 1, total - total // 2 - 1, -1)
        for x in a[self.has[a] & self.has[total - a]].tolist():
            yield x, total - x

    def filling(self, gap: int, beside: int) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is `gap`, with free pieces besides one of the length `beside`; the fewest
        pieces and of those the longest first; None if there are none."""

        def free(*lengths: int) -> bool:
            return all(self.free[x] >= n for x, n in Counter((beside, *lengths)).items())

        if gap <= 0:
            return None
        if free(gap):
            return (gap,)
        if self.pairs[gap] and (two := next((t for t in self._two(gap) if free(*t)), None)):
            return two
        if self.triples[gap]:
            below = np.arange(gap)
            for a in np.flatnonzero(self.has[:gap] & (self.pairs[gap - below] > 0))[::-1].tolist():
                if 3 * a < gap:
                    break
                if two := next((t for t in self._two(gap - a) if free(a, *t)), None):
                    return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, pieces of it in each)]) such that every piece is used once."""
    sums = Sums(counts, capacity)
    made: list[tuple[int, list[tuple[int, int]]]] = []
    if whole := int(sums.free[capacity]):
        made.append((whole, [(capacity, 1)]))
        sums.take(capacity, whole)
    for longest in range(capacity - 1, 0, -1):
        while sums.free[longest] and (found := sums.filling(capacity - longest, longest)) is not None:
            need = Counter((longest, *found))
            n = min(int(sums.free[x]) // k for x, k in need.items())
            for x, k in need.items():
                sums.take(x, n * k)
            made.append((n, sorted(need.items(), reverse=True)))
    return made + best_fit(sums.free, capacity)


def best_fit(free: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over lengths; bins with the same content are handled together."""
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, n: int, content: list[tuple[int, int]]) -> None:
        open_bins.setdefault(gap, []).append((n, content))
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        left = int(free[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                each = capacity // length
                if n := left // each:
                    put(capacity - each * length, n, [(length, each)])
                if left % each:
                    put(capacity - left % each * length, 1, [(length, left % each)])
                break
            gap = length + int(fits[0])
            n, content = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps[gap] = False
            each = min(gap // length, left)  # best fit puts the next piece of this length into the same bin
            used = min(n, left // each)
            if used < n:
                put(gap, n - used, content)
            put(gap - each * length, used, [*content, (length, each)])
            left -= used * each
    return [x for bins in open_bins.values() for x in bins]


def _pieces(tokenizer_path: str, end_id: int, capacity: int, by_word: bool):
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, seen = encoder(tokenizer_path, by_word), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, found in zip(batch.column(0).to_pylist(), worker.many(batch.column(1).to_pylist()), strict=True):
                ids = np.append(found.astype("<u4"), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    for column, value in zip(rows, (doc_id, k, at, len(some), crc(some), part, int(seen[len(some)])), strict=True):
                        column.append(value)
                    seen[len(some)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], names=names)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """Packs every document (its ids, then `end_id`) into sequences of at most `capacity` ids.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than `capacity` are
    cut. Null and empty texts are one piece with the end id; repeated rows and null ids are packed like any row. Very
    long texts are encoded in pieces that end at blanks. An empty table gives no rows; other columns, also such as are
    named like those of the result, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = Table(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity, by_word), PIECE_SCHEMA), "pieces", batch=128).read()
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows

    key, low, each, length, sequence, offset = [], [], [], [], [], []
    used: Counter = Counter()
    sequences = 0
    for n, content in plan(counts, capacity):
        at = 0
        for size, k in content:
            for column, value in zip((key, low, each, length, sequence, offset), ((size << 44) + used[size], used[size], k, size, sequences, at), strict=True):
                column.append(value)
            used[size] += n * k
            at += size * k
        sequences += n
    order = np.argsort(np.array(key, np.int64))
    place = [np.array(x, np.int64)[order] for x in (key, low, each, length, sequence, offset)]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, each, length, sequence, offset = place
        for batch in batches:
            size, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            k = np.searchsorted(key, (size << 44) + rank, "right") - 1
            nth = rank - low[k]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(size), batch.column("ids_crc32"), pa.array(sequence[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * length[k])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_part.select("length", "part", before.alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    return ranked.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
