"""N-gram Jaccard join as a T-occurrence search.

Two sets link when they share at least T = ceil(p(|x|+|y|)/(100+p)) shingles. Every set's shingles are ordered from rare
to frequent. The frequent ones are its long lists, the rest its short lists, so many that a partner is bound to occur in
a short list of both (DivideSkip's T - L >= 1). Short lists are merged by a shuffle on the shingle; long lists are only
probed for the candidates that the short ones give.

1. Sets are fingerprinted; rows with equal sets are one class with one representative. The same pass fills a sketch of
   shingle counts of constant size, which orders shingles by frequency (it decides speed, never the result).
2. The representatives' short lists are grouped by shingle. Every document of a list is compared with the list's first
   and last document only, and components of the links found are united: a large group of near copies becomes one
   component by a number of comparisons in proportion to its size.
3. Where a list still holds documents of several components, all pairs across components that were not yet compared are.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import Table
from .components import components
from .shingles import Shingler, mixed

#: Bins of the frequency sketch, and blocks it is sent in.
BINS, BLOCKS = 1 << 21, 64
#: Candidates that one call compares with their query.
BLOCK_ROWS = 256


def needed(x, y, percent: int):
    """The least overlap at which sets of so many shingles link."""
    return -(-percent * (x + y) // (100 + percent))


def short_length(n, percent: int):
    """How many of n shingles, rarest first, are short lists."""
    return n - -(-percent * n // 100) + 1


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Overlap of the query with each set, where it reaches what both sizes need, else 0.

    The inverted lists of the query's shingles over the given sets are divided: the L longest are set aside, the
    others heap-merged; a set that occurs at least T - L times is probed by binary search for the L shingles.
    """
    sizes = np.array([len(s) for s in sets])
    need = needed(len(query), sizes, percent)
    everything, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    inside = np.searchsorted(query, everything)
    hit = query[np.minimum(inside, len(query) - 1)] == everything
    order = np.lexsort((owner[hit], inside[hit]))
    rank, owner = inside[hit][order], owner[hit][order]
    bounds = np.searchsorted(rank, np.arange(len(query) + 1))
    length = np.diff(bounds)
    least = int(need.min())
    far = min(least - 1, int(least / (0.0085 * np.log2(max(2, length.max(initial=1))) + 1)))  # L as the DivideSkip paper sets it
    by_length = np.argsort(-length, kind="stable")
    long, short = by_length[:far], by_length[far:]
    out = np.zeros(len(sets), np.int64)
    merged = heapq.merge(*(owner[bounds[k] : bounds[k + 1]].tolist() for k in short if length[k]))
    probes = query[np.sort(long)]
    for k, run in groupby(merged):
        count = sum(1 for _ in run)
        if count + len(long) >= need[k]:
            at = np.searchsorted(sets[k], probes)
            total = count + int((sets[k][np.minimum(at, len(sets[k]) - 1)] == probes).sum())
            if total >= need[k]:
                out[k] = total
    return out


def _signatures(words: int):
    names, per = ["doc_id", "n", "f1", "f2", "block", "part", "counts"], BINS // BLOCKS
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch, part, held = Shingler(words), np.zeros(BINS, np.uint32), TaskContext.get().partitionId(), []
        for batch in batches:
            sizes, sums, more = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py())
                sizes.append(len(found))
                sums.append(found.sum(dtype=np.uint64))
                more.append(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                held.append(found & np.uint64(BINS - 1))
            if sum(map(len, held)) > 1 << 20:
                sketch += np.bincount(np.concatenate(held).astype(np.int64), minlength=BINS).astype(np.uint32)
                held = []
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.array(more, np.uint64).view(np.int64)), *(pa.nulls(rows, t) for t in types[4:])], names=names)
        if held:
            sketch += np.bincount(np.concatenate(held).astype(np.int64), minlength=BINS).astype(np.uint32)
        blocks = [(k, zlib.compress(np.minimum(sketch[k * per : (k + 1) * per], 65535).astype("<u2").tobytes(), 1)) for k in range(BLOCKS)]
        if sketch.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(BLOCKS, t) for t in types[:4]), pa.array([k for k, _ in blocks], pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([b for _, b in blocks])], names=names)

    return run


def _frequency_classes(rows: DataFrame) -> bytes:
    """Bit lengths of how far each bin's count lies above the usual one: a table of BINS bytes, whatever the input's size.

    The more documents there are, the more every bin holds; what stands out of that are frequent shingles.
    """
    import pandas as pd

    per = BINS // BLOCKS

    def first(pdf):
        total = np.zeros(per, np.uint32)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<u2")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(total.astype("<u4").tobytes(), 1)]})

    def last(pdf):
        total = np.zeros(per)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<u4")
        usual = float(np.median(total))  # what rare shingles alone put into a bin
        above = np.maximum(total - usual - 2 * np.sqrt(usual), 0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [np.ceil(np.log2(above + 1)).astype(np.uint8).tobytes()]})

    schema = "block int, counts binary"
    some = rows.withColumn("some", F.floor(F.col("part") / 128)).groupBy("block", "some").applyInPandas(first, schema)
    found = {r.block: bytes(r.counts) for r in some.groupBy("block").applyInPandas(last, schema).collect()}
    return b"".join(found.get(k, bytes(per)) for k in range(BLOCKS))


def _short_lists(words: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level = Shingler(words), np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            sizes, lists, ends = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py())
                k = short_length(len(found), percent) if len(found) else 0
                order = level[(found & np.uint64(BINS - 1)).astype(np.int64)]
                rare = np.argsort(order, kind="stable")[:k]
                sizes.append(len(found))
                lists.append(found[rare].view(np.int64))
                ends.append((int(order[rare[-1]]) << 56) | (int(found[rare[-1]]) >> 8) if k else 0)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), flat, pa.array(ends, pa.int64())], names=["doc_id", "n", "short", "short_end"])

    return run


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """One-hash Bloom filter of the ids, as 64-bit words: 16 bits an id, but never over 16 MB.

    Beyond 8 million ids it lets more rows through; a join on the ids follows it, so it only saves work.
    """
    bits = 1 << max(16, min(27, int(16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[_marks(batch.column(0).to_numpy(), bits)] = True
        words = np.packbits(seen, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["word", "mask"])

    found = ids.coalesce(16).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool), bits


def _only(held, bits: int):
    """Passes the rows on whose id the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little")
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(wanted[_marks(batch.column(0).to_numpy(), bits)])))

    return run


def _sets(words: int, held, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, wanted = Shingler(words), np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little")
        for batch in batches:
            rows = np.flatnonzero(wanted[_marks(batch.column(0).to_numpy(), bits)])
            some = batch.take(pa.array(rows))
            found = [shingles(t.as_py()).tobytes() for t in some.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return run


def _compare(percent: int):
    names, types = ["x", "y", "overlap"], [pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by (x, part) and x's own sets, where y is x, first: one of each text that has the id."""
        queries, key, asked, ids, sets = {}, None, False, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for query in queries.values():
                found = divide_skip(query, sets, percent)
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(hit), types[0]), pa.array([ids[k] for k in hit], types[1]), pa.array(found[hit], types[2])], names=names)

        for batch in batches:
            for x, y, own in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("shingles"), strict=True):
                if ids and (y == x or len(ids) >= BLOCK_ROWS):
                    yield from flush()
                    ids, sets = [], []
                found = own.as_py()
                if y == x:
                    if asked or x != key:
                        queries, key, asked = {}, x, False
                    if found:
                        queries[found] = np.frombuffer(found, np.uint64)
                    continue
                asked = True
                ids.append(y)
                sets.append(np.frombuffer(found, np.uint64))
        if ids:
            yield from flush()

    return run


def _ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()


def _plausible(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs whose short lists have enough in common for a link.

    Of two documents one has its short lists end first; what both share is in both short lists or among its long ones.
    `short_end` compares where they end, up to ties.
    """
    seen, bits = _filter_of(_ids_of(pairs))
    held = pairs.sparkSession.sparkContext.broadcast(np.packbits(seen, bitorder="little").tobytes())
    some = short.mapInArrow(_only(held, bits), short.schema)
    x, y = (some.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("short").alias(f"short_{c}"), F.col("short_end").alias(f"end_{c}")) for c in "xy")
    long_x, long_y = F.col("n_x") - F.size("short_x"), F.col("n_y") - F.size("short_y")
    rest = F.when(F.col("end_x") < F.col("end_y"), long_x).when(F.col("end_x") > F.col("end_y"), long_y).otherwise(F.greatest(long_x, long_y))
    most = F.least(F.size(F.array_intersect("short_x", "short_y")) + rest, F.col("n_x"), F.col("n_y"))
    both = pairs.join(x, "x").join(y, "y").where(most.cast("long") * (100 + percent) >= F.lit(percent) * (F.col("n_x").cast("long") + F.col("n_y")))
    return both.select("x", "y").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among candidate pairs (x, y), compared on whole sets.

    Texts stay where they are read; only the sets that the pairs ask for are moved. A query with many candidates is
    dealt out in parts by their number.
    """
    sizes = pairs.groupBy("x").agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, "x").select("x", F.pmod(F.xxhash64("y"), F.ceil(F.col("m") / (4 * BLOCK_ROWS))).alias("part"), "y")
    asked = dealt.unionByName(dealt.select("x", "part", F.col("x").alias("y")).distinct())
    seen, bits = _filter_of(_ids_of(pairs))
    held = rows.sparkSession.sparkContext.broadcast(np.packbits(seen, bitorder="little").tobytes())
    sets = rows.mapInArrow(_sets(words, held, bits), "doc_id long, shingles binary")
    found = asked.join(sets, F.col("y") == F.col("doc_id")).select("x", "part", "y", "shingles")
    grouped = found.repartition("x", "part").sortWithinPartitions("x", "part", F.col("y") != F.col("x"), "y")
    return grouped.mapInArrow(_compare(percent), "x long, y long, overlap long")


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _size(place: str) -> Column:
    return F.shiftright(F.col(place), 32)


def _rest(place: str) -> Column:
    """How many of the document's shingles stand at this place of its order or after it."""
    return _size(place) - F.col(place).bitwiseAND(F.lit((1 << 32) - 1))


def _early(percent: int) -> Column:
    """Whether this can be the first common shingle with a document that is at least as large."""
    return _rest("place") * (100 + percent) >= 2 * percent * _size("place")


def _short_table(rows: DataFrame, same: DataFrame, counts: DataFrame, words: int, percent: int) -> Table:
    """doc_id, n, short, short_end: the representatives' short lists, rarest shingle first, and where their order ends."""
    classes = rows.sparkSession.sparkContext.broadcast(_frequency_classes(counts))
    lists = rows.mapInArrow(_short_lists(words, percent, classes), "doc_id long, n int, short array<long>, short_end long")
    chosen = same.select(F.col("first_id").alias("doc_id"), "n").distinct()
    return Table(lists.join(chosen, ["doc_id", "n"], "left_semi"), "short-lists", batch=128, codec="none")


def _shared_lists(short: DataFrame, percent: int) -> DataFrame:
    """h, doc_id, place (size and position in one number), lo, hi, m: the entries of short lists that can hold a link, with
    each list's end documents and length. Of two linked documents the smaller one has their first common shingle early.
    """
    entries = short.select("doc_id", "n", F.posexplode("short").alias("pos", "h"))
    entries = entries.select("h", "doc_id", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("place"))
    ends = entries.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("m"), F.max(_early(percent)).alias("any")).where("lo < hi and any")
    return entries.join(ends, "h").select("h", "doc_id", "place", "lo", "hi", "m")


def _reach(percent: int) -> Column:
    """Whether two documents whose first common shingle stands at these places can share as many as they need."""
    both = _size("place_x") + _size("place_y")
    return F.least(_rest("place_x"), _rest("place_y")) * (100 + percent) >= percent * both


def _end_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each list's documents paired with its first and its last one, where the sizes and places allow a link."""
    ends = shared.where("doc_id = lo or doc_id = hi").select("h", F.col("doc_id").alias("x"), F.col("place").alias("place_x"))
    pairs = shared.select("h", F.col("doc_id").alias("y"), F.col("place").alias("place_y")).join(ends, "h").where("x <> y").where(_reach(percent))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _cross_pairs(shared: DataFrame, united: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list whose documents are in different components, could reach the overlap and were not compared yet.

    In a list of up to three documents every pair has an end document, so it was.
    """
    named = shared.where("m > 3").select("h", "doc_id", "place").join(united, F.col("doc_id") == F.col("node"), "left").select("h", "doc_id", "place", F.coalesce("component", "doc_id").alias("c"), _early(percent).alias("early"))
    several = named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("early").alias("any")).where("lo < hi and any").select("h")
    open_lists = Table(named.join(several, "h"), "open-lists", codec="lz4").read()
    less = open_lists.where("early").select("h", *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "place", "c")))
    more = open_lists.select("h", *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "place", "c")))
    near = (F.col("c_x") != F.col("c_y")) & (_size("place_x") <= _size("place_y")) & _reach(percent)
    pair = less.join(more, (less.h == more.h) & near).select(F.least("doc_id_x", "doc_id_y").alias("x"), F.greatest("doc_id_x", "doc_id_y").alias("y")).distinct()
    return pair.join(tried, ["x", "y"], "left_anti")


def _shared_ids(signatures: DataFrame, same: DataFrame) -> DataFrame:
    """Links (a, b) of ids that have several texts with the representatives of those texts."""
    sound = signatures.where("n > 0 and doc_id is not null")
    text = F.struct("f1", "f2", "n")
    several = sound.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo < hi").select("doc_id")
    return sound.join(several, "doc_id").join(same, ["f1", "f2", "n"]).where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links), is_first (it is that id).

    Null and blank texts have no shingles and link with nothing. A row whose id is null gets a null component. Rows
    that share an id count as one document with several texts. Repeated rows are answered each, very long texts by all
    their shingles. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("doc_id is not null")
    schema = "doc_id long, n int, f1 long, f2 long, block int, part int, counts binary"
    first = Table(rows.mapInArrow(_signatures(words), schema), "signatures", batch=128).read()
    signatures = first.where("block is null").select("doc_id", "n", "f1", "f2")
    same = signatures.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first_id"))
    held: list[Table] = []

    def kept(df: DataFrame, name: str, **how) -> DataFrame:
        """Written, and deleted at the end."""
        held.append(Table(df, name, **how))
        return held[-1].read()

    held.append(_short_table(known, same, first.where("block is not null").select("block", "part", "counts"), words, percent))
    short = held[-1].read()
    _release(spark)
    shared = kept(_shared_lists(short, percent), "shared-lists", codec="lz4")
    _release(spark)

    ends = kept(_end_pairs(shared, percent), "end-pairs")
    likely = kept(_plausible(ends, short, percent), "likely-pairs-1")
    links = kept(_verified(likely, known, words, percent), "links-1", batch=256)
    _release(spark)
    united = kept(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "components-1")
    across = kept(_cross_pairs(shared, united, ends, percent), "cross-pairs")
    likely = kept(_plausible(across, short, percent), "likely-pairs-2")
    more = kept(_verified(likely, known, words, percent), "links-2", batch=256)
    _release(spark)

    every = links.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(_shared_ids(signatures, same))
    final = Table(components(every), "components-2").read()
    for table in held:  # what follows reads the signatures and the last components alone
        table.drop()
    by_class = same.join(final, F.col("first_id") == F.col("node"), "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("component", "first_id").alias("found"))
    joined = signatures.join(by_class, (signatures.f1 == by_class.f1) & (signatures.f2 == by_class.f2) & (signatures.n == by_class.m) & (signatures.n > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("is_first"))
