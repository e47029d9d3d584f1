"""Exact top-k BM25: inverted indexes per shard, block-max WAND pruning, merged under global statistics.

A shard's documents lie in an order that puts similar ones together, in blocks of BLOCK. For a query, the bound of a
block is the sum of the block maxima of the query's long lists and the largest sum that a document of the block has in
its short lists. A block whose bound is below the query's k-th score so far is no pivot: its entries in the long lists
are never touched. Each query's best block goes first, so that the k-th score is high from the start, and a task carries
the k best of each query from one shard to the next. Blocks are scored for all queries that have them as pivots at a
time, in single precision; whatever comes near the k-th score is summed anew in double precision and one fixed order, so
that shards and blocks don't change a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .byte_words import hashes
from .common import Table

#: Documents and list entries of a shard at most; documents of a block.
SHARD_DOCS, SHARD_ENTRIES, BLOCK = 16_384, 1_250_000, 64
#: Bytes of a shard's rows of long lists; a list is a row where its entries, once a query, times this are as many as all pairs.
ROW_BYTES, ROW_WORTH = 32 << 20, 1024
#: Queries that are sent to all tasks at a time (some 5 kB each, with a few hundred terms), and that a shard handles at a time.
QUERY_BLOCK, AT_A_TIME = 8192, 512
#: Entries of short lists that are added at a time.
ENTRIES_AT_A_TIME = 1 << 19
#: Bytes of texts that are split into terms at a time; longer texts are cut at blanks.
TEXT_BYTES = 1 << 21
K1, B = 1.2, 0.75
#: ASCII letters are lower-cased, other ASCII signs but digits are blanks, other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash of the term) of every term of some texts."""
    raw = np.frombuffer(b" ".join(texts).translate(_FOLD) + b" ", np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    at, size = edge[::2], edge[1::2] - edge[::2]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.searchsorted(bounds, at, "right") - 1, (hashes(raw, at, size) >> np.uint64(1)).astype(np.int64)


def _counted(doc: np.ndarray, key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with how often it occurs, in that order."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.empty(0, np.int64)
    count = np.diff(first, append=len(doc)) if times is None else np.add.reduceat(times[order], first) if len(first) else first
    return doc[first], key[first], count.astype(np.int64)


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of whole texts: (number of the text, term hash, how often), sorted by the first two."""
    found: list[tuple] = []
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        row, key = _split([t for _, t in held])
        found.append(_counted(np.array([n for n, _ in held])[row], key))
        held.clear()

    for n, text in enumerate(texts):
        at, text = 0, text or b""
        while at < len(text):
            end = len(text)
            if end - at > TEXT_BYTES:
                end = text.find(b" ", at + TEXT_BYTES) + 1 or end
            held.append((n, text[at:end]))
            size += end - at
            at = end
            if size >= TEXT_BYTES:
                flush()
                size = 0
    if held:
        flush()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return found[0] if len(found) == 1 else _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))


def alike_together(terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, lengths: np.ndarray, lists: int = 256, axes: int = 3) -> np.ndarray:
    """An order of the documents that makes block maxima tight: by the sides of the main axes of the longest lists, then by length."""
    sizes, n = np.diff(starts), len(lengths)
    if n <= BLOCK or not len(sizes):
        return np.argsort(lengths, kind="stable")
    there = np.zeros((min(lists, len(sizes)), n), np.float32)
    for r, x in enumerate(np.argsort(-sizes, kind="stable")[: len(there)]):
        there[r, docs[starts[x] : starts[x + 1]]] = 1
    there -= there.mean(1, keepdims=True)
    main = np.linalg.eigh(there @ there.T)[1][:, ::-1][:, :axes]
    side = (main.T @ there > 0).astype(np.int64)
    return np.lexsort((lengths, (side << np.arange(len(side))[::-1, None]).sum(0)))


class Shard:
    """terms, start of each term's list, then per entry the document's number in the shard and the term's count."""

    def __init__(self, terms, starts, docs, tfs, ids, lengths):
        self.terms, self.starts, self.docs, self.tfs, self.ids, self.lengths = terms, starts, docs, tfs, ids, lengths

    @classmethod
    def of(cls, doc: np.ndarray, key: np.ndarray, tf: np.ndarray, ids: list[int], lengths: np.ndarray) -> Shard:
        """From the entries in the order of documents; the documents get new numbers."""
        order = np.argsort(key, kind="stable")
        doc, tf, key = doc[order], tf[order], key[order]
        found, starts = np.unique(key, return_index=True)
        starts = np.append(starts, len(key)).astype(np.int64)
        del order, key
        placed = alike_together(found, starts, doc, lengths)
        number = np.empty(len(placed), np.int32)
        number[placed] = np.arange(len(placed))
        doc = number[doc]
        order = np.lexsort((doc, np.repeat(np.arange(len(found), dtype=np.int32), np.diff(starts))))
        small = np.uint16 if tf.max(initial=0) < 1 << 16 else np.int32
        return cls(found, starts, doc[order].astype(np.uint16), tf[order].astype(small), np.array(ids, np.int64)[placed], lengths[placed])

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        return cls(**np.load(io.BytesIO(data)))

    def prepare(self, average: float) -> None:
        """Impacts (scores without the idf), and every document's own terms and counts."""
        n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        self.norm = K1 * (1 - B + B * self.lengths / average)
        self.sizes = np.diff(self.starts)
        tf = self.tfs.astype(np.float32)
        self.impact = tf * np.float32(K1 + 1) / (tf + self.norm.astype(np.float32)[self.docs])
        self.row_of = np.full(len(self.terms), -1, np.int32)
        # Runs of entries of one list in one block, and what the entries of each reach at most.
        block = (self.docs // BLOCK).astype(np.int64) + np.repeat(np.arange(len(self.terms)), self.sizes) * self.blocks
        run = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
        self.maxima = np.maximum.reduceat(self.impact, run) if len(run) else self.impact
        self.run_block = (block[run] % max(1, self.blocks)).astype(np.int32)
        self.runs = np.searchsorted(run, self.starts)
        by_doc = np.argsort(self.docs, kind="stable")
        self.own_keys = self.docs[by_doc].astype(np.int64) * len(self.terms) + np.repeat(np.arange(len(self.terms), dtype=np.int32), self.sizes)[by_doc]
        self.own_tfs = self.tfs[by_doc]

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms' lists are, -1 for terms that the shard lacks."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def exact(self, q: np.ndarray, docs: np.ndarray, owner: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of (query, document) in double precision, added in the order of the terms, which is the same in every shard.

        `owner`, `t`, `w`: the queries' terms and weights, in order of query and term.
        """
        begin = np.searchsorted(owner, q)
        size = np.searchsorted(owner, q, "right") - begin
        load = np.cumsum(size)
        out, a = np.zeros(len(docs)), 0
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(load, load[a] - size[a] + ENTRIES_AT_A_TIME, "right")))
            pair, entry = _ranges(begin[a:b], size[a:b])
            look = docs[a:b][pair] * len(self.terms) + t[entry]
            at = np.minimum(np.searchsorted(self.own_keys, look), len(self.own_keys) - 1)
            hit = self.own_keys[at] == look
            pair, entry, tf = pair[hit], entry[hit], self.own_tfs[at[hit]].astype(np.float64)
            out[a:b] = np.bincount(pair, w[entry] * (tf * (K1 + 1) / (tf + self.norm[docs[a:b]][pair])), b - a)
            a = b
        return out

    def _rows(self, t: np.ndarray, queries: int) -> np.ndarray:
        """The lists that are cheaper as rows over all documents than entry by entry, for terms t of so many queries."""
        load = np.bincount(t, minlength=len(self.terms)) * self.sizes
        worth = np.flatnonzero(load * ROW_WORTH >= queries * self.blocks * BLOCK)
        most = max(1, ROW_BYTES // (4 * self.blocks * BLOCK))
        return worth if len(worth) <= most else np.sort(worth[np.argpartition(-load[worth], most - 1)[:most]])

    def _short_sums(self, owner: np.ndarray, t: np.ndarray, w: np.ndarray, queries: int) -> np.ndarray:
        """Each query's sums over the lists t, for every document."""
        width = self.blocks * BLOCK
        out = np.zeros((queries, width), np.float32)
        load = np.concatenate(([0], np.cumsum(np.bincount(owner, self.sizes[t], queries))))
        a = 0
        while a < queries:
            b = max(a + 1, int(np.searchsorted(load, load[a] + ENTRIES_AT_A_TIME, "right")) - 1)
            some = slice(*np.searchsorted(owner, (a, b)))
            size = self.sizes[t[some]]
            _, entry = _ranges(self.starts[t[some]], size)
            place = self.docs[entry] + np.repeat((owner[some] - a) * width, size)
            out[a:b] = np.bincount(place, np.repeat(w[some], size) * self.impact[entry], (b - a) * width).reshape(b - a, width)
            a = b
        return out

    def top(self, starts: np.ndarray, terms: np.ndarray, idfs: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray | None = None) -> int:
        """Improves each query's `best` (scores, ids: at most k, best first, ties by id). Returns how many blocks were pivots.

        `at`: the terms' places, where they are known.
        """
        queries, width = len(best), self.blocks * BLOCK
        at = self.places(terms) if at is None else at
        hit = at >= 0
        owner, t, w = np.repeat(np.arange(queries), np.diff(starts))[hit], at[hit], idfs[hit]
        if not len(t):
            return 0
        # Lists that the queries use much are rows over all documents: a block of them is then one matrix.
        worth = self._rows(t, queries)
        rows, maxima = np.zeros((self.blocks, len(worth), BLOCK), np.float32), np.zeros((len(worth), self.blocks), np.float32)
        r, entry = _ranges(self.starts[worth], self.sizes[worth])
        d = self.docs[entry]
        rows[d // BLOCK, r, d % BLOCK] = self.impact[entry]
        r, run = _ranges(self.runs[worth], self.runs[worth + 1] - self.runs[worth])
        maxima[r, self.run_block[run]] = self.maxima[run]
        self.row_of[worth] = np.arange(len(worth))
        row = self.row_of[t]
        self.row_of[worth] = -1
        long = row >= 0
        weight = np.zeros((queries, len(worth)), np.float32)
        weight[owner[long], row[long]] = w[long]
        short = self._short_sums(owner[~long], t[~long], w[~long].astype(np.float32), queries)
        highest = short.reshape(queries, self.blocks, BLOCK).max(2)
        bound = weight @ maxima + highest
        slack = (1e-5 * np.maximum(1.0, weight.sum(1) * (K1 + 1) + highest.max(1))).astype(np.float32)  # sums are in single precision here
        top = np.full((queries, k), -np.inf, np.float32)
        for q, (scores, _) in enumerate(best):
            top[q, : len(scores)] = scores
        kth = top.min(1)
        floor = kth - slack
        pivot = (bound > 0) & (bound >= floor[:, None] - slack[:, None])
        first = np.where(pivot.any(1) & (kth == -np.inf), bound.argmax(1), -1)  # where shards before left less than k
        found_q: list[np.ndarray] = []
        found_d: list[np.ndarray] = []
        found_s: list[np.ndarray] = []
        scored = 0

        def score(b: int, who: np.ndarray) -> None:
            span = slice(b * BLOCK, (b + 1) * BLOCK)
            if 2 * len(who) > queries:  # cheaper than to gather their weights
                some = (weight @ rows[b] + short[:, span])[who]
            else:
                some = weight[who] @ rows[b] + short[who, span]
            peak = some.max(1)
            high = np.flatnonzero((peak > 0) & (peak >= floor[who]))
            if not len(high):
                return
            who, some, peak = who[high], some[high], peak[high]
            r, c = np.nonzero((some > 0) & (some >= floor[who, None]))
            found_q.append(who[r])
            found_d.append(b * BLOCK + c)
            found_s.append(some[r, c])
            better = np.flatnonzero(peak > kth[who])
            if len(better):
                both = np.concatenate((top[who[better]], some[better]), 1)
                top[who[better]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[who[better]] = top[who[better]].min(1)
                floor[who[better]] = kth[who[better]] - slack[who[better]]

        for b in np.unique(first[first >= 0]).tolist():
            who = np.flatnonzero(first == b)
            score(b, who)
            scored += len(who)
        pivot[np.flatnonzero(first >= 0), first[first >= 0]] = False
        for b in range(self.blocks):
            who = np.flatnonzero(pivot[:, b])
            who = who[bound[who, b] >= floor[who] - slack[who]]
            if len(who):
                score(b, who)
                scored += len(who)
        if not found_q:
            return scored
        q, d, s = np.concatenate(found_q), np.concatenate(found_d), np.concatenate(found_s)
        stay = s >= floor[q]
        q, d = q[stay], d[stay]
        order = np.argsort(q, kind="stable")
        q, d = q[order], d[order]
        exact = self.exact(q, d, owner, t, w)
        some, begin = np.unique(q, return_index=True)
        for x, a, b in zip(some, begin, np.append(begin[1:], len(q)), strict=True):
            scores = np.concatenate((best[x][0], exact[a:b]))
            ids = np.concatenate((best[x][1], self.ids[d[a:b]]))
            rank = np.lexsort((ids, -scores))[:k]
            rank = rank[scores[rank] > 0]
            best[x] = scores[rank], ids[rank]
        return scored


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of all positions of the given ranges, one range after another."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    shift = np.repeat((starts - np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(np.int32), sizes)  # a shard has far fewer than 2^31 entries
    return owner, np.arange(len(owner), dtype=np.int32) + shift


def _index(shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, entries = TaskContext.get().partitionId(), 0, [], 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            doc, key, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            lengths = np.bincount(doc, tf, len(ids)).astype(np.int64)
            columns = [[f"{part}-{number}"], [len(ids)], [int(tf.sum())], [Shard.of(doc, key, tf, ids, lengths).dumps()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "docs", "terms", "lists"])

        for batch in batches:
            at, rows = 0, batch.num_rows
            doc, key, tf = terms(batch.column(1).cast(pa.binary()).to_pylist())
            while at < rows:  # a batch may end one shard and begin the next
                some = min(rows, at + shard_docs - len(ids))
                a, b = np.searchsorted(doc, (at, some))
                held.append(((doc[a:b] - at + len(ids)).astype(np.int32), key[a:b], tf[a:b].astype(np.int32)))
                ids += batch.column(0).slice(at, some - at).to_pylist()
                entries, at = entries + b - a, some
                if len(ids) == shard_docs or entries >= SHARD_ENTRIES:
                    yield close()
                    number, ids, entries = number + 1, [], 0
        if ids:
            yield close()

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, key, _ = terms(batch.column(1).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], names=["query_id", "term"])


def _list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            shard = Shard.loads(data.as_py())
            sizes = np.diff(shard.starts)
            for a in range(0, len(sizes), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(shard.terms[a : a + (1 << 17)]), pa.array(sizes[a : a + (1 << 17)])], names=["term", "df"])


def _search(block, k: int):
    names, types = ["query_id", "doc_id", "score"], [pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is a shard. All queries of the block run against it, from the k best that the shards before left."""
        ids, starts, numbers, terms, idfs, average = block.value
        best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            for data in batch.column(0):
                shard = Shard.loads(data.as_py())
                shard.prepare(average)
                places = shard.places(terms)  # once for all queries
                for a in range(0, len(ids), AT_A_TIME):
                    span = starts[a : a + AT_A_TIME + 1]
                    some, own = best[a : a + AT_A_TIME], numbers[span[0] : span[-1]]
                    shard.top(span - span[0], terms[own], idfs[own], k, some, places[own])
                    best[a : a + AT_A_TIME] = some
        for a in range(0, len(ids), AT_A_TIME):
            some = best[a : a + AT_A_TIME]
            columns = np.repeat(ids[a : a + AT_A_TIME], [len(x) for x, _ in some]), np.concatenate([x for _, x in some]), np.concatenate([x for x, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

    return run


def _block(pairs: DataFrame, part: int, documents: int, average: float) -> tuple:
    """The queries of a block, alike ones together: ids, where each one's terms start, numbers of its terms in order; the
    sorted terms and their idf. QUERY_BLOCK bounds its rows."""
    found = pairs.where(F.col("part") == part).select("query_id", "pairs.term", "pairs.df").toArrow()
    ids, lists = found.column(0).to_numpy(), [pa.chunked_array(found.column(c)).combine_chunks() if found.num_rows else None for c in (1, 2)]
    if not found.num_rows:
        return ids.astype(np.int64), np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), average
    sizes = np.diff(lists[0].offsets.to_numpy())
    owner = np.repeat(np.arange(len(ids)), sizes)
    terms, one, number = np.unique(lists[0].flatten().to_numpy(), return_index=True, return_inverse=True)
    df = lists[1].flatten().to_numpy()[one].astype(np.float64)
    order = np.lexsort((owner, number))
    placed = alike_together(terms, np.searchsorted(number[order], np.arange(len(terms) + 1)), owner[order], sizes)
    rank = np.empty(len(placed), np.int64)
    rank[placed] = np.arange(len(placed))
    number = number[np.lexsort((number, rank[owner]))]
    return ids[placed].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[placed]))), number.astype(np.int32), terms, np.log1p((documents - df + 0.5) / (df + 0.5)), average


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents of each query, ties to the smaller id.

    Terms are runs of ASCII letters (lower-cased), digits and non-ASCII characters; a query is its set of distinct terms.
    Null and empty texts have no terms: as documents they are counted and never found, as queries they find nothing.
    Texts are split whole, however long. Rows without an id are left out. Rows that share an id are documents of their
    own, but one query. Only documents with a score above 0 are returned; the query itself may be among them. An empty
    table finds nothing; other columns, whatever their names, are ignored.

    A core walks through its share of the shards for a block of queries and returns k rows a query; the work grows with
    queries times documents, less what is pruned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).cast("string").alias("text")).where("query_id is not null")
    count, tasks = rows.count(), spark.sparkContext.defaultParallelism
    shard_docs = max(1, min(SHARD_DOCS, -(-count // tasks)))  # a shard a core at least
    built = Table(rows.coalesce(max(tasks, -(-count // SHARD_DOCS))).mapInArrow(_index(shard_docs), "shard string, docs long, terms long, lists binary"), "text-index", batch=128, codec="none")
    index = built.read()
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    documents, average = total.docs or 0, max(1.0, (total.terms or 0) / max(1, total.docs or 0))
    split = Table(asked.mapInArrow(_query_terms, "query_id long, term long").distinct(), "query-terms", batch=128)
    wanted = split.read()
    sizes = index.select("lists").mapInArrow(_list_sizes, "term long, df long")
    counted = sizes.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    grouped = wanted.join(counted, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("pairs"))  # a query's own terms
    blocks = max(1, -(-wanted.select("query_id").distinct().count() // QUERY_BLOCK))
    placed = Table(grouped.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long"))), "queries", batch=256)
    tops = []
    for part in range(blocks):  # a job a block of queries; the index stays where it is, and a core walks through its shards
        block = spark.sparkContext.broadcast(_block(placed.read(), part, documents, average))
        tops.append(Table(index.select("lists").coalesce(tasks).mapInArrow(_search(block, k), "query_id long, doc_id long, score double"), "shard-tops", batch=1))
        block.unpersist()
    for table in (built, split, placed):
        table.drop()
    found = spark.read.schema(tops[0].schema).parquet(*(t.path for t in tops))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
