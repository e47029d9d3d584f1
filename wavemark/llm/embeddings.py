"""Near-duplicate embeddings: small-world graphs per shard, every shard queried, cosines verified, components united.

A shard's row holds its vectors and its graph. The members of a shard are queries against that shard and against each
shard of a higher number, so that every pair of shards meets in one task; what a task returns are counts and a spanning
forest of the links it found. The number of shards follows from a shard's bytes and from the cores, not from the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Table
from .components import components
from .hnsw import Graph

#: Bytes that the vectors and the graph of a shard take in a worker, about.
SHARD_BYTES = 128 << 20
#: First beam; queries that an audit compares with all vectors of a shard, and queries that it makes up; the share of links that it asks for.
BEAM, AUDITED, PLANTED, RECALL = 48, 64, 512, 0.995
#: Single-precision searches look this much below the threshold; double precision then decides.
SLACK = 1e-4


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one, in double precision."""
    v = v.astype(np.float64)
    w = v / np.abs(v).max(1, keepdims=True)
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def _build(narrow: bool):
    kind = np.dtype("<f4" if narrow else "<f8")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, kind) for x in pdf["embedding"]])
        graph = Graph.build(_unit(v).astype(np.float32))
        columns = {"shard": pdf["shard"].iloc[0], "dims": pdf["dims"].iloc[0], "graph": graph.dumps(), "vectors": v.tobytes()}
        columns |= {x: pdf[x].to_numpy(np.int64).tobytes() for x in ("number", "size")}
        return pd.DataFrame({k: [x] for k, x in columns.items()})

    return run


def planted(v: np.ndarray, least: float, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, queries): vectors drawn from v, each turned any way by as much as a link may be and no more."""
    draw = np.random.default_rng(len(v))
    which = np.sort(draw.permutation(len(v))[:many])
    base = v[which].astype(np.float64)
    aside = draw.standard_normal(base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    cosine = min(1.0, least + SLACK)
    return which, (cosine * base + sqrt(1 - cosine**2) * aside).astype(np.float32)


def audited(graph: Graph, q: np.ndarray, least: float, own: bool) -> tuple[int, int, int]:
    """(beam, links found, links there are) of a sample of queries, with the beam doubled until the audit is content.

    It is content with its share of the links that brute force finds for the sample, and with the same share of the links
    of made-up queries (`planted`): these have a link each, as far away as links are, however rare links are in the data.
    `own`: the queries are the graph's vectors, and a query itself doesn't count.
    """
    ef, base = BEAM, graph.layers[-1].v
    sample = np.sort(np.random.default_rng(len(q)).permutation(len(q))[:AUDITED])
    truth = q[sample] @ base.T >= least
    if own:
        truth[np.arange(len(sample)), sample] = False
    which, made = planted(base, least, PLANTED)
    while True:
        hit, met = np.zeros_like(truth), np.zeros(len(which), bool)
        for a, rows, nodes, _ in graph.steps(q[sample], least, ef):
            hit[a + rows, nodes] = True
        for a, rows, nodes, _ in graph.steps(made, least, ef):
            met[a + rows[nodes == which[a + rows]]] = True
        found = int((hit & truth).sum())
        if ef >= len(base) or found >= RECALL * truth.sum() and met.sum() >= RECALL * len(which):
            return ef, found, int(truth.sum())
        ef = min(2 * ef, len(base))


class _Sets:
    """Union-find over numbered nodes, many at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.up[x]
        while not np.array_equal(above := self.up[found], found):
            found = above
        self.up[x] = found
        return found

    def unite(self, x: int, others: np.ndarray) -> np.ndarray:
        """Joins x with all others; those of them, one a set, that weren't with it."""
        mine = int(self.roots(np.array([x]))[0])
        root, first = np.unique(self.roots(others), return_index=True)
        fresh = root != mine
        self.up[root[fresh]] = mine
        return others[first[fresh]]


def _pair(threshold: float, narrow: bool):
    kind, names = np.dtype("<f4" if narrow else "<f8"), ["a", "b", "links", "audited"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is a shard's graph and the members of a shard, maybe the same, as queries."""
        for batch in batches:
            for r in batch.to_pylist():
                own = r["shard"] == r["other"]
                number, size, base = np.frombuffer(r["number"], np.int64), np.frombuffer(r["size"], np.int64), _unit(np.frombuffer(r["vectors"], kind).reshape(-1, r["dims"]))
                numbers, sizes, q = (number, size, base) if own else (np.frombuffer(r["numbers"], np.int64), np.frombuffer(r["sizes"], np.int64), _unit(np.frombuffer(r["queries"], kind).reshape(-1, r["dims"])))
                graph, asked = Graph.loads(r["graph"], base.astype(np.float32)), q.astype(np.float32)
                ef, found, there = audited(graph, asked, threshold - SLACK, own)
                links, links_of_queries = np.zeros(len(base), np.int64), np.zeros(len(q), np.int64)
                sets = _Sets(len(base) + (0 if own else len(q)))
                forest: list[tuple[np.ndarray, np.ndarray]] = []
                for a, rows, nodes, _ in graph.steps(asked, threshold - SLACK, ef):
                    rows = rows + a
                    cosine = np.concatenate([np.einsum("nd,nd->n", q[rows[k : k + 65536]], base[nodes[k : k + 65536]]) for k in range(0, len(rows), 65536)]) if len(rows) else np.empty(0)
                    good = cosine >= threshold
                    if own:
                        good &= rows != nodes
                    rows, nodes = rows[good], nodes[good]
                    links_of_queries += np.bincount(rows, size[nodes], len(q)).astype(np.int64)
                    if not own:
                        links += np.bincount(nodes, sizes[rows], len(base)).astype(np.int64)
                    for x, k, n in zip(*np.unique(rows, return_index=True, return_counts=True), strict=True):
                        joined = sets.unite(int(x) if own else len(base) + int(x), nodes[k : k + n])
                        if len(joined):
                            forest.append((np.full(len(joined), numbers[x]), number[joined]))
                counts = [(numbers, links_of_queries)] if own else [(numbers, links_of_queries), (number, links)]
                for who, n in counts:
                    some = n > 0
                    yield _answer(names, who[some], who[some], n[some])
                if forest:
                    yield _answer(names, *(np.concatenate(x) for x in zip(*forest, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([found], pa.int64()), pa.array([there], pa.int64())], names=names)

    return run


def _answer(names: list[str], a: np.ndarray, b: np.ndarray, links: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links) if links is not None else pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=names)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, least_shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows it links with), component_id (smallest id reachable), kept (it is that id), audit_recall.

    Null, empty and zero vectors and such with null or non-finite components link with nothing; vectors of different
    length don't link. Equal vectors are one class before the search, and each class is in the index and a query against
    every shard, whatever its ids. Rows that share an id are vectors of their own. A row with a null id links like any
    other, and itself has a null component; a component of rows without an id has none. An empty table gives no rows;
    other columns, whatever their names, are ignored. `audit_recall` is the share of the links that brute force finds
    for the audits' queries which the graphs found, null if those have no links.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)  # then nothing is lost in single precision
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    keyed = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.hash(F.reverse("embedding")))  # a short key; the vector itself decides below
    distinct = keyed.where("sound").groupBy("k1", "k2", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    classes = Table(distinct.withColumn("number", F.monotonically_increasing_id()), "vector-classes", batch=4096).read()
    dims = F.size("embedding")
    counted = classes.agg(F.count("*").alias("n"), F.max(dims).alias("dims")).first()
    bytes_each = (8 + (4 if narrow else 8)) * (counted.dims or 1) + 256
    shards = max(least_shards or ceil(sqrt(4 * spark.sparkContext.defaultParallelism)), ceil(counted.n * bytes_each / SHARD_BYTES))
    placed = classes.select("number", "embedding", "size", dims.alias("dims"), F.pmod(F.xxhash64("number"), F.lit(shards).cast("long")).alias("shard"))
    placed = placed.repartitionByRange(shards, "shard")  # a shard a task: by hashes, and put together by size, several would go to one
    built = Table(placed.groupBy("shard", "dims").applyInPandas(_build(narrow), "shard long, dims int, graph binary, vectors binary, number binary, size binary"), "vector-graphs", batch=1, codec="none")
    index = built.read()
    graphs = index.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shard"))))
    members = index.select("dims", F.col("shard").alias("other"), F.col("vectors").alias("queries"), F.col("number").alias("numbers"), F.col("size").alias("sizes"))
    asked = members.withColumn("shard", F.explode(F.sequence(F.col("other"), F.lit(shards - 1).cast("long"))))
    asked = asked.select("dims", "shard", "other", *(F.when(F.col("shard") != F.col("other"), F.col(x)).alias(x) for x in ("queries", "numbers", "sizes")))  # a shard has its own members
    keys = ["dims", "shard", "other"]
    tasks = shards * (shards + 1)
    pairs = graphs.repartition(tasks, *keys).join(asked.repartition(tasks, *keys), keys)
    found = Table(pairs.mapInArrow(_pair(threshold, narrow), "a long, b long, links long, audited long"), "vector-links", batch=1)
    answers = found.read()
    audit = answers.where("a is null").agg(F.sum("links").alias("found"), F.sum("audited").alias("there")).first()
    recall = audit.found / audit.there if audit.there else None
    links = answers.where("a = b").groupBy(F.col("a").alias("number")).agg(F.sum("links").alias("others"))
    groups = Table(components(answers.where("a <> b").select("a", "b")), "vector-components").read()
    built.drop()
    named = classes.join(links, "number", "left").join(groups.withColumnRenamed("node", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", F.col("embedding").alias("own"), "size", F.coalesce("others", F.lit(0)).alias("others"), "component_id")
    joined = keyed.join(named, (keyed.k1 == named.k1) & (keyed.k2 == named.k2) & (keyed.embedding == named.own) & keyed.sound, "left")
    n = F.when(F.col("sound"), F.col("size") - 1 + F.col("others")).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
