"""Mixing to target weights with soft domain membership.

A linear classifier learned from a labelled table gives every document a posterior over domains. Rates r >= 0 are then
fitted so that the expected token totals of the domains, sum of r * tokens * posterior, come near target shares of the
token budget. The fit is projected gradient descent on least squares. Posteriors are rounded to a grid, and documents
with the same posterior have the same rate, so the tokens of each grid cell are added up once and the steps run over the
cells; a step sends a K-vector to the tasks and brings sums of K and K x K back.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Table

DIMENSIONS = 1 << 18
#: Posteriors are multiples of one to this number.
GRID = 256
#: What is added to a step's metric, as a share of its largest axis: rates don't follow differences that are as small as that.
DAMPING = 0.01
#: Cells up to this many are broadcast; with three domains there can't be more than 33,153.
BROADCAST_CELLS = 50_000


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "replace")) % DIMENSIONS
        if len(self) < 150_000:
            self[word] = found
        return found


_EDGE = re.compile(r"[.,;:!?\"'()]")


def present(words: list[str], buckets: _Buckets) -> np.ndarray:
    """Buckets of the distinct words."""
    distinct = set(words)
    return np.unique(np.fromiter((buckets[w] for w in distinct), np.int64, len(distinct)))


def _fit(domains: list[str], passes: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, rows, labels = _Buckets(), [], []
        for batch in batches:
            for text, domain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(present(_words(text), buckets))
                labels.append(domains.index(domain))
        if rows:
            k = len(domains)
            w, b, g, order = np.zeros((DIMENSIONS, k), np.float32), np.log((np.bincount(labels, minlength=k) + 0.5) / len(rows)), np.full((DIMENSIONS, k), 1e-2, np.float32), np.random.default_rng(11)
            for _ in range(passes):
                for i in order.permutation(len(rows)):
                    p = _softmax(w[rows[i]].sum(0) + b)
                    p[labels[i]] -= 1
                    g[rows[i]] += (p * p).astype(np.float32)
                    w[rows[i]] -= (rate * p / np.sqrt(g[rows[i]])).astype(np.float32)
                    b -= 0.01 * p
            used = np.flatnonzero(w.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([used.astype("<i8").tobytes()]), pa.array([w[used].tobytes()]), pa.array([b.tobytes()])], names=["n", "used", "w", "b"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _words(text: str | None) -> list[str]:
    """Lower-cased words without common punctuation."""
    return _EDGE.sub("", (text or "").lower()).split()


def on_grid(p: np.ndarray) -> np.ndarray:
    """Rows of shares as multiples of 1 / GRID that add up to 1: rounded down, and what is left goes to the largest remainders."""
    scaled = p * GRID
    low = np.floor(scaled)
    left = (GRID - low.sum(1)).round().astype(np.int64)
    rank = np.argsort(np.argsort(low - scaled, axis=1, kind="stable"), axis=1, kind="stable")
    return (low + (rank < left[:, None])) / GRID


def _posteriors(model):
    """The batch's columns but the last, the text; n_tokens and posterior after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), buckets = model.value, _Buckets()
        for batch in batches:
            tokens, found = [], []
            at = batch.num_columns - 1
            for text in batch.column(at).to_pylist():
                tokens.append(len((text or "").split()))
                found.append(w[present(_words(text), buckets)].sum(0, dtype=np.float64) + b)
            shares = on_grid(_softmax(np.array(found).reshape(len(found), len(b)))).tolist()
            columns = [*batch.columns[:at], pa.array(tokens, pa.int64()), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "n_tokens", "posterior"])

    return run


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], *, sample_rows: int = 20_000, parts: int = 4, passes: int = 3, rate: float = 0.05):
    """(weights, offsets) of the classifier, fitted on at most `sample_rows` ids of `labelled` (doc_id, domain), drawn by a hash.

    An id with several domains counts for the first by name; of an id with several texts one is taken, by a hash.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(sample_rows)
    texts = docs.join(F.broadcast(some), "doc_id")  # at most sample_rows short rows
    one = texts.groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    dealt = one.repartition(parts).sortWithinPartitions("doc_id").select("text", "domain")
    found = dealt.mapInArrow(_fit(domains, passes, rate), "n long, used binary, w binary, b binary").collect()
    w, b, n = np.zeros((DIMENSIONS, len(domains)), np.float32), np.zeros(len(domains)), max(1, sum(r.n for r in found))
    for r in sorted(found, key=lambda r: (r.n, bytes(r.used), bytes(r.w))):  # sums of floats depend on their order
        w[np.frombuffer(r.used, "<i8")] += np.frombuffer(r.w, np.float32).reshape(-1, len(domains)) * (r.n / n)
        b += np.frombuffer(r.b) * (r.n / n)
    return w, b


def rate_column(steps: list[list[float]]) -> Column:
    """The rate after the given steps (K-vectors): from 1, each takes posterior . step off it, and never under 0."""
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, e: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - F.aggregate(F.zip_with("posterior", e, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))

    return F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), F.lit(1.0), step)


def fit_rates(rows: DataFrame, targets: dict[str, float], *, most_steps: int = 100, tolerance: float = 2e-3) -> tuple[Column, list[float], bool]:
    """(the rate column for `rows` (n_tokens, posterior), the domains' shares at the end, whether they meet the targets).

    A step goes down the gradient of the squared error in the (damped) metric of the Gram matrix of the rows whose rate
    isn't 0, so few are needed; a step that makes the error larger is halved. The targets are met when no share is off
    by more than `tolerance` of its target. The steps end there, after `most_steps`, or when five together don't make
    the error smaller by a tenth: targets can lie out of reach, as where no document is mostly of a wanted domain, and
    the rates then come as near as they do without telling almost equal documents apart.
    """
    share = np.array(list(targets.values()))
    share = share / share.sum()
    k = len(share)

    def totals(rate: Column) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens, and of the rates: tokens by domain and the Gram matrix of what is left, as shares of the tokens."""
        rated = rows.withColumn("_rate", rate)
        left = F.when(F.col("_rate") > 0, F.col("n_tokens"))
        r = rated.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col("_rate") * F.col("posterior")[i]) for i in range(k)), *(F.sum(left * F.col("posterior")[i] * F.col("posterior")[j]) for i in range(k) for j in range(k))).first()
        found = np.array([float(x or 0) for x in r])
        return found[0], found[1 : 1 + k] / max(found[0], 1.0), found[1 + k :].reshape(k, k) / max(found[0], 1.0)

    steps: list[np.ndarray] = []
    errors: list[float] = []
    reached, met = np.zeros(k), False
    for _ in range(most_steps):
        tokens, now, gram = totals(rate_column([x.tolist() for x in steps]))
        error = now - share
        size = float(np.sqrt((error**2).sum()))
        if errors and size > errors[-1]:
            steps[-1] = steps[-1] / 2
            if np.abs(steps[-1]).max() > 1e-9:
                continue
            steps.pop()  # no way down is left
            break
        errors.append(size)
        reached, met = now, bool((np.abs(error) <= tolerance * share).all())
        if met or not tokens or len(errors) > 5 and errors[-1] > 0.9 * errors[-6]:
            break
        steps.append(np.linalg.solve(gram + DAMPING * max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12) * np.eye(k), error))
    return rate_column([x.tolist() for x in steps]), reached.tolist(), met


def _rated(table: DataFrame, targets: dict[str, float]) -> DataFrame:
    """`table` (with n_tokens and posterior) and its rows' rate, the domains' shares reached and whether they meet the targets."""
    cells = Table(table.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")), "posterior-cells")
    rate, reached, met = fit_rates(cells.read(), targets)
    counted = cells.read().agg(F.count("*").alias("cells"), F.sum("n_tokens").alias("tokens")).first()
    if not met and counted.tokens:
        warnings.warn(f"the mix misses its targets: {dict(zip(targets, reached, strict=True))} instead of {targets}", stacklevel=3)
    rates = Table(cells.read().select("posterior", rate.alias("rate")), "posterior-rates")
    cells.drop()
    rates = rates.read()
    joined = table.join(F.broadcast(rates) if counted.cells <= BROADCAST_CELLS else rates, "posterior")
    return joined.withColumn("reached", F.array(*map(F.lit, reached))).withColumn("met", F.lit(met))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens (runs of non-blanks), posterior (in the targets' order), rate, reached, met.

    `reached` are the domains' shares of all tokens under the rates, `met` tells whether they are the targets; a warning
    is given where they aren't. `labelled` holds doc_id and domain; labels of other domains are ignored. Null and empty
    texts have no tokens, the posterior of a text without known words, and a rate like any other; so have rows with null
    ids, which no label belongs to. Repeated rows are rated each, very long texts taken whole. An empty table gives no
    rows; columns of other names, also those of the result, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn_domains(rows, labelled, list(targets), sample_rows=sample_rows))
    found = rows.mapInArrow(_posteriors(model), "doc_id long, n_tokens long, posterior array<double>")
    table = Table(found, "posteriors", batch=256).read()
    return _rated(table, targets).select("doc_id", "n_tokens", "posterior", "rate", "reached", "met")


def repeat_by_rate(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as `copies` draws from its rate; no row is moved.

    Nulls, empty and very long texts, repeated rows and empty tables are as for mix; rows with null ids draw each for
    themselves. Columns of any names and types come back as they were.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn_domains(rows, labelled, list(targets), sample_rows=sample_rows))
    inner = {c: f"_{k}_{c}" for k, c in enumerate(docs.columns)}  # names that can't clash with the new columns
    held = docs.withColumnsRenamed(inner)
    schema = StructType([*held.schema.fields, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))])
    judged = held.select("*", F.col(inner[text_col]).cast("string").alias("_text"))
    table = Table(judged.mapInArrow(_posteriors(model), schema), "posteriors", batch=128).read()
    again = _rated(table, targets).withColumn("n_tokens", F.explode(F.array_repeat(F.lit(0), copies(F.col("rate"), F.col(inner[id_col]), F.col(inner[text_col])))))
    return again.select(*(F.col(x).alias(c) for c, x in inner.items()))


def copies(rate: Column, key: Column, text: Column) -> Column:
    """A whole number of copies whose mean is the rate: its floor, and one more for a share of the rows.

    The share is drawn by a hash of id and text; rows with a null id are drawn one by one.
    """
    own = F.when(key.isNull(), F.monotonically_increasing_id())
    draw = F.pmod(F.xxhash64(key, text, own, F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("int")
