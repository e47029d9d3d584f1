"""Whitening of embeddings: singular value decompositions of partitions, merged level by level without losing a dimension.

A part of the rows is kept as its count, its exact sums, its singular values and its right singular vectors, all of them.
Two parts are merged by decomposing their scaled vectors one below the other with a row for the distance of their means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Table, cpu_env
from .neighbours import matrices

#: How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on can't be scaled and added up, and count as not finite.
LARGEST = 2.0**40
#: Parts that are merged at a time.
FAN_IN = 16
#: An eigenvalue under this share of the largest is rounding, not a direction.
FLAT = 1e-13
_PART = "dims int, part long, n long, sums string, values binary, vectors binary"
_MOMENT = "dims int, part long, n long, mean binary, products binary"


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v.astype(np.float64)).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact; divided by n it is what an entry has over the mean."""
    widest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    return n * x - np.array(sums, np.int64) if widest < 2**61 else n * x.astype(object) - np.array(sums, object)


class Fit:
    """Rows seen so far: n, exact sums, and singular values and vectors of the rows less their mean."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Fit:
        n, sums = len(x), [int(s) for s in x.sum(0)]
        centred = (deviations(x, n, sums) / n).astype(np.float64)
        return cls(n, sums, *cls._decomposed(centred))

    @staticmethod
    def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, values, vectors = np.linalg.svd(np.linalg.qr(rows, mode="r"), full_matrices=False)
        return values, vectors

    def merged(self, other: Fit) -> Fit:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = apart * np.sqrt(self.n * (other.n / n))
        rows = np.concatenate((self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, row[None]))
        return Fit(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *self._decomposed(rows))

    def dumps(self) -> dict:
        return {"n": self.n, "sums": ",".join(map(str, self.sums)), "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @classmethod
    def loads(cls, row, dims: int) -> Fit:
        return cls(int(row["n"]), [int(s) for s in row["sums"].split(",")], np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(-1, dims))


class Model:
    """What every row is whitened with: n, sums, and up to `most` components by falling eigenvalue."""

    def __init__(self, fit: Fit, most: int):
        dims = len(fit.sums)
        variances = np.zeros(dims)
        variances[: len(fit.values)] = fit.values**2 / fit.n
        vectors = np.zeros((dims, dims))
        vectors[: len(fit.vectors)] = fit.vectors
        self.n, self.sums, self.most = fit.n, fit.sums, min(most, dims)
        total = variances.sum()
        e, v = variances[: self.most], vectors[: self.most]
        sign = np.sign(v[np.arange(self.most), np.abs(v).argmax(1)])
        self.steep = e > FLAT * variances[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.project = np.where(self.steep, (v * sign[:, None]).T / np.sqrt(e), np.nan)
            self.explained = e / total

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviation as n x - S, whitened) of the rows; a component without a direction gives NaN."""
        d = deviations(x, self.n, self.sums)
        return d, (d / self.n).astype(np.float64) @ self.project


class Moments:
    """n, mean and centred products of whitened rows."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, w: np.ndarray) -> Moments:
        mean = w.mean(0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def merged(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * (other.n / n)))

    def dumps(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "products": self.products.tobytes()}

    @classmethod
    def loads(cls, row, dims: int) -> Moments:
        mean = np.frombuffer(row["mean"])
        return cls(int(row["n"]), mean, np.frombuffer(row["products"]).reshape(len(mean), len(mean)))


def _per_task(make: Callable, kind: np.dtype, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a task and length of vectors, of all its batches."""
        cpu_env()
        found: dict[int, Fit | Moments] = {}
        for batch in batches:
            for _, v in matrices(batch.column(0), kind):
                part = make(whole(v), v.shape[1])
                found[v.shape[1]] = found[v.shape[1]].merged(part) if v.shape[1] in found else part
        rows = [{"dims": dims, "part": TaskContext.get().partitionId(), **part.dumps()} for dims, part in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, types, strict=True))))

    return run


def _tree(parts: DataFrame, of: type, schema: str) -> list:
    """The parts merged FAN_IN at a time until one is left for each length of vectors; that one is read."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        cpu_env()
        rows = pdf.sort_values("part").to_dict("records")
        dims, all_ = int(rows[0]["dims"]), None
        for row in rows:
            one = of.loads(row, dims)
            all_ = one if all_ is None else all_.merged(one)
        return pd.DataFrame([{"dims": dims, "part": int(rows[0]["part"]) // FAN_IN, **all_.dumps()}])

    left = (parts.agg(F.max("part").alias("last")).first().last or 0) + 1
    while True:
        parts, left = parts.groupBy("dims", F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(merge, schema), -(-left // FAN_IN)
        if left == 1:
            return [(r["dims"], of.loads(r, r["dims"])) for r in parts.collect()]


def whiten(vectors: DataFrame, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    An entry c counts as floor(64 c) + 1,000,000. Rows whose vector is null, empty or holds null or non-finite entries (or
    such of 2^40 and more) are left out; vectors of each length are a fit of their own. Repeated rows and ids count as
    often as they come, a null id stays null. Vectors shorter than `components` have as many components as entries. A
    component along which the rows don't differ (all, for a single row) has explained 0 (null if no component has any) and
    whitened null. `deviation` is null where it doesn't fit in a long. `identity_error` is measured over all whitened rows.
    An empty table gives no rows; other columns, whatever their names, are ignored.

    Three scans and no shuffle but that of the parts, each of which holds a square of the dimensions.
    """
    type_ = vectors.schema[vector_col].dataType
    narrow = isinstance(type_, ArrayType) and isinstance(type_.elementType, FloatType)
    kind, element = np.dtype("<f4" if narrow else "<f8"), "float" if narrow else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("embedding"))
    sound = rows.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)))
    fitted = Table(sound.select("embedding").mapInArrow(_per_task(lambda x, dims: Fit.of(x), kind, _PART), _PART), "whitening-parts")
    models = {dims: Model(fit, components) for dims, fit in _tree(fitted.read(), Fit, _PART)}
    fitted.drop()
    seen = _per_task(lambda x, dims: Moments.of(models[dims](x)[1][:, models[dims].steep]), kind, _MOMENT)
    measured = Table(sound.select("embedding").mapInArrow(seen, _MOMENT), "whitening-moments")
    errors = {dims: float(np.abs(m.products / m.n - np.eye(len(m.mean))).max(initial=0)) for dims, m in _tree(measured.read(), Moments, _MOMENT)}
    measured.drop()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cpu_env()
        for batch in batches:
            for at, v in matrices(batch.column(1), kind):
                model, dims = models[v.shape[1]], v.shape[1]
                d, w = model(whole(v))
                square = (d.astype(np.float64) ** 2).sum(1)
                large = square > 2.0**62  # these are added up as integers of any size
                exact = np.where(large, 0, (np.where(large[:, None], 0, d) ** 2).sum(1)).astype(np.int64).tolist()
                for k in np.flatnonzero(large):
                    total = sum(int(y) ** 2 for y in d[k])
                    exact[k] = total if total < 2**63 else None
                take, most = pa.array(np.repeat(at, model.most)), model.most
                columns = [
                    batch.column(0).take(take), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(at))), pa.array(np.full(len(take), model.n)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), most))), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(at)), from_pandas=True), pa.array(np.full(len(take), errors[dims])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return sound.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
