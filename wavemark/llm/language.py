"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name

#: Characters counted at a time; longer texts are counted in pieces that share their edges.
PIECE = 1 << 22
SPACE = 32
#: The least score of a language that is told: it outweighs all the others together, or equals them.
MAJORITY = 0.5
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once a worker."""
    global _letters
    if _letters is None:
        kinds = np.zeros(0x110000, bool)
        kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
        _letters = kinds
    return _letters


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and counts of the 1- to 3-grams of letters and single blanks; no gram has a blank inside."""
    c = codes.astype(np.int64)
    one = c[c != SPACE]
    two = c[:-1] << 21 | c[1:]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != SPACE]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the lower-cased text, with counts; anything but letters counts as a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(letters()[codes], codes, SPACE)
    codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)))]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(codes) <= PIECE:
        return _count(codes)
    cuts = [a for a in range(0, len(codes), PIECE)]
    cuts = [0, *(a + int(np.argmax(codes[a:] == SPACE)) for a in cuts[1:] if (codes[a:] == SPACE).any()), len(codes) - 1]
    found = [_count(codes[a : b + 1]) for a, b in zip(cuts, cuts[1:]) if b - a >= 2]
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys in rank order; equal counts go by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _partial_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = held.setdefault(lang, [])
            found.append(grams(text.as_py()))
            if len(found) > 200:
                held[lang] = [merged(found)]
    for lang, found in held.items():
        keys, counts = merged(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])


def learn_profiles(rows: DataFrame, *, size: int = 300, sample_rows: int = 20_000) -> dict[str, np.ndarray]:
    """lang -> its most frequent n-grams, from a sample of `rows` (doc_id, text, lang) of about `sample_rows` rows.

    The sample is drawn row by row, whatever the ids and texts, and is the same for equal runs over equal files. Counts
    are added before they leave a task; the driver gets `size` rows a language.
    """
    known = rows.where("text is not null and lang is not null")
    total = known.count()
    if total > sample_rows:
        known = known.where(F.rand(17) < sample_rows / total)
    counts = known.select("text", "lang").mapInArrow(_partial_profiles, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(keys, np.int64) for lang, keys in found.items()}


class Judge:
    """Compares a text's profile with each language's."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.size, self.names, self.sorted = size, sorted(profiles), []
        for name in self.names:
            order = np.argsort(profiles[name])
            self.sorted.append((profiles[name][order], order))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Distances from each language, divided by the greatest possible one; None without letters or languages."""
        keys, counts = grams(text) if text else (np.empty(0, np.int64), None)
        if not len(keys) or not self.names:
            return None
        mine, distances = top(keys, counts, self.size), []
        rank = np.arange(len(mine))
        for known, ranks in self.sorted:
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            distances.append(np.where(known[at] == mine, np.abs(rank - ranks[at]), self.size).sum() / (self.size * len(mine)))
        return np.array(distances)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score): the smallest distance, the first name on a tie; `und` and 0 without letters.

        The score is the best language's share under weights exp(-40 x distance), so texts as far from all languages
        score 1 / languages.
        """
        d = self.distances(text)
        return ("und", 0.0) if d is None else (self.names[int(d.argmin())], _share(d))

    def tells(self, text: str | None) -> bool:
        """Whether a language shares an n-gram with the text and has a score of one half at least."""
        d = self.distances(text)
        return d is not None and bool(d.min() < 1) and _share(d) >= MAJORITY


def _share(d: np.ndarray) -> float:
    weight = np.exp(-40 * (d - d.min()))
    return float(weight.max() / weight.sum())


def _predict(profiles, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles.value, size)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1] + ["lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    return run


def _filter(profiles, size: int):
    """Rows whose last column, the text, has a language that can be told; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles.value, size)
        for batch in batches:
            at = batch.num_columns - 1
            yield batch.remove_column(at).filter(pa.array([judge.tells(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, *, size: int = 300, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, whose language can be told, see Judge.tells; the others go.

    These are texts without a letter (`und`), texts that share no n-gram with any language learned, and texts too short
    or too mixed for one of three or more languages to make up half of the weight. Null, empty and very long texts, null
    ids, repeated rows and empty tables are as for identify. Columns of any names come back as they were; the text column
    may be of any type that casts to a string.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    profiles = docs.sparkSession.sparkContext.broadcast(learn_profiles(rows.where(~held_out(F.col("doc_id"))), size=size, sample_rows=sample_rows))
    judged = docs.select("*", F.col(text_col).cast("string").alias(free_name(docs)))
    return judged.mapInArrow(_filter(profiles, size), docs.schema)


def identify(docs: DataFrame, *, size: int = 300, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows of `docs` that are not held out.

    Null texts and texts without a letter are `und` with score 0, as is every row if there is nothing to learn from.
    Repeated rows are answered each, very long texts by all their n-grams; a null id is not held out. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    profiles = docs.sparkSession.sparkContext.broadcast(learn_profiles(rows.where(~held_out(F.col("doc_id"))), size=size, sample_rows=sample_rows))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_predict(profiles, size), "doc_id long, held_out boolean, lang_pred string, score double")
