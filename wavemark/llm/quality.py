"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a whole text. The votes of all documents are counted by vote pattern (at
most 3 to the number of labellers rows), EM over those counts estimates every labeller's accuracy on each class, and
the posterior of a document's pattern is its soft label. A logistic scorer over hashed features learns the soft labels.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to in that is was for it with as his on be at by this are or from an which
    der die und den von das mit sich des auf ist im dem nicht ein eine als auch es an zu
    le la les et des en un une du est que pour dans qui par sur au pas avec
    el los las y que se del por con una para como su al lo""".split()
)
DIMENSIONS = 1 << 14
LABELLERS = ("repeated words", "sign runs", "shouting", "table bars", "repeated lines", "letters", "function words", "variety", "word length")
_SIGNS = re.compile(r"([^\w\s])\1\1")
_SHAPE = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|\d+|\s+|(\W)\1*")


def measures(text: str) -> np.ndarray | None:
    """Whole-text shares that the labellers look at; None if there is no word."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    upper = letters = chars = function = signs = 0
    for w, k in counted.items():
        chars += k * len(w)
        if w.isalpha():
            letters += k * len(w)
            if w.isupper() and len(w) > 1:
                upper += k
        else:
            inside = sum(map(str.isalpha, w))
            letters += k * inside
            if inside > 1 and w.isupper():
                upper += k
            if len(w) > 2 and _SIGNS.search(w):
                signs += k
        if w.lower() in FUNCTION_WORDS:
            function += k
    bars = counted.get("|", 0)
    again = sum(map(str.__eq__, words, words[1:]))
    return np.array([again / n, signs / n, upper / n, bars / n, 1 - len(set(lines)) / len(lines), letters / chars, function / n, len(counted) / n, chars / n, n])


def votes(m: np.ndarray | None) -> tuple[int, ...]:
    """A vote of each labeller: 0 bad, 1 good, 2 nothing. Texts without words get bad votes alone.

    The first five look for one kind of junk each; their vote is good where they find none. The others vote where a
    measure is clearly high or low. A measure that a text is too short for gives no vote.
    """
    if m is None:
        return (0,) * len(LABELLERS)
    again, signs, upper, bars, lines, letters, function, variety, length, n = m.tolist()
    few = n < 20
    return (
        2 if n < 3 else 0 if again > 0.2 else 1,
        0 if signs > 0.1 else 1,
        2 if n < 3 else 0 if upper > 0.3 else 1,
        0 if bars > 0.1 else 1,
        2 if few else 0 if lines > 0.4 else 1,
        1 if letters > 0.93 else 0 if letters < 0.75 and not few else 2,
        2 if few else 0 if function < 0.02 else 1 if function > 0.08 else 2,
        2 if few else 0 if variety < 0.25 and n < 400 or variety < 0.1 else 1 if variety > 0.35 else 2,
        0 if length > 20 or length < 1.5 else 1 if 2.5 < length < 12 else 2,
    )


#: Where EM starts: chances that a labeller which votes calls a bad and a good document bad. Which class is the bad one follows from them.
START = np.array([[0.3, 0.002]] * 5 + [[0.5, 0.02]] * 3 + [[0.1, 0.02]])
#: Votes of each class that START counts as, so that no chance becomes 0 or 1.
START_VOTES = 20.0


def fit_accuracies(patterns: dict[tuple[int, ...], int], *, rounds: int = 200, good: float = 0.9, start: np.ndarray = START, start_votes: float = START_VOTES) -> tuple[np.ndarray, float]:
    """(each labeller's chance of a bad vote on bad and on good documents, the share of good ones), by EM.

    A labeller's accuracies are that chance on bad documents and the rest to one on good ones. Votes are taken as
    independent of each other within a class; a labeller without a vote says nothing about a document.
    """
    seen = np.array(list(patterns), np.int64).reshape(-1, len(start))
    weight = np.array(list(patterns.values()), np.float64)
    chance = start.copy()
    for _ in range(rounds if len(seen) else 0):
        q = posterior(seen, chance, good)
        good = float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        for c, share in enumerate((weight * (1 - q), weight * q)):
            bad, cast = share @ (seen == 0), share @ (seen < 2)
            chance[:, c] = (bad + start[:, c] * start_votes) / (cast + start_votes)
    return chance, good


def posterior(seen: np.ndarray, chance: np.ndarray, good: float) -> np.ndarray:
    """The chance that a document with these votes is good."""
    log = np.log(np.stack((chance, 1 - chance, np.ones_like(chance)), 2))
    k = np.arange(seen.shape[1])
    bad_log, good_log = log[k, 0, seen].sum(1) + np.log(1 - good), log[k, 1, seen].sum(1) + np.log(good)
    return 1 / (1 + np.exp(np.clip(bad_log - good_log, -500, 500)))


class _Shapes(dict):
    """Hashed bucket of a word's shape: runs of a kind of character as one sign."""

    def __missing__(self, word: str) -> int:
        def sign(m: re.Match) -> str:
            x = m[0]
            return "a" if x[0].islower() else "A" if x[0].isupper() and len(x) == 1 else "U" if x[0].isupper() else "9" if x[0].isdigit() else x[0] if len(x) == 1 else x[0] * 2 if len(x) == 2 else x[0] * 3

        found = zlib.crc32(_SHAPE.sub(sign, word).encode()) % (DIMENSIONS // 2)
        if len(self) < 100_000 and len(word) <= 200:  # longer words are seldom seen again
            self[word] = found
        return found


def features(text: str, m: np.ndarray | None, shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: shares of word shapes and of pairs of shapes, and each measure's level, hashed."""
    if m is None:
        return np.array([DIMENSIONS - 1]), np.array([1.0])
    words = text.split()
    one = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    two = (one[:-1] * 31 + one[1:] * 17 + 7) % (DIMENSIONS // 4) + DIMENSIONS // 2
    where, share = np.unique(np.concatenate((one, two)), return_counts=True)
    edges = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)
    level = np.array([zlib.crc32(f"{k}:{int(np.searchsorted(edges, x))}".encode()) % (DIMENSIONS // 4 - 1) + 3 * DIMENSIONS // 4 for k, x in enumerate(m[:8].tolist())])
    return np.concatenate((where, level)), np.concatenate((2 * np.sqrt(share / len(words)), np.ones(len(level))))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        for text in batch.column(0):
            key = "".join(map(str, votes(measures(text.as_py() or ""))))
            seen[key] = seen.get(key, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def _train(chance: np.ndarray, good: float, passes: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, rows, labels = _Shapes(), [], []
        for batch in batches:
            for text in batch.column(0):
                found = text.as_py() or ""
                m = measures(found)
                labels.append(votes(m))
                rows.append(features(found, m, shapes))
        if rows:
            w, b, q = np.zeros(DIMENSIONS), 0.0, posterior(np.array(labels), chance, good)
            order = np.random.default_rng(7)
            for k in range(passes):
                for i in order.permutation(len(rows)):
                    where, x = rows[i]
                    error = q[i] - 1 / (1 + np.exp(-np.clip(w[where] @ x + b, -30, 30)))
                    step = rate / (1 + k)
                    w[where] += step * error * x
                    b += step * error
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([np.append(w, b).tobytes()], pa.binary())], names=["n", "weights"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shapes = np.frombuffer(model.value), _Shapes()
        for batch in batches:
            scores = [_chance(t.as_py(), weights[:-1], weights[-1], shapes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def _filter(model, threshold: float):
    """Rows whose last column, the text, scores enough; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shapes = np.frombuffer(model.value), _Shapes()
        for batch in batches:
            at = batch.num_columns - 1
            keep = pa.array([_chance(t.as_py(), weights[:-1], weights[-1], shapes) >= threshold for t in batch.column(at)], pa.bool_())
            yield batch.remove_column(at).filter(keep)

    return run


def _chance(text: str | None, w: np.ndarray, b: float, shapes: _Shapes) -> float:
    found = text or ""
    where, x = features(found, measures(found), shapes)
    return float(1 / (1 + np.exp(-np.clip(w[where] @ x + b, -30, 30))))


def learn(rows: DataFrame, *, sample_rows: int = 20_000, parts: int = 4, passes: int = 4, rate: float = 0.5) -> np.ndarray:
    """The scorer's weights. Accuracies come from all rows of `rows` (doc_id, text).

    The scorer is fitted on about `sample_rows` of them (all, if there are fewer), drawn row by row whatever their ids
    and texts, in `parts` parts of equal size whose weights are averaged. The draw depends on how the table is read, so
    equal runs over equal files agree.
    """
    counted = rows.select("text").mapInArrow(_votes, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(map(int, r.pattern)): r.n for r in sorted(counted)}
    chance, good = fit_accuracies(patterns)
    total = sum(patterns.values())
    some = rows if total <= sample_rows else rows.where(F.rand(23) < sample_rows / total)
    found = some.select("doc_id", "text").repartition(parts).sortWithinPartitions("doc_id", "text").select("text").mapInArrow(_train(chance, good, passes, rate), "n long, weights binary").collect()
    if not found:
        return np.zeros(DIMENSIONS + 1)
    found.sort(key=lambda r: (r.n, bytes(r.weights)))  # sums of floats depend on their order
    return sum(r.n * np.frombuffer(r.weights) for r in found) / sum(r.n for r in found)


def score_quality(docs: DataFrame, *, threshold: float = 0.5, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and keep (score >= threshold).

    Null texts and texts without a word get bad votes alone and are scored by one feature of their own. Rows with null
    ids are scored like any other, repeated rows each; an empty table gives no rows; other columns are ignored, whatever
    their names. Votes and features are taken from whole texts, however long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, sample_rows=sample_rows).tobytes())
    return rows.mapInArrow(_score(model), "doc_id long, score double").withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, *, threshold: float = 0.5, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score_quality would keep; each row is decided where it is read.

    Null, empty and very long texts, null ids, repeated rows and empty tables are as for score_quality. Columns of any
    names come back as they were; the text column may be of any type that casts to a string.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, sample_rows=sample_rows).tobytes())
    judged = docs.select("*", F.col(text_col).cast("string").alias(free_name(docs)))
    return judged.mapInArrow(_filter(model, threshold), docs.schema)
