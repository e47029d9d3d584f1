"""Main-text extraction by a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_blocks import Block, blocks
from .page_samples import page

Model = tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]


def _level(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


def features(b: Block, k: int, n: int) -> list[str]:
    """Ancestor tags, names of ancestors, and what the text looks like."""
    words = b.text.count(" ") + 1
    size, link = _level(words, (1, 2, 4, 8, 16, 32, 64)), _level(b.linked / len(b.text), (0.0, 0.3, 0.7))
    out = ["bias", f"tag={b.tag}", f"words={size}", f"links={link}", f"words,links={size},{link}", f"ends={b.text[-1] if b.text[-1] in '.!?:' else '-'}", f"first={k == 0}", f"place={_level((k + 0.5) / n, (0.1, 0.25, 0.75, 0.9))}", f"depth={min(len(b.ancestors), 6)}"]
    out += [f"in={t}" for t in b.ancestors]
    out += [f"name={h}" for h in b.hints]
    parent = b.ancestors[-2] if len(b.ancestors) > 1 else "-"
    out += [f"tag,words={b.tag},{size}", f"named={bool(b.hints)}", f"path={parent}>{b.tag}", f"path,links={parent}>{b.tag},{link}"]
    if "©" in b.text or words < 32 and "copyright" in b.text.lower():
        out.append("copyright")
    return out


def _forward_backward(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each block, and summed chances of each step between labels."""
    n = len(score)
    left, right = np.empty((n, 2)), np.zeros((n, 2))
    left[0] = score[0]
    for k in range(1, n):
        left[k] = score[k] + np.logaddexp(left[k - 1, 0] + move[0], left[k - 1, 1] + move[1])
    for k in range(n - 2, -1, -1):
        after = score[k + 1] + right[k + 1]
        right[k] = np.logaddexp(move[:, 0] + after[0], move[:, 1] + after[1])
    total = np.logaddexp(*left[-1])
    steps = np.exp(left[:-1, :, None] + move + (score + right)[1:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
    return np.exp(left + right - total), steps


@lru_cache(maxsize=2)
def train(pages: int = 1000, passes: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Weights per feature and label, moves between labels and the start's, by AdaGrad on the conditional likelihood."""
    rows, names = [], {}
    for seed in range(pages):
        text, labels = page(seed)
        found = blocks(text)
        if len(found) != len(labels):
            raise AssertionError(f"page {seed}: {len(found)} blocks, {len(labels)} labels")
        rows.append(([[names.setdefault(f, len(names)) for f in features(b, k, len(found))] for k, b in enumerate(found)], np.array(labels, np.int64)))
    w, move, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full(w.shape, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    order = np.random.default_rng(3)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            found, labels = rows[i]
            if not found:
                continue
            flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
            score = np.zeros((len(found), 2))
            np.add.at(score, owner, w[flat])
            score[0] += start
            chance, steps = _forward_backward(score, move)
            error = -chance
            error[np.arange(len(labels)), labels] += 1
            slope = np.zeros_like(w)
            np.add.at(slope, flat, error[owner])
            used = np.unique(flat)
            slope = slope[used] - decay * w[used]
            gw[used] += slope**2
            w[used] += rate * slope / np.sqrt(gw[used])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            gm += (seen - steps) ** 2
            move += rate * (seen - steps) / np.sqrt(gm)
            gs += error[0] ** 2
            start += rate * error[0] / np.sqrt(gs)
    return {f: w[k] for f, k in names.items()}, move, start


def viterbi(score: list[list[float]], move: list[list[float]]) -> list[int]:
    """The best label sequence; the lower label wins ties."""
    if not score:
        return []
    (m00, m01), (m10, m11) = move
    a, b, back = score[0][0], score[0][1], []
    for s0, s1 in score[1:]:
        back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
        a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
    best = [int(b > a)]
    for step in reversed(back):
        best.append(step[best[-1]])
    return best[::-1]


class _Named(NamedTuple):
    """The hints that the model has weights for."""

    weights: Mapping[str, object]

    def __contains__(self, hint: object) -> bool:
        return f"name={hint}" in self.weights


def main_text(text: str | None, model: Model) -> str:
    """The article blocks of a page joined by one space; empty if there are none."""
    weights, move, start = model
    found = blocks(text, _Named(weights))
    score = []
    for k, b in enumerate(found):
        s0 = s1 = 0.0
        for f in features(b, k, len(found)):
            if (w := weights.get(f)) is not None:
                s0 += w[0]
                s1 += w[1]
        score.append([s0, s1])
    if score:
        score[0] = [score[0][0] + start[0], score[0][1] + start[1]]
    return " ".join(b.text for b, keep in zip(found, viterbi(score, move), strict=True) if keep)


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, move, start = model.value
        plain = ({f: w.tolist() for f, w in weights.items()}, move.tolist(), start.tolist())
        for batch in batches:
            found = [main_text(t.as_py(), plain) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", samples: int = 1000) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null and empty pages give an empty text. Rows with null ids or urls are read like any other, repeated rows each;
    pages are read whole, however long or deeply nested. An empty table gives no rows; other columns, also such as are
    named like those of the result, are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(train(samples))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
