import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wavemark.llm import search
from wavemark.llm.search import top_k


def tokens(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    bags = [(i, tokens(t)) for i, t in docs]
    n, average = len(bags), max(1.0, sum(len(b) for _, b in bags) / len(bags))
    df, out = {}, []
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    for q, text in queries:
        scored = []
        for i, b in bags:
            s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / average)) for t in set(tokens(text)) if t in b)
            if s > 0:
                scored.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def same(got, want):
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got)
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in sorted(want)]
    for (q, r, d, s), (_, _, e, x) in zip(got, sorted(want), strict=True):
        close = 1e-9 * max(1.0, x)  # a text of 60,000 terms has a score of thousands
        assert abs(s - x) < close and (d == e or abs(s - next(y for a, b, _, y in want if (a, b) == (q, r))) < close)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(i * 5, " ".join(r.choices(vocabulary, weight, k=r.choice([0, 3, 20, 80])))) for i in range(n)]
    return rows + [(n * 5 + 5 + k * 5, rows[50][1]) for k in range(15)] + [(1, None), (2, "!!"), (3, "ÉTÉ été w1. W2-w3")]


def test_same_as_brute_force(spark, monkeypatch):
    rows = corpus(300, 1)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, shard string, score double")
    queries = [(i, t) for i, t in rows if i % 50 == 0 or i == 3]
    monkeypatch.setattr(search, "SHARD_DOCS", 100)
    got = top_k(docs, docs.where("doc_id % 50 = 0 or doc_id = 3"), k=10).collect()
    same(got, brute(rows, queries, 10))
    assert top_k(docs.limit(0), docs.limit(0)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    rows = corpus(60, 4) + [(50_000, " ".join(f"w{k % 390} x{k}" for k in range(30_000))), (50_050, "w3 " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in rows], "doc_id long, text string, rank int, score double, query_id string")
    queries = [(i, t) for i, t in rows if i % 50 == 0]
    same(top_k(docs, docs.where("doc_id % 50 = 0"), k=5).collect(), brute(rows, queries, 5))


def test_terms_of_pieces(monkeypatch):
    texts = ["A b, b2 É.É  a" * 5, None, "", "z" * 200, "one two one", "  !!  "]
    want = [sorted(Counter(tokens(t)).values()) for t in texts]
    for most in (8, 1 << 20):
        monkeypatch.setattr(search, "TEXT_BYTES", most)
        row, key, times = search.terms([t and t.encode() for t in texts])
        assert [sorted(times[row == k].tolist()) for k in range(len(texts))] == want
        assert all(len(set(key[row == k].tolist())) == (row == k).sum() for k in range(len(texts)))


def whole_shard(rows, order):
    doc, key, tf = search.terms([(rows[i][1] or "").encode() for i in order])
    lengths = np.bincount(doc, tf, len(order)).astype(np.int64)
    shard = search.Shard.loads(search.Shard.of(doc, key, tf, [rows[i][0] for i in order], lengths).dumps())
    return shard


@pytest.mark.parametrize("at_a_time", [1 << 20, 300])
def test_pruning_changes_nothing(monkeypatch, at_a_time):
    """Two shards one after another, queries together, against all scores."""
    monkeypatch.setattr(search, "ENTRIES_AT_A_TIME", at_a_time)
    rows = corpus(2000, 2)
    shards = [whole_shard(rows, range(0, 1200)), whole_shard(rows, range(1200, len(rows)))]
    average = sum(s.lengths.sum() for s in shards) / len(rows)
    asked = list(range(0, 2000, 37))
    row, key, _ = search.terms([(rows[i][1] or "").encode() for i in asked])
    starts = np.searchsorted(row, np.arange(len(asked) + 1))
    df = Counter()
    for s in shards:
        df.update(dict(zip(s.terms.tolist(), np.diff(s.starts).tolist(), strict=True)))
    idf = np.array([math.log1p((len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in key.tolist()])
    best, pivots = [(np.empty(0), np.empty(0, np.int64))] * len(asked), []
    for s in shards:
        s.prepare(average)
        pivots.append(s.top(starts, key, idf, 10, best))
    assert pivots[1] < len(asked) * shards[1].blocks  # some blocks are skipped
    for n in range(len(asked)):
        scores, ids = np.zeros(len(rows)), np.concatenate([s.ids for s in shards])
        for a in range(starts[n], starts[n + 1]):
            base = 0
            for s in shards:
                x = int(np.searchsorted(s.terms, key[a]))
                if x < len(s.terms) and s.terms[x] == key[a]:
                    span = slice(s.starts[x], s.starts[x + 1])
                    tf = s.tfs[span].astype(float)
                    scores[base + s.docs[span].astype(int)] += idf[a] * (tf * 2.2 / (tf + s.norm[s.docs[span]]))
                base += len(s.ids)
        want = [d for d in np.lexsort((ids, -np.round(scores, 9)))[:10] if scores[d] > 0]
        assert np.allclose(best[n][0], scores[want]) and len(best[n][0]) == len(want)


def test_queries_with_like_terms_are_handled_together(spark):
    """Of two kinds of queries that share no term, one comes after the other; their terms and weights stay theirs."""
    r = random.Random(3)
    asked = {i: sorted(r.sample(range(1000 * (i % 2), 1000 * (i % 2) + 90), r.choice([5, 30]))) for i in range(160)}
    pairs = spark.createDataFrame([(i, [(t, t % 7 + 1) for t in r.sample(x, len(x))], 0) for i, x in asked.items()], "query_id long, pairs array<struct<term: long, df: long>>, part int")
    ids, starts, numbers, terms, idfs, _ = search._block(pairs.repartition(3), 0, 500, 9.0)
    assert sorted(ids.tolist()) == list(range(160)) and (np.diff(ids % 2) != 0).sum() == 1
    for n, i in enumerate(ids.tolist()):
        own = numbers[starts[n] : starts[n + 1]]
        assert terms[own].tolist() == asked[i] and np.allclose(idfs[own], [math.log1p((500 - t % 7 - 0.5) / (t % 7 + 1.5)) for t in asked[i]])
    empty = search._block(pairs.limit(0), 0, 500, 9.0)
    assert [len(x) for x in empty[:5]] == [0, 1, 0, 0, 0]
