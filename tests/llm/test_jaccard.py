import random
import re

import numpy as np

from wavemark.llm.components import components
from wavemark.llm.jaccard import divide_skip, jaccard_classes, needed


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage, rows, i = [word() for _ in range(60)], [], 100
    for _ in range(60):
        base = [word() for _ in range(r.choice([0, 1, 3, 4, 5, 6, 12, 40, 90, 200]))]
        if r.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.choice([1, 1, 2, 5])):
            some = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if some:
                    some[r.randrange(len(some))] = word()
            rows.append((i, r.choice([" ", "\n", "\t ", "  "]).join(some).title() if r.random() < 0.2 else " ".join(some)))
            i += r.randint(1, 9)
    r.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    rows = [*corpus(), (1, None), (2, ""), (3, " \n\t"), (4, "x\xa0y z"), (5, "X\xa0Y Z"), (6, "one two"), (7, "ONE\x0btwo"), (8, "Éa b"), (9, "éa b")]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, h string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in jaccard_classes(docs).collect())
    assert got == [(-1, None), (4, 4), (4, 4), (7, 4)]
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(5000)}" for _ in range(40_000)]
    other = list(long)
    for k in range(0, 40_000, 60):  # a changed word takes five shingles out of sixty
        other[k] = "changed"
    rows = [(3, " ".join(long)), (9, "\n".join(other)), (1, " ".join(long[:20_000])), (5, " ".join(long[:30_000] + other[-10:])), (7, "one " * 30_000)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[9][1] == 3 and got[1][1] == 1


def test_divide_skip_counts_whole_overlaps():
    r = np.random.default_rng(5)
    for _ in range(40):
        query = np.unique(r.integers(0, 400, 150).astype(np.uint64))
        sets = [np.unique(np.concatenate((query[r.random(len(query)) < p], r.integers(0, 5000, k).astype(np.uint64)))) for p, k in ((1, 0), (0.9, 5), (0.85, 10), (0.5, 90), (0.95, 30))]
        for s, got in zip(sets, divide_skip(query, sets, 80), strict=True):
            both = len(set(query.tolist()) & set(s.tolist()))
            assert got == (both if both >= needed(len(query), len(s), 80) else 0)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
