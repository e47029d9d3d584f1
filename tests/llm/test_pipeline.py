import random

import numpy as np
import pytest

import corpus_pipeline as P

WORDS = "the river that was in valley long and runs to sea with his friends at noon green hill stone bird".split()


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < 0.6 else "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))


def near(t, seed):
    words = t.split()
    words[random.Random(seed).randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = [(i, text(i), ["en", "de"][i % 2]) for i in range(150)]
    rows = base + [(200 + i, near(text(i), i), "en") for i in range(12)] + [(300 + i, text(50 + i), "de") for i in range(5)]
    rows += [(400 + i, "JUNK!! TEXT!! " * 30, "en") for i in range(8)] + [(500, None, "en"), (501, "", "en"), (502, "12 34 5678 " * 12, "en"), (149, base[149][1], "en"), (None, text(999), None)]
    rows += [(600 + i, text(700 + i) + " vile nasty scum", "en") for i in range(12)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(path + "/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 140)] + [(600 + i, 1, 1) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    good = P.quality_stage(spark, docs, sf_dir).cache()
    ids = [r.doc_id for r in good.collect()]
    assert set(range(150)) <= set(ids) and not set(ids) & {*range(400, 408), 500, 501} and None in ids and ids.count(149) == 2
    known = P.language_stage(spark, docs, sf_dir)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert gone == {500, 501, 502}
    one = P.duplicate_stage(spark, good, sf_dir)
    kept = sorted((r.doc_id for r in one.collect()), key=lambda i: (i is None, i))
    assert kept == sorted(set(ids) - {*range(200, 212), *range(300, 305)}, key=lambda i: (i is None, i))
    mixed = P.mixing_stage(spark, one, sf_dir)
    left = [r.doc_id for r in mixed.collect()]
    assert set(range(0, 140)) <= set(left) and sum(600 <= (i or 0) < 612 for i in left) < 12
    for stage in (good, known, one, mixed):
        assert stage.columns == docs.columns
    good.unpersist()


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def shingles(t):
    words = t.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_every_stage_equals_a_brute_force_version(spark, sf_dir):
    """Stage by stage on what the one before kept: decisions by the models' own scores, groups by all pairs of sets,
    copies by rates and draws, pieces by the tokenizer."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from wavemark.llm import language, mixing, quality
    from wavemark.llm.queries import domain_labels, vocabulary_file

    def rows_of(df):
        return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)

    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    whole = rows_of(docs)
    # quality
    weights = quality.learn(docs.select("doc_id", "text"))
    scores = {t: quality._chance(t, weights[:-1], weights[-1], quality._Shapes()) for _, t, *_ in whole}
    good = P.Table(P.quality_stage(spark, docs, sf_dir), "t1").read()
    want = [r for r in whole if scores[r[1]] >= 0.5]
    assert rows_of(good) == want
    # language
    profiles = language.learn_profiles(good.where(~language.held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    judge = language.Judge(profiles, 300)
    known = P.Table(P.language_stage(spark, good, sf_dir), "t2").read()
    want = [r for r in want if judge(r[1])[0] != "und"]
    assert rows_of(known) == want
    # near duplicates
    sets, label = [shingles(t) for _, t, *_ in want], list(range(len(want)))
    for _ in want:
        for a in range(len(want)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    first = {}
    for k, r in enumerate(want):
        if r[0] is not None and (label[k] not in first or r[0] < first[label[k]][0]):
            first[label[k]] = r
    one = P.Table(P.duplicate_stage(spark, known, sf_dir), "t3").read()
    want = sorted([*first.values(), *(r for r in want if r[0] is None)], key=repr)
    assert rows_of(one) == want
    # mixing
    rated = {r.doc_id: r.rate for r in mixing.mix(one, domain_labels(spark, sf_dir), P.TARGETS).collect()}
    draws = {r.doc_id: r.d for r in one.where("doc_id is not null").select("doc_id", (F.pmod(F.xxhash64("doc_id", "text", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)).alias("d")).collect()}
    mixed = P.Table(P.mixing_stage(spark, one, sf_dir), "t4").read()
    copies = {r[0]: int(np.floor(rated[r[0]] + draws[r[0]])) for r in want if r[0] is not None}
    assert [r for r in rows_of(mixed) if r[0] is not None] == sorted([r for r in want if r[0] is not None for _ in range(copies[r[0]])], key=repr)
    assert sum(copies.values()) > 100
    # packing
    coder, pieces = Tokenizer.from_file(vocabulary_file()), []
    for doc_id, t, *_ in rows_of(mixed):
        n = len(coder.encode(t, add_special_tokens=False).ids) + 1
        pieces += [(str(doc_id), k, at, min(2048, n - at)) for k, at in enumerate(range(0, n, 2048))]
    got = P.packing_stage(spark, mixed, sf_dir).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length) for r in got) == sorted(pieces)
