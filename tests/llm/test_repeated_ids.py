import random

import corpus_pipeline as P
from wavemark.llm.jaccard import jaccard_classes


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def near(t):
    return t + " changed"


def test_each_text_of_an_id_is_compared(spark):
    p, q, s = text(1), text(2), text(3)
    rows = [(4, p), (4, q), (20, near(p)), (30, near(q)), (4, " "), (4, None), (50, s), (51, near(s)), (51, s)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_classes(docs).where("n_shingles > 0").collect()} == {4: 4, 20: 4, 30: 4, 50: 50, 51: 50}


def test_an_id_unites_the_groups_of_its_texts(spark):
    p, q = text(5), text(6)
    docs = spark.createDataFrame([(2, q), (4, p), (4, q), (9, near(p))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_classes(docs).collect()} == {(2, 2), (4, 2), (9, 2)}


def test_stage_keeps_every_text_that_resembles_nothing(spark):
    p, q, s, t = text(11), text(12), text(13), text(14)
    rows = [(4, p), (4, q), (4, q), (4, near(q)), (2, s), (7, near(s)), (7, t), (8, t), (None, p)]
    docs = spark.createDataFrame([(i, x, "en", "src", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) == 5 and set(kept) <= set(rows)
    assert {(4, p), (2, s), (None, p)} <= set(kept)
    assert sum(x in (q, near(q)) for _, x in kept) == 1 and sum(x == t for _, x in kept) == 1


def test_columns_of_any_names_come_through_every_stage(spark, tmp_path):
    """Names that the stages use inside, and the row that stays of several with one id and one text."""
    clashing = ["own", "lo", "n", "print", "id", "several", "c0", "c1", "__judged text", "inner0", "INNER1", "_text", "rate", "doc id", "r", "copies", "posterior"]
    texts = ["the river and the stone that was in the long valley with a green hill " + text(k) for k in range(30)]
    rows = [(k, t, "en", "s", len(t), *(f"{c}{k}" for c in clashing)) for k, t in enumerate(texts)]
    twice = [(3, texts[3], "en", f"s{x}", 5, *(f"{c}-{x}" for c in clashing)) for x in "zab"]
    docs = spark.createDataFrame(rows + twice, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing))
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = {tuple(r) for r in docs.collect()}
    for name, stage in P.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= known
        if name == "near_duplicates":
            kept = {r.doc_id: tuple(r) for r in got.collect()}
            assert got.count() == 30 and kept[3] == min((x for x in known if x[0] == 3), key=lambda x: x[3])
            again = stage(spark, docs.repartition(7, "source"), str(tmp_path))
            assert sorted(map(tuple, again.collect())) == sorted(kept.values())
