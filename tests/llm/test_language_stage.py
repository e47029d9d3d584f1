"""The language stage drops rows that the quality stage keeps, and the stages after it don't see them."""

import random

import corpus_pipeline as P
from wavemark.llm import language

LANGS = {
    "en": "the quick brown fox jumps over that lazy dog with this and those others there",
    "de": "der schnelle braune fuchs springt über den faulen hund und die katze nicht",
    "es": "el rápido zorro marrón salta sobre aquel perro perezoso y los gatos también",
}
OTHER = "река в долине была длинной и шла к морю с друзьями на холме где стоял старый дом"


def words(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(LANGS[lang].split()) for _ in range(n))


def test_texts_of_no_learned_language_reach_no_later_stage(spark, tmp_path):
    rows = [(i, words(lang, i), lang) for i in range(90) for lang in [list(LANGS)[i % 3]]]
    rows += [(900, OTHER, None), (901, "河流 在 山谷 里 很 长", None), (902, "Й", None), (903, words("de", 1).upper(), None), (904, words("es", 2), "en"), (905, words("en", 3, 60) + " " + words("de", 4, 12), None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    good = P.Table(P.quality_stage(spark, docs, folder), "good").read()
    assert {r.doc_id for r in good.collect()} == {r[0] for r in rows}
    known = sorted(map(tuple, P.language_stage(spark, good, folder).collect()))
    assert known == [r for r in rows if r[0] not in (900, 901, 902)]
    packed = {r.doc_id for r in P.run(spark, folder).collect()}
    assert packed and not packed & {900, 901, 902}


def test_what_can_be_told(spark):
    def judge(*names):
        rows = spark.createDataFrame([(lang, words(lang, i)) for i in range(20) for lang in names], "lang string, text string")
        return language.Judge(language.learn_profiles(rows), 300)

    one, two, three = judge("en"), judge("en", "de"), judge("en", "de", "es")
    for j in (one, two, three):
        assert [j.tells(t) for t in (None, "", "12 3!", OTHER, words("en", 99))] == [False, False, False, False, True]
    assert three(OTHER)[1] == 1 / 3 and two(OTHER)[1] == 0.5  # a score alone can't tell two languages from none
