import zlib

import numpy as np
import pytest

from wavemark.llm import language, mixing, quality

CLEAN = "the river that was in the valley is long and it runs to the sea with his friends at noon"
JUNK = ["word " * 60, "THE BAD!! SHOUT!! OF THIS!! " * 12, "sign### odd$$$ and*** some%%% " * 12, "cell | other | third | next | " * 12]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def vary(k):
    r = np.random.default_rng(k)
    words = CLEAN.split() * 4
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 8))) if r.random() < 0.5 else w for w in words)


def test_quality_rejects_junk_and_keeps_clean_texts(spark):
    rows = [(i, vary(i)) for i in range(300)] + [(1000 + i, JUNK[i % 4]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " \n"), (5, vary(5)), (None, vary(7))]
    docs = frame(spark, [(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, keep string, score double")
    got = [(r.doc_id, r.keep, r.score) for r in quality.score_quality(docs).collect()]
    assert len(got) == len(rows)
    for doc_id, keep, score in got:
        assert 0 <= score <= 1
        assert keep == (doc_id is None or doc_id < 1000)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((i or -1) for i, keep, _ in got if keep)
    assert quality.score_quality(docs.limit(0)).count() == 0


def simulated(bad_on_bad, bad_on_good, good_share, silent, n=20000, seed=2):
    """Vote patterns of labellers that are independent within a class."""
    r = np.random.default_rng(seed)
    good = r.random(n) < good_share
    chance = np.where(good[:, None], bad_on_good, bad_on_bad)
    vote = np.where(r.random(chance.shape) < chance, 0, 1)
    vote[r.random(chance.shape) < silent] = 2
    patterns = {}
    for key in map(tuple, vote.tolist()):
        patterns[key] = patterns.get(key, 0) + 1
    return patterns, good


@pytest.mark.parametrize("bad_on_bad, bad_on_good, good_share, silent", [([0.9] * 9, [0.02] * 9, 0.9, 0.0), ([0.85, 0.6, 0.75, 0.9, 0.5, 0.7, 0.95, 0.8, 0.65], [0.15, 0.05, 0.1, 0.02, 0.1, 0.2, 0.05, 0.1, 0.02], 0.8, 0.2)])
def test_em_finds_accuracies_that_it_was_not_given(bad_on_bad, bad_on_good, good_share, silent):
    patterns, _ = simulated(np.array(bad_on_bad), np.array(bad_on_good), good_share, silent)
    chance, share = quality.fit_accuracies(patterns)
    assert np.abs(quality.START[:, 0] - bad_on_bad).max() > 0.3
    assert share == pytest.approx(good_share, abs=0.02)
    assert np.abs(chance[:, 0] - bad_on_bad).max() < 0.05 and np.abs(chance[:, 1] - bad_on_good).max() < 0.05


def test_em_equals_plain_loops_over_documents():
    patterns, _ = simulated(np.linspace(0.4, 0.9, 9), np.linspace(0.01, 0.1, 9), 0.85, 0.3, 300, 5)
    docs = [p for p, n in patterns.items() for _ in range(n)]
    chance, good = quality.START.tolist(), 0.9

    def good_chance(votes):
        bad_p, good_p = 1 - good, good
        for (on_bad, on_good), v in zip(chance, votes, strict=True):
            if v < 2:
                bad_p *= on_bad if v == 0 else 1 - on_bad
                good_p *= on_good if v == 0 else 1 - on_good
        return good_p / (good_p + bad_p)

    for _ in range(25):
        q = [good_chance(d) for d in docs]
        good, old = sum(q) / len(q), quality.START
        chance = [[(sum(s for s, d in zip(w, docs, strict=True) if d[k] == 0) + old[k, c] * quality.START_VOTES) / (sum(s for s, d in zip(w, docs, strict=True) if d[k] < 2) + quality.START_VOTES) for c, w in enumerate(([1 - x for x in q], q))] for k in range(9)]
    got, share = quality.fit_accuracies(patterns, rounds=25)
    assert np.allclose(got, chance) and share == pytest.approx(good)
    assert np.allclose(quality.posterior(np.array(docs[:20]), got, share), [good_chance(d) for d in docs[:20]])


def test_null_ids_are_drawn_row_by_row(spark):
    rows = [(None, vary(i)) for i in range(300)] + [(None, JUNK[i % 4] + str(i)) for i in range(60)]
    for sample, most in ((120, 330), (20_000, 305)):  # a hundred rows teach less, but they are drawn
        got = quality.score_quality(frame(spark, rows), sample_rows=sample).collect()
        assert 290 <= sum(r.keep for r in got) <= most


def test_scorer_equals_a_plain_one(spark):
    """The whole query again, document by document, with dicts."""
    rows = [(i, vary(i)) for i in range(60)] + [(100 + i, JUNK[i % 4] + " x" * i) for i in range(12)] + [(200, None), (201, "a " * 3000)]
    texts = sorted(t or "" for _, t in rows)
    patterns = {}
    for t in texts:
        key = quality.votes(quality.measures(t))
        patterns[key] = patterns.get(key, 0) + 1
    chance, good = quality.fit_accuracies(patterns)

    def sparse(t):
        where, x = quality.features(t, quality.measures(t), quality._Shapes())
        return dict(zip(where.tolist(), x.tolist(), strict=True))

    def sigmoid(t, w, b):
        return 1 / (1 + np.exp(-np.clip(sum(w.get(k, 0) * x for k, x in sparse(t).items()) + b, -30, 30)))

    in_order = [t or "" for _, t in sorted(rows)]
    soft = [float(quality.posterior(np.array([quality.votes(quality.measures(t))]), chance, good)[0]) for t in in_order]
    w, b, order = {}, 0.0, np.random.default_rng(7)
    for k in range(4):
        for i in order.permutation(len(in_order)):
            step = 0.5 / (1 + k) * (soft[i] - sigmoid(in_order[i], w, b))
            for at, x in sparse(in_order[i]).items():
                w[at] = w.get(at, 0) + step * x
            b += step
    model = quality.learn(frame(spark, rows), parts=1)
    assert np.allclose([model[k] for k in w], list(w.values())) and model[-1] == pytest.approx(b)


def test_grams_count_what_a_plain_loop_counts():
    for text in ("Añb ab, AB!", "x", " ", "1 2", "ab" * 50 + " é", "\U0001f600a"):
        lower = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        padded, want = f" {lower} " if lower else "", {}
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    key = sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g))
                    want[key] = want.get(key, 0) + 1
        keys, counts = language.grams(text)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want


def test_pieces_give_the_same_counts(monkeypatch):
    text = " ".join(vary(k) for k in range(4))
    whole = language.grams(text)
    monkeypatch.setattr(language, "PIECE", 100)
    part = language.grams(text)
    assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


LANGS = {"en": "the quick brown fox jumps over that lazy dog with this and those others there", "de": "der schnelle braune fuchs springt über den faulen hund und die katze nicht", "es": "el rápido zorro marrón salta sobre aquel perro perezoso y los gatos también"}


def test_language_of_held_out_rows(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(LANGS[lang].split())), lang) for i in range(90) for lang in [list(LANGS)[i % 3]]]
    rows += [(200, None, "en"), (201, "123 !", "en"), (202, "", None), (203, LANGS["de"].upper(), None), (None, LANGS["es"], "es")]
    got = {r.doc_id: r for r in language.identify(frame(spark, [(*x, "c") for x in rows], "doc_id long, text string, lang string, score string")).collect()}
    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if i in (200, 201, 202):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (lang or "de") and 0 < r.score <= 1
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    assert language.keep_identified(docs).count() == len(rows) - 3
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}


def test_rates_meet_the_targets_and_equal_a_dense_solver(spark):
    r = np.random.default_rng(4)
    n, p = r.integers(0, 500, 400), r.dirichlet((0.3, 0.3, 0.3), 400)
    rows = frame(spark, [(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    targets = {"a": 0.7, "b": 0.2, "c": 0.1}
    rate, reached, met = mixing.fit_rates(rows, targets, tolerance=2e-4)
    assert met
    rates = np.array([x.r for x in rows.select(rate.alias("r")).collect()])
    assert (rates >= 0).all()
    got = (n * rates) @ p / n.sum()
    assert np.abs(got - [0.7, 0.2, 0.1]).max() < 1e-3
    assert np.allclose(got, reached, atol=1e-6)


def test_mixing_moves_domains_and_handles_odd_rows(spark):
    rows = [(i, f"good fine text number {i} of the set") for i in range(80)] + [(100 + i, f"vile nasty text number {i} of the set") for i in range(20)] + [(300, None), (301, ""), (None, "good")]
    labels = frame(spark, [(i, "clean") for i in range(80)] + [(100 + i, "toxic") for i in range(20)] + [(None, "toxic"), (3, None)], "doc_id long, domain string")
    docs = frame(spark, [(*x, "y") for x in rows], "doc_id long, text string, rate string")
    got = mixing.mix(docs, labels, {"clean": 0.95, "toxic": 0.05}).collect()
    assert len(got) == len(rows)
    bad = [r.rate for r in got if r.doc_id and 100 <= r.doc_id < 120]
    good = [r.rate for r in got if r.doc_id is not None and r.doc_id < 80]
    assert max(bad) < 0.5 < 1 <= min(good)
    again = mixing.repeat_by_rate(docs, labels, {"clean": 0.95, "toxic": 0.05})
    assert again.schema == docs.schema
    found = [r.doc_id for r in again.collect()]
    assert set(range(80)) <= set(found) and sum(1 for i in found if i and 100 <= i < 120) < 15
    assert mixing.mix(docs.limit(0), labels, {"clean": 0.5, "toxic": 0.5}).count() == 0


def test_targets_out_of_reach_are_told(spark):
    rows = frame(spark, [(10, [0.9, 0.1])] * 50, "n_tokens long, posterior array<double>")
    _, reached, met = mixing.fit_rates(rows, {"a": 0.2, "b": 0.8})
    assert not met and reached[1] < 0.3
    docs = frame(spark, [(i, f"fine words {i}") for i in range(30)])
    labels = frame(spark, [(i, "clean") for i in range(30)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="misses its targets"):
        got = mixing.mix(docs, labels, {"clean": 0.2, "toxic": 0.8}).collect()
    assert len(got) == 30 and not any(r.met for r in got)


def test_posteriors_lie_on_the_grid():
    p = np.random.default_rng(3).dirichlet((0.2, 0.5, 1.0), 500)
    got = mixing.on_grid(p)
    assert np.allclose(got.sum(1), 1) and np.abs(got - p).max() < 1 / mixing.GRID
    assert (got * mixing.GRID == np.round(got * mixing.GRID)).all()


def test_a_labelled_id_with_very_many_rows(spark):
    rows = [(1, f"clean words number {i % 7}") for i in range(400)] + [(2, "vile nasty words")] + [(None, f"clean words number {i}") for i in range(50)]
    docs, labels = frame(spark, rows), frame(spark, [(1, "clean"), (2, "toxic")], "doc_id long, domain string")
    got = mixing.repeat_by_rate(docs, labels, {"clean": 0.99, "toxic": 0.01}).collect()
    assert 300 < len(got) < 700 and {r.doc_id for r in got} >= {1, None}


def test_classifier_equals_a_plain_one(spark):
    rows = [(i, f"clean words {i % 5} of it.") for i in range(20)] + [(50 + i, f"vile, nasty {i % 3} words") for i in range(9)] + [(90, None), (91, "very " * 4000)]
    labels = [(i, "clean") for i in range(20)] + [(50 + i, "toxic") for i in range(9)] + [(90, "clean"), (91, "clean")]
    w, b = mixing.learn_domains(frame(spark, rows), frame(spark, labels, "doc_id long, domain string"), ["clean", "toxic"], parts=1)
    texts, domain = [t or "" for _, t in sorted(rows)], [["clean", "toxic"].index(d) for _, d in sorted(labels)]
    bags = [{zlib.crc32(x.encode()) % mixing.DIMENSIONS for x in "".join(c for c in t.lower() if c not in ".,;:!?\"'()").split()} for t in texts]
    plain, squares = {}, {}
    offset = [float(np.log((domain.count(k) + 0.5) / len(domain))) for k in (0, 1)]
    order = np.random.default_rng(11)
    for _ in range(3):
        for i in order.permutation(len(bags)):
            z = [sum(plain.get((x, k), 0.0) for x in bags[i]) + offset[k] for k in (0, 1)]
            e = np.exp(np.array(z) - max(z))
            for k in (0, 1):
                slope = e[k] / e.sum() - (domain[i] == k)
                for x in bags[i]:
                    squares[x, k] = squares.get((x, k), 1e-2) + slope * slope
                    plain[x, k] = plain.get((x, k), 0.0) - 0.05 * slope / np.sqrt(squares[x, k])
                offset[k] -= 0.01 * slope
    assert np.allclose(b, offset, atol=1e-4)
    assert np.allclose([w[x, k] for x, k in plain], list(plain.values()), atol=1e-4)


def test_distance_equals_a_plain_out_of_place_distance(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(LANGS[lang].split())), lang) for i in range(40) for lang in [list(LANGS)[i % 3]]] + [(70, "der fox el " * 2000, "en"), (71, None, "en"), (72, "?", "en")]
    counts = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and text:
            for key, n in zip(*(x.tolist() for x in language.grams(text)), strict=True):
                counts.setdefault(lang, {})
                counts[lang][key] = counts[lang].get(key, 0) + n
    ranks = {lang: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:300])} for lang, c in counts.items()}
    want = {}
    for i, text, _ in rows:
        own = dict(zip(*(x.tolist() for x in language.grams(text or "")), strict=True))
        mine = sorted(own, key=lambda g: (-own[g], g))[:300]
        far = {lang: sum(abs(r - known[g]) if g in known else 300 for r, g in enumerate(mine)) / (300 * max(1, len(mine))) for lang, known in ranks.items()}
        least = min(far.values())
        share = np.exp([-40 * (d - least) for d in far.values()])
        want[i] = (min(x for x, d in far.items() if d == least), float(share.max() / share.sum())) if mine else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(s == pytest.approx(want[i][1]) for i, (_, s) in got.items())
