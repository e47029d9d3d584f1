import random
import re
import time

from pyspark.sql import functions as F

from wavemark.llm import licences


def brute(text, threshold=0.8):
    if text is None:
        return None, None, "", 0
    plain = re.sub("[^a-z0-9\n]+", " ", text.translate(str.maketrans(licences.UPPER, licences.LOWER)))
    lines = [x.split() for x in plain.split("\n") if x.split()]
    most, edges = licences.longest_unit(licences.TEMPLATES, threshold), set(licences.edge_words(licences.TEMPLATES))
    hits, begins = [], set()
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            words = [w for x in lines[i : j + 1] for w in x]
            if len(words) > most:
                break
            if not edges & set(lines[i]) or not edges & set(lines[j]):
                continue
            g = {f"{a} {b}" for a, b in zip(words, words[1:])}
            for name, t in licences.TEMPLATES.items():
                d = set(licences.bigrams_of(t))
                if g and 2 * len(g & d) / (len(g) + len(d)) >= threshold:
                    hits.append((-(2.0 * len(g & d) / (len(g) + len(d))), name))
                    begins.add(i)
    best = min(hits, default=None)
    return best and best[1], best and -best[0], ",".join(sorted({n for _, n in hits})), len(begins)


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def test_same_as_brute_force(spark):
    t = licences.TEMPLATES
    header = t["Apache-2.0-header"].replace(". ", ".\n\n").replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    texts = [None, "", "one", "two words", "\n\n \n", *t.values(), *(f"Some prose.\n{x.upper()}\nMore prose." for x in t.values())]
    texts += [t["MIT-text"].replace(", ", ",\n"), "a\n\n" + t["MIT-text"].replace(". ", ".\n") + "\n\nb", "Released under the  MIT\tLicense", "Released under an MIT License", t["MIT"] + "\n" + t["MIT"] + "\n" + t["CC-BY-NC-4.0"], "x " * 200_000 + "\n" + t["MIT"]]
    texts += ["One paragraph of other words.\n\n" + header + "\n\nAnother paragraph with licensed things.", "# " + wrapped(header, 9).replace("\n", "\n# ") + "\nimport os\ncode = permission(1)", "word " * 300 + "\n" + wrapped(t["BSD-3-Clause-text"], 7) + "\n" + "license " * 400]
    texts += ["Published under CC BY-NC 4.0", "license\n" * 350, "\n".join(["the license of software"] * 30), "Licence: CC by-NC 4.0, see\u212aNC."]
    docs = spark.createDataFrame([(k, x, "c", 0) for k, x in enumerate(texts)], "doc_id long, text string, license string, plain int")
    got = {r.doc_id: (r.license, r.dice, r.licenses, r.n_matches) for r in licences.scan(docs).collect()}
    for k, x in enumerate(texts):
        assert got[k] == brute(x), x
    assert got[texts.index("One paragraph of other words.\n\n" + header + "\n\nAnother paragraph with licensed things.")][0] == "Apache-2.0-header"
    assert licences.scan(docs.limit(0)).count() == 0
    again = docs.where("doc_id = 4 or doc_id = 7")
    assert licences.scan(again.unionByName(again)).count() == 4
    nobody = licences.scan(again.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [r.doc_id for r in nobody] == [None, None] and sum(r.license is not None for r in nobody) == 1


def test_many_short_lines(spark):
    """Word lists of licence words, a line each, cost no more than other texts; with a licence among them it is found."""
    r = random.Random(5)
    edges = licences.edge_words(licences.TEMPLATES)
    lists = ["\n".join(r.choice(edges) for _ in range(n)) for n in (100, 325, 2000)]
    among = ["\n".join([*(r.choice(edges) for _ in range(40)), *licences.words_of(licences.TEMPLATES[name]), *(r.choice(edges) for _ in range(40))]) for name in ("MIT", "CC-BY-4.0", "ISC")]
    texts = lists + among
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(1)
    licences.scan(docs.limit(1)).collect()
    begun = time.time()
    licences.scan(docs.where("doc_id < 3")).collect()
    assert time.time() - begun < 10  # 41 s for one list of 325 lines, were all their runs built
    got = {r.doc_id: (r.license, r.dice, r.licenses, r.n_matches) for r in licences.scan(docs.where("doc_id in (0, 3, 4, 5)")).collect()}
    assert got == {k: brute(texts[k]) for k in (0, 3, 4, 5)} and got[3][0] == "MIT"


def test_every_match_has_a_needed_word():
    """Templates that lack as many of their bigrams as a match may, chosen against the needed words, still hold one."""
    needed = licences.needed_words(licences.TEMPLATES, 0.8)
    for text in licences.TEMPLATES.values():
        pairs = licences.bigrams_of(text)
        without = [p for p in pairs if not any(w in p.split(" ") or len(w) >= licences.EDGE_LETTERS and w in p for w in needed)]
        assert 2 * len(without) / (len(without) + len(pairs)) < 0.8


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
