import random

import pytest

pytest.importorskip("tokenizers")

from wavemark.llm import latin_units, token_output, tokens  # noqa: E402
from wavemark.llm.queries import vocabulary_file  # noqa: E402


def texts(n, seed):
    r = random.Random(seed)
    signs = [chr(c) for c in range(256)] + ["'"] * 20 + list("stmdrvel 09") * 4
    return ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(n)]


def test_every_latin_character_as_the_tokenizer_has_it(monkeypatch):
    monkeypatch.setattr(latin_units, "CACHED_UNITS", 500)  # rows are forgotten on the way
    worker, some = tokens.Encoder(vocabulary_file()), texts(4000, 1)
    got = [x.tolist() for a in range(0, len(some), 50) for x in worker.many(some[a : a + 50])]
    assert got == [worker.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert len(worker.latin.keys) < 3000


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 64)
    worker = tokens.Encoder(vocabulary_file())
    some = ["it's a long text, " * 40, "漢字 and so on " * 30, None, "x" * 500, ""]
    assert [x.tolist() for x in worker.many(some)] == [worker.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_rows_of_one_id_have_places_that_stay(spark):
    rows = [(1, f"text number {k}") for k in range(40)] + [(1, "again")] * 20 + [(None, None)] * 30
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        read = token_output.read_tokens(token_output.write_tokens(docs, vocabulary_file()))
        found.append(sorted((r.start, r.n_tokens, r.ids_crc32) for r in read.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
