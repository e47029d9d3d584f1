import itertools
from collections import Counter
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from hypothesis import given, strategies as st  # noqa: E402

from wavemark.llm import packing, token_output  # noqa: E402
from wavemark.llm.queries import vocabulary_file  # noqa: E402
from wavemark.llm.tokens import Encoder, pack_bits, unpack_bits, width_of  # noqa: E402

ROWS = [
    (5, "Hello, world's BEST text!\n\nline\ttwo  x", "a"),
    (3, None, "b"),
    (9, "", "c"),
    (3, "repeated id", "d"),
    (None, "null id é́ ΣΑΣ <|endoftext|> a<|startoftext|>b", "e"),
    (7, "the quick brown fox " * 3000, "f"),
    (8, "a b c\x1cd" + "z" * 3000, "g"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def direct(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file()).encode(text or "", add_special_tokens=False).ids + [end]


@given(st.text(max_size=200))
def test_words_give_the_ids_of_the_whole_text(text):
    assert test_words_give_the_ids_of_the_whole_text.encoder.ids(text).tolist() == direct_ids(text)


@given(st.text("aZé É!.'%|<>09sßÿİΣKÅ\u0301\xad\x85\n", max_size=60))
def test_words_near_the_short_way(text):
    assert test_words_give_the_ids_of_the_whole_text.encoder.ids(text).tolist() == direct_ids(text)


def direct_ids(text):
    return test_words_give_the_ids_of_the_whole_text.encoder.tokenizer.encode(text, add_special_tokens=False).ids


test_words_give_the_ids_of_the_whole_text.encoder = Encoder(vocabulary_file())


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=200), st.data())
def test_bits_round_trip(width, ids, data):
    ids = np.array([x & ((1 << width) - 1) for x in ids], np.uint32)
    payload = pack_bits(ids, width)
    assert len(payload) == (len(ids) * width + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    assert unpack_bits(payload, width, a, len(ids) - a).tolist() == ids[a:].tolist()


def test_width():
    assert [width_of(x) for x in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_files_hold_every_document_in_order(spark):
    files = token_output.write_tokens(frame(spark), vocabulary_file(), end_id=1)
    got = token_output.read_tokens(files).collect()
    want = [(d, direct(t, 1)) for d, t, _ in ROWS]
    crcs = sorted((d or -1, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for d, x in want)
    assert sorted((r.doc_id or -1, r.ids_crc32, r.n_tokens) for r in got) == crcs
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [None, 3, 3, 5, 7, 8, 9]
    assert token_output.lookup(files, 7)[0].tolist() == direct(ROWS[5][1], 1)


def test_empty_table(spark):
    files = token_output.write_tokens(frame(spark, []), vocabulary_file())
    assert token_output.read_tokens(files).count() == 0
    assert packing.pack_documents(frame(spark, []), vocabulary_file()).count() == 0


def check_plan(counts, capacity):
    made, total = packing.plan(counts, capacity), {}
    for n, content in made:
        assert n > 0 and sum(a * b for a, b in content) <= capacity
        for a, b in content:
            total[a] = total.get(a, 0) + n * b
    assert total == {k: v for k, v in counts.items() if v}
    return sum(n for n, _ in made)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_uses_every_piece_once(counts):
    used = check_plan(counts, 40)
    least = -(-sum(a * b for a, b in counts.items()) // 40)
    assert least <= used <= max(1, 2 * least)


def test_plan_fills_exactly():
    assert check_plan({7: 4, 3: 4}, 10) == 4
    assert check_plan({6: 2, 2: 4}, 10) == 2
    assert check_plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == 1
    assert check_plan({5: 6}, 10) == 3
    assert packing.plan({}, 10) == []


def test_packing_places_every_piece(spark):
    got = packing.pack_documents(frame(spark), vocabulary_file(), capacity=64, end_id=0).collect()
    want = sorted((d or -1, k, at, x[at : at + 64]) for d, t, _ in ROWS for x in [direct(t, 0)] for k, at in enumerate(range(0, len(x), 64)))
    have = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert have == sorted((d, k, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, k, at, x in want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 1


def test_sum_index_follows_what_is_taken():
    """After any takings the index equals one built anew, and every combination it gives is there and fills its gap."""
    r = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(r.choice([5, 17, 64]))
        counts = {int(x): int(n) for x, n in zip(r.integers(1, capacity + 1, 30), r.choice([1, 1, 2, 5], 30), strict=True)}
        sums = packing.Sums(counts, capacity)
        while (some := np.flatnonzero(sums.free)).size:
            sums.take(length := int(r.choice(some)), int(r.integers(1, sums.free[length] + 1)))
            anew = packing.Sums({int(x): int(sums.free[x]) for x in np.flatnonzero(sums.free)}, capacity)
            assert all(np.array_equal(getattr(anew, x), getattr(sums, x)) for x in ("has", "pairs", "triples"))
            for beside in np.flatnonzero(sums.free).tolist():
                found, gap = sums.filling(capacity - beside, beside), capacity - beside
                left = [x for x in np.flatnonzero(sums.free).tolist() for _ in range(min(3, int(sums.free[x]) - (x == beside)))]
                there = gap > 0 and any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(left, k)) if len(left) < 18 else None
                assert there is None or (found is not None) == there
                if found:
                    assert sum(found) == gap and all(sums.free[x] >= n for x, n in Counter((beside, *found)).items())
