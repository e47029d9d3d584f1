"""A session that is much longer than a block: pairing, warnings and moves equal a plain walk through its rows."""

import random

import pytest

from wavemark.operators import markers as M

SCHEMA = "user_id long, seq long, marker_id string, kind string, domain string, time_sec double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for k in range(600):
        kind = r.choice(["action_start", "action_start", "action_end", "action_end", "led_on", "led_off", "ttl"])
        out.append((1 if k % 5 else k % 3 + 2, k * 7, f"m{k}", kind, "record" if kind == "ttl" else "video", k * 0.5 + r.choice([0, 0, -3.0])))
    return out


def paired(rows, session):
    open_, out = None, []
    for _, _, name, kind, _, t in (x for x in rows if x[0] == session):
        if kind == "action_start":
            open_ = (name, t)
        elif kind == "action_end" and open_ and t > open_[1]:
            out.append((session, open_[0], name, open_[1], t))
            open_ = None
    return out


@pytest.mark.parametrize("block", [40, 100_000])
def test_pairs(spark, rows, block):
    got = M.pair_intervals(spark.createDataFrame(rows, SCHEMA), "action_start", "action_end", block=block).collect()
    assert sorted(map(tuple, got)) == sorted(x for s in (1, 2, 3, 4) for x in paired(rows, s))


@pytest.mark.parametrize("block", [40, 100_000])
def test_first_warning(spark, rows, block):
    kept = [x for x in rows if not (x[0] == 1 and x[3].endswith(("end", "off")) and x[1] < 2000)]  # the first problem comes late
    want = {}
    for s in (1, 2, 3, 4):
        number, last = 0, {}
        for _, _, _, kind, domain, t in (x for x in kept if x[0] == s):
            if domain != "video":
                continue
            number += 1
            pair, is_end = kind[:3], kind in ("action_end", "led_off")
            before = last.get(pair)
            if is_end and (before is None or before[0] in ("action_end", "led_off")):
                want.setdefault(s, (number, f"{kind} has no start"))
            elif is_end and t <= before[1]:
                want.setdefault(s, (number, f"{kind} isn't after #{before[2]}"))
            last[pair] = (kind, t, number)
    got = M.interval_warning(spark.createDataFrame(kept, SCHEMA), block=block).collect()
    assert {r.user_id: (r.number, r.problem) for r in got} == want and want[1][0] > 50


@pytest.mark.parametrize(("name", "to"), [("m1", 300), ("m401", 3), ("m401", 10_000), ("gone", 5)])
def test_move(spark, rows, name, to):
    got = {r.marker_id: r.seq for r in M.reorder(spark.createDataFrame(rows, SCHEMA), name, to, "user_id", block=40).collect()}
    want = {x[2]: x[1] for x in rows}
    for s in (1, 2, 3, 4):
        video = [x for x in rows if x[0] == s and x[4] == "video"]
        slots, order = [x[1] for x in video], [x[2] for x in video]
        if name in order:
            order.remove(name)
            order.insert(to - 1, name)
        want |= dict(zip(order, slots, strict=True))
    assert got == want
