"""The jobs on growing copies: two runs give what one run over all gives, a run without news changes nothing."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, recording_intake as intake, session_protocols as protocols
from jobs.command import default_config

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
TURNS = "conv_id long, turn long, role string, text string"


def files(folder):
    """Every data file with its time of change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert len(found) > 50 and sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found, key=repr)


def intake_tables(spark, tmp_path, name="a"):
    folder = f"{tmp_path}/{name}"
    return dict(events=f"{folder}/in", output=f"{folder}/out", checkpoint=f"{folder}/mark")


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_intake_of_growing_input(spark, tmp_path):
    config = default_config(intake.__file__) | {"files_a_batch": 1}
    events = spark.read.parquet(f"{SF}/events.parquet")
    where = intake_tables(spark, tmp_path)
    os.makedirs(where["events"])
    intake.run(spark, **where, config=config)  # no files yet
    assert not os.path.exists(where["output"])
    late = F.col("event_id") % 9 == 0  # spread over all days
    add(events.where(~late).where("event_id < 400"), where["events"])
    add(events.where(~late).where("event_id >= 400 and event_id < 700"), where["events"])
    paths = intake.run(spark, **where, config=config)
    before = files(where["output"])
    assert intake.run(spark, **where, config=config) == paths and files(where["output"]) == before
    add(events.where("event_id between 300 and 500 and event_id % 9 <> 0"), where["events"])  # delivered twice
    add(events.where(~late).where("event_id >= 700").unionByName(events.where(late)), where["events"])
    intake.run(spark, **where, config=config)
    once = intake_tables(spark, tmp_path, "b")
    add(events, once["events"])
    want = intake.run(spark, **once, config=config)
    for got, all_ in zip(intake.read(spark, paths), intake.read(spark, want), strict=True):
        assert rows(got.withColumn("mean", F.round("mean", 9)) if "mean" in got.columns else got) == rows(all_.withColumn("mean", F.round("mean", 9)) if "mean" in all_.columns else all_)
    assert spark.read.parquet(paths["arrived"]).where("state = 'taken'").count() > intake.read(spark, paths)[0].count() == events.count()


def test_a_batch_that_runs_again(spark, tmp_path):
    """A run that stops before its batch is committed leaves a batch that the next run does over."""
    config = default_config(intake.__file__)
    where = intake_tables(spark, tmp_path)
    add(spark.read.parquet(f"{SF}/events.parquet"), where["events"])
    paths = intake.run(spark, **where, config=config)
    want = [rows(x) for x in intake.read(spark, paths)]
    shutil.rmtree(f"{where['checkpoint']}/commits")
    intake.run(spark, **where, config=config)
    assert [rows(x) for x in intake.read(spark, paths)] == want
    # a run that stopped after the stream, while days were put together: the next one does them
    for half_done in ("mark", "report"):
        shutil.rmtree(paths[half_done])
    intake.run(spark, **where, config=config)
    assert [rows(x) for x in intake.read(spark, paths)] == want and os.path.exists(paths["mark"])


def test_intake_writes_only_days_that_are_touched(spark, tmp_path):
    config, where = default_config(intake.__file__), intake_tables(spark, tmp_path)
    day = "timestamp_ntz'2024-03-0{} 10:00:00'"
    one = lambda k, d, s, v="1.0", kind="'view'": f"SELECT {k} AS event_id, {day.format(d)} + INTERVAL {s} SECOND AS ts, 1L AS user_id, {kind} AS event_type, {v} AS value"
    make = lambda *parts: spark.sql(" UNION ALL ".join(parts)).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", ")))
    add(make(one(1, 1, 0), one(2, 1, 10, "NULL"), one(3, 2, 0), one(4, 2, 0, "double('NaN')"), one("NULL", 1, 5), one(5, 1, 5, kind="'other'"), one(6, 1, 5, kind="NULL")), where["events"])
    paths = intake.run(spark, **where, config=config)
    report = {(str(r.day), r.channel): r for r in intake.read(spark, paths)[1].collect()}
    assert {k: (r.n, r.missing, r.repeated_times, r.long_gaps) for k, r in report.items()} == {("2024-03-01", 5): (2, 1, 0, 0), ("2024-03-02", 5): (2, 1, 1, 0)}
    assert report["2024-03-01", 5].low == report["2024-03-01", 5].mean == 1.0
    assert spark.read.parquet(paths["arrived"]).where("state = 'rejected'").count() == 3
    first = {f: t for f, t in files(paths["samples"]).items() if "day=2024-03-01" in f}
    add(make(one(9, 2, 5000), one(3, 2, 1, "7.0")), where["events"])  # 3 comes again with another time: the first one stays
    intake.run(spark, **where, config=config)
    samples, report = intake.read(spark, paths)
    assert {f: t for f, t in files(paths["samples"]).items() if "day=2024-03-01" in f} == first
    assert [(r.event_id, r.step_us, r.kind) for r in samples.where("day = '2024-03-02'").orderBy("time_us", "event_id").collect()] == [(3, None, "first"), (4, 0, "repeated"), (9, 5_000_000_000, "gap")]
    assert report.where("day = '2024-03-02'").first().longest_gap_us == 5_000_000_000


def test_protocols_of_growing_input(spark, tmp_path):
    config = default_config(protocols.__file__) | {"sessions_a_part": 10}
    all_ = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    cut = "conv_id < 35 and not (conv_id = 12 and turn > 1)"
    add(all_.where(cut), source)
    paths = protocols.run(spark, conversations=source, output=out, config=config)
    before = files(paths["protocol"])
    protocols.run(spark, conversations=source, output=out, config=config)
    assert files(paths["protocol"]) == before
    add(all_.where(f"not ({cut})"), source)
    protocols.run(spark, conversations=source, output=out, config=config)
    same = {f for f in before if any(f"part={k}/" in f for k in (0, 2))}
    assert len(same) >= 2 and all(files(paths["protocol"])[f] == before[f] for f in same)
    assert not any(f in files(paths["protocol"]) for f in before if "part=1/" in f or "part=3/" in f)
    want = protocols.protocol(protocols.turns(all_, 10), config["kinds"], config["chars_per_sec"])
    assert rows(protocols.read(spark, paths)) == rows(want)
    # other settings make every part new; a run that broke off before its marks were written does its parts over
    shutil.rmtree(paths["marks"])
    protocols.run(spark, conversations=source, output=out, config=config)
    assert rows(protocols.read(spark, paths)) == rows(want)
    protocols.run(spark, conversations=source, output=out, config=config | {"chars_per_sec": 7.0})
    assert rows(protocols.read(spark, paths)) == rows(protocols.protocol(protocols.turns(all_, 10), config["kinds"], 7.0))


def test_protocol_of_a_session_longer_than_a_block(spark):
    turns = [(7, k, ("user", "assistant", "user", "assistant", "assistant", "system", "robot")[k % 7], f" a\t{'x' * (k % 11)} \n") for k in range(300)]
    turns += [(8, 0, "assistant", None), (8, 1, "user", ""), (8, 2, "assistant", "x"), (8, 2, "assistant", "w"), (None, 1, "user", "x"), (8, None, "user", "x")]
    df = spark.createDataFrame(turns, TURNS)
    config = default_config(protocols.__file__)
    short, whole = (protocols.protocol(protocols.turns(df, 1000), config["kinds"], 15.0, block) for block in (16, 100_000))
    assert rows(short) == rows(whole)
    got = {r.marker_id: r for r in short.collect()}
    assert len(got) == 303 and got["n7.6"].broken == "kind" and got["n7.0"].partner_id == "n7.1" and got["n7.1"].partner_id == "n7.0"
    assert got["n7.1"].note == "a x" and got["n7.1"].time_sec == 1 / 15 and got["n8.0"].problem == "action_end has no start"
    assert got["n8.2"].note == "w" and got["n8.1"].partner_id is None  # no later than its start


@pytest.mark.parametrize(("job", "paths", "said", "found"), [
    (protocols, {"conversations": f"{SF}/conversations.parquet", "output": "out"}, "parts are new or changed", "protocol/part=0"),
    (intake, {"events": f"{SF}/events.parquet", "output": "out", "checkpoint": "mark"}, "read 1000 rows, rejected 0", "samples/day=2024-01-01/channel=1"),
])
def test_command_lines(tmp_path, job, paths, said, found):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(default_config(job.__file__)))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = [x for name, path in paths.items() for x in (f"--{name}", path if path.startswith("/") else f"{tmp_path}/{path}")]
    done = subprocess.run([sys.executable, "-m", job.__name__, *given, "--config", str(config)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert said in done.stderr and any(f"out/{found}" in f for f in files(f"{tmp_path}/out"))
