"""Video files written by hand: their facts, wherever the head lies and however it is broken."""

import struct

import pytest

from wavemark.sources import containers as V


def box(name, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, name, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), name) + body


def mp4(runs, rate=90_000, size=(640, 480), codec=b"avc1", sound=True, wide=False, first=False, version=0):
    clock = struct.pack(">IQQIQI", 1 << 24, 0, 0, rate, 1, 0) if version else struct.pack(">IIIIII", 0, 0, 0, rate, 1, 0)
    stts = box(b"stts", bytes(4), struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs))
    stsd = box(b"stsd", bytes(4), struct.pack(">I", 1), struct.pack(">I4s", 16, codec), bytes(8))
    video = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", size[0] << 16, size[1] << 16)), box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", box(b"vmhd", bytes(12)), box(b"stbl", stsd, stts))))
    audio = box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", bytes(24)), box(b"hdlr", bytes(8), b"soun", bytes(13)), box(b"minf")))
    movie = box(b"moov", box(b"mvhd", bytes(100)), *([audio] if sound else []), video)
    data = box(b"mdat", bytes(1000), wide=wide)
    return box(b"ftyp", b"isom", bytes(4)) + (movie + data if first else data + movie)


def avi(frames=300, scale=1001, rate=30_000, size=(320, 240), codec=b"MJPG", kind=b"vids", sound=False):
    def chunk(name, body):
        return struct.pack("<4sI", name, len(body)) + body + bytes(len(body) % 2)

    def stream(kind, codec):
        return chunk(b"LIST", b"strl" + chunk(b"strh", kind + codec + bytes(12) + struct.pack("<4I", scale, rate, 0, frames) + bytes(20)) + chunk(b"strf", bytes(41)))

    head = chunk(b"avih", bytes(32) + struct.pack("<2I", *size) + bytes(16))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + head + (stream(b"auds", bytes(4)) if sound else b"") + stream(kind, codec)) + chunk(b"LIST", b"movi" + bytes(501))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def found(content):
    f = V.facts(lambda at, n: content[at : at + n], len(content))
    return tuple(f.get(k) for k in ("container", "codec", "width", "height", "frames", "problem")), f.get("fps")


@pytest.mark.parametrize("more", [{}, {"wide": True}, {"first": True}, {"sound": False}, {"version": 1}])
def test_boxes(more):
    facts, fps = found(mp4([(100, 3000), (50, 6000)], **more))
    assert facts == ("iso", "avc1", 640, 480, 150, None) and fps == pytest.approx(150 / (100 / 30 + 50 / 15))


def test_chunks():
    assert found(avi()) == (("riff", "MJPG", 320, 240, 300, None), pytest.approx(29.97, abs=1e-3))
    assert found(avi(sound=True))[0] == ("riff", "MJPG", 320, 240, 300, None) and found(avi(kind=b"auds"))[0][-1] == "no video"
    assert found(avi(codec=bytes(4)))[0][1] == "unknown" and found(avi(scale=0))[1] is None


def test_what_is_broken():
    whole = mp4([(10, 100)])
    assert {found(whole[:n])[0][-1] for n in (40, 500, len(whole) - 1)} == {"truncated"} and found(avi()[:90])[0][-1] == "truncated"
    for odd in (b"", b"abc", b"<html>" * 9, bytes(50), b"RIFF\0\0\0\0WAVE" + bytes(50)):
        assert found(odd) == ((None,) * 5 + ("unknown",), None)
    for n in range(0, len(whole), 7):  # a wrong byte anywhere never stops the reader
        found(whole[:n] + b"\xff" + whole[n + 1 :])
        found(avi()[:n] + b"\xff" + avi()[n + 1 :])
    assert found(mp4([]))[0][4] == 0 and found(mp4([]))[1] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(mp4([(30, 3000)]))
    (tmp_path / "b.avi").write_bytes(avi())
    (tmp_path / "c.txt").write_text("no video at all")
    paths = [f"{tmp_path}/a.mp4", f"file://{tmp_path}/b.avi", f"{tmp_path}/c.txt", f"{tmp_path}/none.mp4", None]
    got = {r.path: (r.container, r.frames, r.fps and round(r.fps, 2), r.problem) for r in V.read_containers(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: ("iso", 30, 30.0, None), paths[1]: ("riff", 300, 29.97, None), paths[2]: (None, None, None, "unknown"), paths[3]: (None, None, None, "missing"), None: (None, None, None, "missing")}
    inside = spark.createDataFrame([(1, avi()), (2, None)], "id long, content binary")
    assert {r.id: (r.codec, r.problem) for r in V.container_facts(inside, "id", "content").collect()} == {1: ("MJPG", None), 2: (None, "missing")}
