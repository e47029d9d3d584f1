"""Facts of video files from their containers: boxes of ISO media (MP4, MOV) and chunks of RIFF (AVI), by byte ranges."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .recording_source import open_file

FACTS = "container string, codec string, width int, height int, fps double, frames long, problem string"
_SCHEMA = pa.schema([("container", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("fps", pa.float64()), ("frames", pa.int64()), ("problem", pa.string())])
#: Bytes from a place on; fewer at the end.
Read = Callable[[int, int], bytes]


class Truncated(ValueError):
    pass


def _exactly(read: Read, at: int, n: int) -> bytes:
    found = read(at, n)
    if len(found) < n:
        raise Truncated
    return found


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes' bodies; only their heads are read."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", _exactly(read, at, 8))
        body = at + 8
        if size == 1:
            (size,), body = struct.unpack(">Q", _exactly(read, body, 8)), at + 16
        size = end - at if size == 0 else size
        if at + size > end or size < body - at:
            raise Truncated
        yield kind, body, at + size
        at += size


def _inside(read: Read, where: tuple[int, int], *path: bytes) -> tuple[int, int]:
    for name in path:
        where = next((a, b) for kind, a, b in _boxes(read, *where) if kind == name)
    return where


def _iso(read: Read, size: int) -> dict:
    movie = next(((a, b) for kind, a, b in _boxes(read, 0, size) if kind == b"moov"), None)
    if movie is None:
        raise Truncated
    for kind, a, b in _boxes(read, *movie):
        if kind != b"trak" or _exactly(read, _inside(read, (a, b), b"mdia", b"hdlr")[0] + 8, 4) != b"vide":
            continue
        head, table = _inside(read, (a, b), b"tkhd"), _inside(read, (a, b), b"mdia", b"minf", b"stbl")
        width, height = (x >> 16 for x in struct.unpack(">2I", _exactly(read, head[1] - 8, 8)))
        clock = _inside(read, (a, b), b"mdia", b"mdhd")[0]
        (rate,) = struct.unpack(">I", _exactly(read, clock + (20 if _exactly(read, clock, 1) == b"\1" else 12), 4))
        times = _inside(read, table, b"stts")[0]
        (runs,) = struct.unpack(">I", _exactly(read, times + 4, 4))
        numbers = struct.unpack(f">{2 * runs}I", _exactly(read, times + 8, 8 * runs))
        frames, ticks = sum(numbers[::2]), sum(n * d for n, d in zip(numbers[::2], numbers[1::2], strict=True))
        codec = _exactly(read, _inside(read, table, b"stsd")[0] + 12, 4)
        return {"container": "iso", "codec": _text(codec), "width": width, "height": height, "fps": frames * rate / ticks if ticks else None, "frames": frames}
    return {"container": "iso", "problem": "no video"}


def _chunks(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks' bodies; a list has its own name and starts after it."""
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", _exactly(read, at, 8))
        if at + 8 + size > end:
            raise Truncated
        yield (_exactly(read, at + 8, 4), at + 12, at + 8 + size) if kind == b"LIST" else (kind, at + 8, at + 8 + size)
        at += 8 + size + size % 2


def _riff(read: Read, size: int) -> dict:
    head = next((a, b) for name, a, b in _chunks(read, 12, size) if name == b"hdrl")
    found: dict = {"container": "riff", "problem": "no video"}
    for name, a, b in _chunks(read, *head):
        if name == b"avih":
            found["width"], found["height"] = struct.unpack("<2I", _exactly(read, a + 32, 8))
        elif name == b"strl" and "codec" not in found:
            stream = next(x for kind, x, _ in _chunks(read, a, b) if kind == b"strh")
            kind, codec = struct.unpack("<4s4s", _exactly(read, stream, 8))
            scale, rate, _, frames = struct.unpack("<4I", _exactly(read, stream + 20, 16))
            if kind == b"vids":
                found |= {"codec": _text(codec), "fps": rate / scale if scale else None, "frames": frames, "problem": None}
    return found


def _text(code: bytes) -> str:
    return code.decode("latin-1").strip("\0 ") or "unknown"


def facts(read: Read, size: int) -> dict:
    """container (iso, riff; null if it is neither), codec, width, height, fps, frames, problem (null, `unknown`,
    `truncated`, `no video`). Only heads and the table of frame times are read, wherever they lie."""
    try:
        start = read(0, 12)
        if start[:4] == b"RIFF" and start[8:] == b"AVI ":
            return _riff(read, size)
        if start[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
            return _iso(read, size)
        return {"problem": "unknown"}
    except (Truncated, StopIteration):
        return {"problem": "truncated"}


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: None for n in _SCHEMA.names} | f for f in found], _SCHEMA)


def _beside(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    rows = _rows(found)
    return pa.RecordBatch.from_arrays([batch.column(0), *rows.columns], names=[batch.schema.names[0], *_SCHEMA.names])


def read_containers(paths: DataFrame) -> DataFrame:
    """path and facts of the files (column path); one that can't be opened has the problem `missing`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(path: str | None) -> dict:
            try:
                file, size = open_file(path or "")
            except (OSError, ValueError, NotImplementedError):
                return {"problem": "missing"}
            with file:
                return facts(lambda at, n: file.read_at(min(n, size - at), at) if at < size else b"", size)

        for batch in batches:
            yield _beside(batch, [one(p) for p in batch.column(0).to_pylist()])

    return paths.select("path").mapInArrow(run, "path string, " + FACTS)


def container_facts(df: DataFrame, key: str, content: str) -> DataFrame:
    """The key column and facts of containers that are in a binary column; null has the problem `missing`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _beside(batch, [{"problem": "missing"} if c is None else facts(lambda at, n, c=c: c[at : at + n], len(c)) for c in batch.column(1).to_pylist()])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {kind}, {FACTS}")
