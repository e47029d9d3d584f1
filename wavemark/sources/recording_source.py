"""A Spark data source for recordings: CSV with rows of metadata before the data, read in windows of bytes.

    spark.dataSource.register(Recordings)
    spark.read.format("recording").option("channels", "2,260").load("/data/one.csv")

gives window, line, time_us and channel_<id>. The path is a file or a folder of parts (see `Parts`). A window has the lines that begin in its bytes; `line` counts them from 0, so
that a line's row is its window's first row plus that. With the option `what` = `windows` there is a row a window instead
(window, lines), for which nothing is parsed. The header may be any number of rows down. Comparisons of time_us with
numbers leave out rows while a window is read, where the session allows it (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv as pa_csv, fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

#: Names of the metadata rows.
CHANNELS, RATE, TIME, UNITS = "Channels", "Sample Rate", "Time[us]", ("unit", "units")
#: Rows after the header in which a unit may still come.
AFTER_HEADER = 8
#: Bytes of a window.
WINDOW = 32 << 20
_READ = 1 << 16


def _system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and the path in it. Paths are URIs or local ones."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path)


def open_file(path: str) -> tuple[pa.NativeFile, int]:
    """The file and its size."""
    system, inner = _system(path)
    return system.open_input_file(inner), system.get_file_info(inner).size


class Parts:
    """A recording's bytes: one file, or the files of a folder one after another in the order of their numbers.

    Each of a folder's files ends with a whole line, as Spark writes them; files with names of `_` or `.` don't count.
    """

    def __init__(self, path: str):
        self._fs, inner = _system(path)
        info = self._fs.get_file_info(inner)
        if info.type == pa_fs.FileType.Directory:
            found = [f for f in self._fs.get_file_info(pa_fs.FileSelector(inner)) if f.is_file and f.base_name[0] not in "_."]
            self._files = sorted(found, key=lambda f: (len(f.base_name), f.base_name))
        else:
            self._files = [info] if info.is_file else []
        if not self._files:
            raise FileNotFoundError(path)
        self._starts = np.concatenate(([0], np.cumsum([f.size for f in self._files]))).tolist()
        self.size = self._starts[-1]

    def read_at(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on, over files' ends."""
        parts, end = [], min(at + n, self.size)
        for info, start in zip(self._files, self._starts, strict=False):
            a, b = max(at, start), min(end, start + info.size)
            if a < b:
                with self._fs.open_input_file(info.path) as file:
                    parts.append(file.read_at(b - a, a - start))
        return b"".join(parts)


def can_open(path: str) -> bool:
    try:
        Parts(path)
    except (OSError, ValueError, NotImplementedError):  # a file system that only Spark knows, or nothing there
        return False
    return True


def describe(rows: list[list[str]]) -> dict:
    """What the first rows say: channels, sample_rates, header_row (from 0; None without a header), data_column_count,
    time_unit and value_unit (as it is written).

    A row is its first cell, the name, and values. The header is the first row named for the time. Channels and rates are
    those of the last row of that name; of the units before the header the last counts, else the first of the few rows
    after it.
    """
    table = [(k, cells[0], [c for c in cells[1:] if c]) for k, cells in enumerate([c.strip() for c in row] for row in rows) if cells]
    header = next((k for k, name, _ in table if name == TIME), None)
    end = len(rows) if header is None else [k for k, _, _ in table if k > header][:AFTER_HEADER][-1:]
    last = end if isinstance(end, int) else end[0] if end else header
    near = [x for x in table if x[0] <= last]
    units = [(k, values[0]) for k, name, values in near if name.lower() in UNITS and values]
    early = [unit for k, unit in units if header is None or k < header]
    named = {"channels": [v for _, name, v in near if name == CHANNELS], "rates": [v for _, name, v in near if name.startswith(RATE)]}
    return {
        "channels": [int(v) for v in (named["channels"] or [[]])[-1]],
        "sample_rates": [float(v) for v in (named["rates"] or [[]])[-1]],
        "header_row": header,
        "data_column_count": None if header is None else 1 + sum(len(v) for k, _, v in table if k == header),
        "time_unit": "s",
        "value_unit": (early[-1:] or [unit for _, unit in units] or [""])[0],
    }


def cells_of(line: bytes | str) -> list[str]:
    text = line.decode("utf-8", "replace") if isinstance(line, bytes) else line
    return next(csv.reader([text.rstrip("\r\n").removeprefix("﻿")]), [])


def top_rows(file: Parts, most: int | None = None) -> tuple[list[list[str]], int | None]:
    """The rows up to the header and the few after it, and the byte after the header; all rows and None without one.
    With `most`, so many rows whatever they are."""
    rows, at, read, rest, data_at, after = [], 0, 0, b"", None, 0
    while True:
        chunk = file.read_at(read, _READ)
        read += len(chunk)
        *lines, rest = (rest + chunk).split(b"\n")
        if not chunk and rest:
            lines, rest = [*lines, rest], b""
        for line in lines:
            at += len(line) + 1
            rows.append(cells_of(line))
            if most is not None:
                if len(rows) == most:
                    return rows, None
            elif data_at is None and rows[-1] and rows[-1][0].strip() == TIME:
                data_at = at
            elif data_at is not None and (after := after + bool(rows[-1])) >= AFTER_HEADER:
                return rows, data_at
        if not chunk:
            return rows, data_at


def top_of(path: str) -> tuple[dict, int | None]:
    rows, data_at = top_rows(Parts(path))
    return describe(rows), data_at


def known_channels(found: dict) -> list[int]:
    return found["channels"] or list(range(1, found["data_column_count"]))


def _number(text: str) -> float | None:
    try:
        return None if "_" in text else float(text)
    except ValueError:
        return None


def parse(body: bytes, columns: list[int]) -> list[pa.Array]:
    """The columns' numbers, the first in double and the others in single precision, of the lines that aren't blank.

    Cells that aren't decimal numbers, and such that a short line lacks, are null. Arrow's reader takes whole windows; one
    with a line that it refuses is read cell by cell.
    """
    kinds = [pa.float64()] + [pa.float32()] * (len(columns) - 1)
    names = [f"f{k}" for k in columns]
    try:
        found = pa_csv.read_csv(
            pa.BufferReader(body),
            pa_csv.ReadOptions(autogenerate_column_names=True, use_threads=False),
            convert_options=pa_csv.ConvertOptions(include_columns=names, column_types=dict(zip(names, kinds, strict=True)), null_values=[""]),
        ).combine_chunks()
        return [c.chunk(0) if c.num_chunks else pa.array([], k) for c, k in zip(found.columns, kinds, strict=True)]
    except (pa.ArrowInvalid, pa.ArrowKeyError):
        rows = [cells_of(line) for line in body.split(b"\n") if line.strip()]
        return [pa.array([_number(r[k]) if k < len(r) else None for r in rows], kind) for k, kind in zip(columns, kinds, strict=True)]


@dataclass
class Window(InputPartition):
    number: int
    start: int
    end: int


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, columns: list[int], schema: StructType, window_bytes: int, count_only: bool):
        self.path, self.columns, self.schema, self.window_bytes, self.count_only = path, columns, schema, window_bytes, count_only
        self.filters: list[Filter] = []

    def partitions(self) -> list[Window]:
        file = Parts(self.path)
        _, data_at = top_rows(file)
        starts = range(data_at, max(file.size, data_at + 1), self.window_bytes)
        return [Window(k, a, min(a + self.window_bytes, file.size)) for k, a in enumerate(starts)]

    def _lines(self, window: Window) -> bytes:
        """The whole lines that begin in the window."""
        file = Parts(self.path)
        before = int(window.number > 0)  # a window that follows a line's end has that line's successor
        body = file.read_at(window.start - before, window.end - window.start + before)
        if before:
            cut = body.find(b"\n")
            if cut < 0 or cut + 1 == len(body):
                return b""  # within one line, or before one that begins in the next window
            body = body[cut + 1 :]
        parts, at = [body], window.end
        while at < file.size and not parts[-1].endswith(b"\n"):
            more = file.read_at(at, _READ)
            at += len(more)
            cut = more.find(b"\n")
            parts.append(more if cut < 0 else more[: cut + 1])
        return b"".join(parts)

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        body = self._lines(partition)
        if self.count_only:
            n = sum(1 for line in io.BytesIO(body) if line.strip())
            yield pa.RecordBatch.from_arrays([pa.array([partition.number], pa.int32()), pa.array([n], pa.int64())], names=["window", "lines"])
        elif body.strip():
            values = parse(body, self.columns)
            n = len(values[0])
            batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.number, np.int32)), pa.array(np.arange(n)), *values], names=self.schema.names)
            yield batch if (keep := self._wanted(values[0])) is None else batch.filter(pa.array(keep))

    def _wanted(self, times: pa.Array) -> np.ndarray | None:
        """Rows that may pass the filters; those without a time stay for Spark, which decides again."""
        if not self.filters:
            return None
        t, keep = times.to_numpy(zero_copy_only=False), np.ones(len(times), bool)
        for f in self.filters:
            match f:
                case GreaterThan():
                    keep &= ~(t <= f.value)
                case GreaterThanOrEqual():
                    keep &= ~(t < f.value)
                case LessThan():
                    keep &= ~(t >= f.value)
                case LessThanOrEqual():
                    keep &= ~(t > f.value)
                case EqualTo():
                    keep &= ~((t < f.value) | (t > f.value))
        return keep


class FilteringReader(RecordingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        taken = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)
        self.filters = [f for f in filters if isinstance(f, taken) and f.attribute == ("time_us",) and isinstance(f.value, (int, float))]
        return filters


class Recordings(DataSource):
    """Options: path; channels (ids, comma between; all without it); windowBytes; what (samples or windows); pushdown."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def _top(self) -> tuple[list[int], list[int]]:
        """The asked channels and all that there are."""
        found, data_at = top_of(self.options["path"])
        if data_at is None:
            raise ValueError(f"no {TIME} row in {self.options['path']}")
        known = known_channels(found)
        asked = self.options.get("channels")
        wanted = known if asked is None else [int(c) for c in asked.split(",") if c.strip()]
        if missing := set(wanted) - set(known):
            raise ValueError(f"unknown channels {sorted(missing)}")
        return wanted, known

    def schema(self) -> StructType:
        if self.options.get("what") == "windows":
            return StructType([StructField("window", IntegerType()), StructField("lines", LongType())])
        wanted, _ = self._top()
        return StructType([StructField("window", IntegerType()), StructField("line", LongType()), StructField("time_us", DoubleType()), *(StructField(f"channel_{c}", FloatType()) for c in wanted)])

    def reader(self, schema: StructType) -> DataSourceReader:
        wanted, known = self._top()
        kind = FilteringReader if self.options.get("pushdown") == "true" else RecordingReader
        return kind(self.options["path"], [0, *(1 + known.index(c) for c in wanted)], schema, int(self.options.get("windowBytes", WINDOW)), self.options.get("what") == "windows")
