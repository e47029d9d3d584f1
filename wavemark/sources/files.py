"""Single files that other programs read: CSV with a byte order mark, and XLSX. Written beside the target and renamed."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

#: What spreadsheets take for UTF-8, and the rows that a sheet holds.
MARK, MOST_ROWS = b"\xef\xbb\xbf", 1_048_576


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as Spark's JVM has them."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark understands it."""
    found, fs = file_system(spark, path)
    return fs.makeQualified(found).toString()


@contextmanager
def replacing(spark: SparkSession, path: str):
    """A stream to `<path>.part`, which takes the target's place when all is written; after an error it is gone."""
    target, fs = file_system(spark, path)
    part, _ = file_system(spark, path + ".part")
    stream = fs.create(part, True)
    try:
        yield stream
        stream.close()
    except BaseException:
        stream.close()
        fs.delete(part, False)
        raise
    fs.delete(target, False)
    fs.rename(part, target)


def cell(x: Column) -> Column:
    """A CSV cell: quoted where it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_lines(lines: DataFrame, path: str, head: bytes, line_end: str = "\n") -> None:
    """One file: `head`, then the lines (column value) in the order of the DataFrame's partitions.

    Many tasks write parts; the driver copies them one after another as streams and deletes them.
    """
    spark = lines.sparkSession
    parts, fs = file_system(spark, path + ".parts")
    fs.delete(parts, True)
    lines.write.option("lineSep", line_end).text(path + ".parts")
    with replacing(spark, path) as out:
        out.write(bytearray(head))
        for name in sorted(s.getPath().getName() for s in fs.listStatus(parts)):
            if name.startswith("part-"):
                source = fs.open(file_system(spark, f"{path}.parts/{name}")[0])
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    fs.delete(parts, True)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file: byte order mark, header, rows in order, lines ended by CR LF."""
    lines = df.orderBy(*order).select(F.concat_ws(",", *(cell(F.col(f"`{c}`")) for c in columns)).alias("value"))
    header = ",".join(f'"{c}"' if "," in c else c for c in columns)
    write_lines(lines, path, MARK + header.encode() + b"\r\n", "\r\n")


_TYPES = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>"""
_TYPE = """<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>"""
_RELS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>"""
_REL = """<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>"""
_BOOK = """<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>"""
_SHEET = """<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>"""
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Fixed value: the letters that a sheet's name may have.
MOST_LETTERS = 31


def _sheet_name(first: str, k: int) -> str:
    """The name of the sheet that continues the first one as the k-th."""
    return first if k == 1 else first[: MOST_LETTERS - len(f" {k}")] + f" {k}"


def _text_cell(v: str) -> str:
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'


def _row_lines(batches: Iterator[pa.RecordBatch], numeric: list[bool]) -> Iterator[pa.RecordBatch]:
    """part, at (the row's place in it), value: each row as XML."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        lines = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = ("<c/>" if v is None else f"<c><v>{v!r}</v></c>" if is_number and isinstance(v, float) else f"<c><v>{v}</v></c>" if is_number else _text_cell(v) for v, is_number in zip(row, numeric, strict=True))
            lines.append(f"<row>{''.join(cells)}</row>")
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(lines), pa.int32()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["part", "at", "value"])
        at += len(lines)


def write_xlsx(df: DataFrame, path: str, columns: list[str], order: list[str], sheet: str, most_rows: int = MOST_ROWS) -> None:
    """One workbook with the rows in order; numbers are numeric cells.

    Rows that a sheet of `most_rows`, header included, doesn't hold go on in sheets named `<sheet> 2`, `<sheet> 3` and so
    on, each with the header. Many tasks write the rows; the driver packs their bytes into the file as streams.
    """
    spark = df.sparkSession
    numeric = [isinstance(df.schema[c].dataType, NumericType) for c in columns]
    cells = [F.col(f"`{c}`") if is_number else F.col(f"`{c}`").cast("string") for c, is_number in zip(columns, numeric, strict=True)]
    rows, parts = f"{path}.rows", f"{path}.parts"
    for left in (rows, parts):
        found, fs = file_system(spark, left)
        fs.delete(found, True)
    lines = df.orderBy(*order).select(*(c.alias(f"c{k}") for k, c in enumerate(cells))).mapInArrow(lambda batches: _row_lines(batches, numeric), "part int, at long, value string")
    lines.write.parquet(rows)
    written = spark.read.schema(lines.schema).parquet(rows)
    sizes = written.groupBy("part").agg(F.count("*").alias("n"))  # a row a task
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = written.join(F.broadcast(starts), "part").withColumn("at", F.col("before") + F.col("at"))
    placed = placed.withColumn("sheet", F.floor(F.col("at") / (most_rows - 1)).cast("int"))
    placed.orderBy("sheet", "at").select("sheet", "value").write.partitionBy("sheet").text(parts)
    folder, fs = file_system(spark, parts)
    count = max(1, sum(s.isDirectory() and s.getPath().getName().startswith("sheet=") for s in fs.listStatus(folder)))
    ks = range(1, count + 1)
    jvm = spark.sparkContext._jvm
    with replacing(spark, path) as stream:
        book = jvm.java.util.zip.ZipOutputStream(stream)

        def entry(name: str, *pieces: str) -> None:
            book.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            for piece in pieces:
                book.write(bytearray(piece.encode()))

        entry("[Content_Types].xml", _TYPES.format(sheets="".join(_TYPE.format(k=k) for k in ks)))
        entry("_rels/.rels", _RELS.format(targets=_REL.format(k=1, kind="officeDocument", target="xl/workbook.xml")))
        entry("xl/_rels/workbook.xml.rels", _RELS.format(targets="".join(_REL.format(k=k, kind="worksheet", target=f"worksheets/sheet{k}.xml") for k in ks)))
        entry("xl/workbook.xml", _BOOK.format(sheets="".join(_SHEET.format(name=escape(_sheet_name(sheet, k), {'"': "&quot;"}), k=k) for k in ks)))
        for k in ks:
            entry(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData><row>{"".join(map(_text_cell, columns))}</row>')
            own = file_system(spark, f"{parts}/sheet={k - 1}")[0]
            for name in sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else ():
                source = fs.open(file_system(spark, f"{parts}/sheet={k - 1}/{name}")[0])
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, book, 1 << 16, False)
                source.close()
            book.write(bytearray(b"</sheetData></worksheet>"))
        book.finish()
    for left in (rows, parts):
        fs.delete(file_system(spark, left)[0], True)


def _gzipped(book: pa.Buffer, member: zipfile.ZipInfo) -> bytes:
    """A member's bytes as they are packed in the workbook, as a gzip file."""
    data = memoryview(book)
    start = member.header_offset + 30 + sum(struct.unpack_from("<HH", data, member.header_offset + 26))
    packed = data[start : start + member.compress_size]
    if member.compress_type != zipfile.ZIP_DEFLATED:
        return gzip.compress(packed, 1)
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + packed + struct.pack("<II", member.CRC, member.file_size & 0xFFFFFFFF)


def _packed_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number (from 0), whether it is the last, content: the first sheet and those that continue it, each a gzip member of its own."""
    for batch in batches:
        for content in batch.column(0):
            content = content.as_buffer()
            with zipfile.ZipFile(pa.BufferReader(content)) as z:
                names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_NS + "sheet")]
                count = next((k for k, name in enumerate(names) if name != _sheet_name(names[0], k + 1)), len(names))
                for k in range(count):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([k + 1 == count]), pa.array([_gzipped(content, z.getinfo(f"xl/worksheets/sheet{k + 1}.xml"))], pa.binary())], names=["number", "last", "content"])


def read_xlsx(spark: SparkSession, path: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """row (the header is 0), cells (array of text) of a workbook's first sheet and of those that continue it (`write_xlsx`).

    A sheet is read by one task. One that another continues has to be full, else the read fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, last, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, done, held, data = number * (most_rows - 1), 0, [], None
                with gzip.open(io.BytesIO(content)) as sheet:
                    for event, e in ElementTree.iterparse(sheet, ("start", "end")):
                        if event == "start":
                            data = e if e.tag == _NS + "sheetData" else data
                        elif e.tag == _NS + "row":
                            held.append(["".join(c.itertext()) or None for c in e])
                            if len(held) == 4096:
                                yield _rows(held, first + done, number > 0 and done == 0)
                                done, held = done + len(held), []
                                data.clear()
                yield _rows(held, first + done, number > 0 and done == 0)
                if not last and done + len(held) != most_rows:
                    raise ValueError(f"sheet {number + 1} has {done + len(held)} rows of {most_rows}, though another continues it")

    sheets = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_packed_sheets, "number long, last boolean, content binary")
    return sheets.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "row long, cells array<string>")


def _rows(held: list, first: int, headed: bool) -> pa.RecordBatch:
    """Rows numbered from `first`; `headed`: without the first of them, a header that was there before."""
    first, held = first + headed, held[headed:]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["row", "cells"])
