"""Project archives (a ZIP of manifest.json and state.json), file fingerprints and row-level validation."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import settings as S
from ..operators.markers import sync
from .files import replacing

#: Version and limits of project files, and the bytes a fingerprint reads at each place.
VERSION, MOST_MANIFEST, MOST_STATE, SAMPLE = 3, 1 << 20, 256 << 20, 1 << 20


def _places(size: int) -> list[int]:
    """Where a fingerprint's samples begin: at the start, in the middle and at the end of a file longer than one."""
    return sorted({0} | ({(size - SAMPLE) // 2, size - SAMPLE} if size > SAMPLE else set()))


def fingerprint_of(size: int, read: Callable[[int, int], bytes]) -> str:
    """SHA-256 over the size as text, then of each sample the offset (8 bytes, little end first) and 1 MiB; `read` is (offset, length)."""
    out = hashlib.sha256(str(size).encode())
    for at in _places(size):
        out.update(at.to_bytes(8, "little") + read(at, min(SAMPLE, size - at)))
    return out.hexdigest()


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, sample_sha256 of a project's few source files: of each, three ranges are read and nothing else."""
    jvm, found = spark.sparkContext._jvm, []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = fs.getFileStatus(target).getLen()
        stream = fs.open(target)

        def read(at: int, length: int, stream=stream) -> bytes:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length)) if length else b""

        try:
            found.append((path, size, fingerprint_of(size, read)))
        finally:
            stream.close()
    return spark.createDataFrame(found, "path string, size long, sample_sha256 string")


def check_sources(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose fingerprint is the stored one; any other is an error."""
    both = stored.select("path", F.col("sample_sha256").alias("want")).join(found, "path", "left")
    same = F.coalesce(F.col("sample_sha256") == F.col("want"), F.lit(False))
    return both.select("path", F.when(same, F.col("sample_sha256")).otherwise(F.raise_error(F.concat(F.lit("the source changed: "), "path")).cast("string")).alias("sample_sha256"))


def save(spark: SparkSession, path: str, manifest: dict, state: dict) -> None:
    """Writes beside the target and renames, so a reader sees the old archive or the new one."""
    members = {"manifest.json": (json.dumps(manifest), MOST_MANIFEST), "state.json": (json.dumps(state), MOST_STATE)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, (text, most) in members.items():
            if len(text.encode()) > most:
                raise ValueError(f"{name} is too large")
            z.writestr(name, text)
    with replacing(spark, path) as stream:
        stream.write(bytearray(out.getvalue()))


def load(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(manifest, state): bounded members, today's version alone, settings migrated."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = []
        for name, most in (("manifest.json", MOST_MANIFEST), ("state.json", MOST_STATE)):
            if z.getinfo(name).file_size > most:
                raise ValueError(f"{name} is too large")
            parts.append(json.loads(z.read(name)))
    manifest, state = parts
    if manifest.get("version") != VERSION:
        raise ValueError(f"version {manifest.get('version')} can't be read")
    data = dict(state.get("data") or {})
    legacy = data.pop("line_noise_hz", None)
    given = data.get("lfp_filter_settings")
    row = spark.createDataFrame([(None if given is None else json.dumps(given), legacy)], "given string, legacy double")
    data["lfp_filter_settings"] = json.loads(row.select(S.to_json(S.migrate(F.col("given"), F.col("legacy")))).first()[0])
    return manifest, state | {"data": data}


MARKER_SCHEMA = "marker_id string, seq long, kind string, source string, domain string, time_sec double, frame_index long, note string"


def save_project(spark: SparkSession, path: str, sources: list[str], state: dict, markers: DataFrame) -> None:
    """The archive, with the fingerprints of its sources, and its markers as a table beside it (`<path>.markers`)."""
    names = [x.split()[0] for x in MARKER_SCHEMA.split(", ")]
    markers.select(*names).write.mode("overwrite").parquet(path + ".markers")
    found = {r.path: {"size": r.size, "sample_sha256": r.sample_sha256} for r in fingerprints(spark, sources).collect()}
    save(spark, path, {"version": VERSION, "sources": found}, state)


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, dict, DataFrame]:
    """(markers, settings, sync): sources checked first, markers replaced as a whole, the offset taken from the markers.

    A source that is gone or isn't the file that was saved is an error. What the archive says about the offset and
    origins isn't trusted: they follow from the markers.
    """
    manifest, state = load(spark, path)
    stored = spark.createDataFrame([(p, x["sample_sha256"]) for p, x in manifest["sources"].items()], "path string, sample_sha256 string")
    check_sources(fingerprints(spark, list(manifest["sources"])), stored).collect()  # a few rows, or an error
    markers = spark.read.schema(MARKER_SCHEMA).parquet(path + ".markers")
    return markers, state["data"]["lfp_filter_settings"], sync(markers)


def broken_rule() -> Column:
    """The first rule that a marker's row breaks, null for a sound one."""
    rules = {
        "kind": F.col("kind").isin("ttl", "led_on", "led_off", "action_start", "action_end", "seizure_like", "lfp_peak"),
        "domain": F.col("domain").isin("video", "record"),
        "time": F.col("time_sec").isNotNull() & ~F.isnan("time_sec") & (F.abs("time_sec") < float("inf")),
        "frame": F.col("frame_index").isNull() | (F.col("frame_index") >= 0) & (F.col("domain") == "video"),
        "id": F.length("marker_id") > 0,
    }
    first = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        first = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(first)
    return first


def bad_markers(markers: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first rule broken; a table without rows here is valid."""
    return markers.withColumn("broken", broken_rule()).where("broken is not null")
