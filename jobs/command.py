"""What the jobs' command lines share: arguments, the config file, logging and the session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def default_config(job_file: str) -> dict:
    """The small JSON file beside the job."""
    return json.loads(Path(job_file).with_suffix(".json").read_text())


def main(job: Callable[..., dict], job_file: str, paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Runs `job(spark, config=..., **paths)`; each of `paths` is an argument with its help. Creates the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{Path(job_file).stem}", description=job.__doc__)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file; without it the one beside the job")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(given.config).read_text()) if given.config else default_config(job_file)
    spark = SparkSession.builder.appName(Path(job_file).stem).getOrCreate()
    try:
        job(spark, config=config, **{name: getattr(given, name) for name in paths})
    finally:
        spark.stop()
