"""What the jobs share: configuration, the command line, and the shape of their logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configuration(job: str, path: str | None = None) -> dict:
    """The job's own settings, with those of a JSON file over them. Unknown names are errors."""
    known = json.loads((Path(__file__).parent / f"{job}.json").read_text())
    if path is None:
        return known
    own = json.loads(Path(path).read_text())
    if unknown := sorted(set(own) - set(known)):
        raise ValueError(f"unknown settings: {unknown}; known are {sorted(known)}")
    return known | own


def main(job: str, run: Callable, paths: dict[str, str], argv: list[str] | None = None) -> int:
    """The command line of a job: its paths, then --config. Makes the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=(run.__doc__ or "").split("\n")[0])
    for name, says in paths.items():
        parser.add_argument(name, help=says)
    parser.add_argument("--config", help=f"JSON file of settings; without one those of jobs/{job}.json hold")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(getattr(args, name) for name in paths), settings=configuration(job, args.config))
    finally:
        spark.stop()
    return 0
