"""What the jobs share: configs, sessions, logging, scratch folders of the registered queries."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("corvine.jobs")


def defaults(job: str) -> dict:
    """The config beside a job."""
    return json.loads((Path(__file__).parent / f"{job}.json").read_text())


def config_of(spark: SparkSession, job: str, path: str | None) -> dict:
    """The job's config with the values of another file, of any store that Spark reads, in front."""
    own = defaults(job)
    if path is None:
        return own
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(given.keys() - own.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return own | given


def command(job: str, about: str, paths: dict[str, str], run: Callable[[SparkSession, argparse.Namespace, dict], object], argv: list[str] | None) -> int:
    """Parses the paths and --config, makes the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help=f"JSON file; what it leaves out is as in {job}.json")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, args, config_of(spark, job, args.config))
    finally:
        spark.stop()
    return 0


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call, under the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # as in tests; a cluster names one
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="corvine-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
