"""What the jobs share: configuration, logging, and the command line around a job's function."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configuration(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The settings of a JSON file, which Spark reads so that it may be remote; what it leaves out is as in `defaults`,
    and a name that is not there is an error."""
    found = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    unknown = sorted(set(found) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {**defaults, **found}


def main(job: Callable[..., object], defaults: dict, text: str, file: str, argv: list[str] | None = None) -> None:
    """Runs job(spark, input, output, checkpoint, settings) in a session of its own."""
    p = argparse.ArgumentParser(description=text)
    p.add_argument("--input", required=True, help="path of the table to read")
    p.add_argument("--output", required=True, help="folder of the results")
    p.add_argument("--checkpoint", required=True, help="folder that the job keeps between runs; not shared with other jobs")
    p.add_argument("--config", default=str(Path(file).with_suffix(".json")), help="JSON file of settings")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(file).stem).getOrCreate()
    try:
        job(spark, a.input, a.output, a.checkpoint, configuration(spark, a.config, defaults))
    finally:
        spark.stop()
