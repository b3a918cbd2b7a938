"""What the jobs share: config files, logging and sessions of command lines."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession


def config_of(module: str, path: str | None = None, spark: SparkSession | None = None) -> dict:
    """The settings of the file beside the module, with those of `path` (read by Spark, so it may be remote) in their place; unknown names are an error."""
    settings = json.loads(Path(module).with_suffix(".json").read_text())
    if path is not None:
        given = json.loads(spark.read.text(path, wholetext=True).first()[0])
        unknown = set(given) - set(settings)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        settings |= given
    return settings


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
