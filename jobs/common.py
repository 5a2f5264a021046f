"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def parsed(doc: str, paths: Sequence[str], config: str, argv: Sequence[str] | None = None) -> tuple[argparse.Namespace, dict]:
    """The arguments and the settings of the config file."""
    parser = argparse.ArgumentParser(description=doc)
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("--config", default=config, help="a JSON file with the job's settings")
    args = parser.parse_args(argv)
    with open(args.config) as f:
        settings = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return args, settings


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; empty if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
