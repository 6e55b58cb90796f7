"""What the jobs' command lines share: arguments, config, log and session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config(name: str, path: str = "") -> dict:
    """The values of a job's own config file, over which those of path, a file of the command line, are laid."""
    out = {}
    for p in (os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), path):
        if p:
            with open(p, encoding="utf-8") as f:
                out |= json.load(f)
    return out


def counted(df, **more):
    """(df, observation): its rows, and more aggregates, are counted while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]), seen


def main(name: str, about: str, run: Callable[..., None], *paths: str) -> None:
    """Parses the paths and --config, creates a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", default="", help="a JSON file whose values replace those of the job's own")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[getattr(args, p) for p in paths], config(name, args.config))
    finally:
        spark.stop()
