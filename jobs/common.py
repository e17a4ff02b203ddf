"""What the jobs share: arguments, configuration, the log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("corvane.jobs")


def load(path: str | None, default: str) -> dict:
    """The configuration file, or the one beside the job; unknown keys are refused."""
    known = json.loads((Path(__file__).parent / default).read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if more := given.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(more)}")
    return known | given


def arguments(about: str, *names: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=about)
    for name in names:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark can read or write")
    parser.add_argument("--config", help="a JSON file of settings; the others keep their defaults")
    return parser.parse_args()


def session(name: str) -> SparkSession:
    """For the command line only: whatever the submitting side set, in UTC."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
