"""Runs that readers find whole or not at all.

A run is written to a folder beside its target.  When all of it is there, a manifest
with content hashes of its tables and digests of its texts is added, the old run moves
aside, and the folder takes the target's name.  If the driver dies in between, readers
find the old run under one of its two names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from ..artifacts import content_hash
from ..sources import files
from .validate import require

MANIFEST = "run_manifest.json"


def previous(output: str) -> str:
    return f"{output.rstrip('/')}.previous"


def complete(output: str) -> bool:
    return files.exists(f"{output}/{MANIFEST}")


def readable(output: str) -> str:
    """The folder of the last complete run of this target."""
    for place in (output, previous(output)):
        if complete(place):
            return place
    raise ValueError(f"{output} holds no complete run")


def verify(spark: SparkSession, output: str) -> dict[str, Any]:
    """The manifest of a complete run, after a check that all it names is as it was written."""
    told = json.loads(files.read_text(f"{output}/{MANIFEST}"))
    for name, want in told["tables"].items():
        require(content_hash(spark.read.parquet(f"{output}/{name}")) == want, f"{output}/{name} has changed")
    for name, want in told["texts"].items():
        require(_digest(f"{output}/{name}") == want, f"{output}/{name} has changed")
    return told


def _digest(path: str) -> str:
    return hashlib.sha256(files.read_text(path).encode()).hexdigest()


def publish(spark: SparkSession, output: str, make: Callable[[str], Any], tables: list[str], texts: list[str]) -> Any:
    """Run ``make`` on a staging folder and put what it wrote in the place of ``output``; returns its result.

    ``tables`` and ``texts`` name what a complete run consists of.  If ``make`` fails, or
    has left one of them out, the old run stays and the staging folder goes.
    """
    output = output.rstrip("/")
    staging = f"{output}.staging-{uuid.uuid4().hex[:12]}"
    try:
        result = make(staging)
        told = {"tables": {t: content_hash(spark.read.parquet(f"{staging}/{t}")) for t in tables}, "texts": {t: _digest(f"{staging}/{t}") for t in texts}}
        files.write_text(json.dumps(told, indent=2, sort_keys=True), f"{staging}/{MANIFEST}")
    except BaseException:
        files.delete(staging)
        raise
    if files.exists(output):
        if complete(output) or not complete(previous(output)):
            files.delete(previous(output))
            files.move(output, previous(output))
        else:  # a folder that is no run, left by a run that died between the two moves
            files.delete(output)
    files.move(staging, output)
    files.delete(previous(output))
    return result
