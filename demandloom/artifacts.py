"""Files, identifiers and content hashes."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import files


def file_sha256(path: str | Path) -> str:
    return files.checksums([path])[str(path)][1]


def source_manifest(found: dict[str, str | Path]) -> dict[str, Any]:
    """Size and checksum of every source file."""
    sums = files.checksums(list(found.values()))
    told = {k: {"path": str(p), "bytes": sums[str(p)][0], "sha256": sums[str(p)][1]} for k, p in sorted(found.items())}
    return {"files": told, "generated_at": datetime.now(UTC).isoformat()}


def stable_id(payload: dict[str, Any], prefix: str) -> str:
    """prefix and the first 12 hex digits of the payload's canonical JSON."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def content_hash(df: DataFrame, digits: int = 6, exclude: tuple[str, ...] = ()) -> str:
    """Row count and order-free sum of row hashes: equal for equal contents under any partitioning."""
    cols = [F.round(c, digits) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes) if c not in exclude]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with zstd; rows sorted within files for row-group pruning."""
    (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(value: Any, path: str | Path) -> None:
    """Beside the tables: on whatever file system Spark resolves the path to."""
    files.write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path)


def read_json(path: str | Path) -> Any:
    return json.loads(files.read_text(path))
