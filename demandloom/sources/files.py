"""Small files on any file system that Spark reads: paths resolve as those of tables do.

Everything goes through Hadoop's FileSystem, so reports land beside the tables they
describe.  Without a running session (configuration only) paths are local.
"""

from __future__ import annotations

import hashlib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are hashed by executors, a task each; a longer one is streamed by the driver's JVM.
IN_TASK = 1 << 30


def _at(path: str | Path) -> tuple[Any, Any, Any] | None:
    """(JVM, file system, path), or None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(str(path))
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(path: str | Path) -> bool:
    at = _at(path)
    return Path(path).exists() if at is None else at[1].exists(at[2])


def qualified(path: str | Path) -> str:
    """The path with its scheme and authority."""
    at = _at(path)
    return Path(path).resolve().as_uri() if at is None else at[1].makeQualified(at[2]).toString()


def delete(path: str | Path) -> None:
    _, fs, where = _at(path)
    fs.delete(where, True)


def move(path: str | Path, to: str | Path) -> None:
    """Rename a file or folder on its file system; the target must not exist."""
    jvm, fs, where = _at(path)
    if not fs.rename(where, jvm.org.apache.hadoop.fs.Path(str(to))):
        raise OSError(f"can't rename {path} to {to}")


def read_text(path: str | Path) -> str:
    at = _at(path)
    if at is None:
        return Path(path).read_text()
    jvm, fs, where = at
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(text: str, path: str | Path) -> None:
    """Write through a neighbour, so that readers find the whole text or none of it."""
    at = _at(path)
    if at is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    jvm, fs, where = at
    part = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"can't write {path}")


def size(path: str | Path) -> int:
    at = _at(path)
    return Path(path).stat().st_size if at is None else at[1].getFileStatus(at[2]).getLen()


def _streamed(path: str | Path) -> str:
    jvm, fs, where = _at(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(fs.open(where), digest)
    try:
        stream.transferTo(jvm.java.io.OutputStream.nullOutputStream())
    finally:
        stream.close()
    return bytes(digest.digest()).hex()


def checksums(paths: list[str | Path], in_task: int = IN_TASK) -> dict[str, tuple[int, str]]:
    """Bytes and SHA-256 of every file, by the path given."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return {str(p): (Path(p).stat().st_size, hashlib.sha256(Path(p).read_bytes()).hexdigest()) for p in paths}
    sizes = {str(p): size(p) for p in paths}
    small = {_plain(qualified(p)): p for p, n in sizes.items() if 0 < n <= in_task}
    # Spark's reader passes empty files over.
    out = {p: (n, _streamed(p)) for p, n in sizes.items() if not 0 < n <= in_task}
    if small:
        read: DataFrame = spark.read.format("binaryFile").load(list(small.values())).repartition(len(small), "path")
        for r in read.select("path", "length", F.sha2("content", 256).alias("sha256")).collect():  # a row per source file
            out[small[_plain(r["path"])]] = (r["length"], r["sha256"])
    return out


def _plain(uri: str) -> str:
    """file:/x, file:///x alike."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if scheme == "file" else uri
