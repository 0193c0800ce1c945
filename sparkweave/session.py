"""What every operator needs from the session: the shared folder, written tables, code on workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = str(Path(__file__).resolve().parent.parent)
#: For each thread the folders that running operators wrote, innermost operator last.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a fresh folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sparkweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    What the write shuffled is deleted with its end, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if getattr(_OPEN, "stack", None):
        _OPEN.stack[-1].add(path)
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def _bare(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/") if "://" in path or path.startswith("file:") else path.lstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    root = _bare(shared_dir(spark))
    for folder in _folders(df):
        if _bare(folder).startswith(root):
            _delete(spark, folder)


def _frames(value: Any) -> list[DataFrame]:
    """The DataFrames of an operator's result."""
    if isinstance(value, DataFrame):
        return [value]
    if isinstance(value, (tuple, list)):
        return [f for v in value for f in _frames(v)]
    return [v for n in ("nodes", "edges") if isinstance(v := getattr(value, n, None), DataFrame)]


def tidy(operator: Callable) -> Callable:
    """An operator that deletes, when it returns or fails, every table it wrote that its result does not read.

    Tables that the result reads stay until the operator that called it, if
    that is tidy too, ends.
    """

    @wraps(operator)
    def run(*args: Any, **values: Any) -> Any:
        stack = _OPEN.__dict__.setdefault("stack", [])
        stack.append(set())
        held: set[str] = set()
        result = None
        try:
            result = operator(*args, **values)
            read = {_bare(f) for frame in _frames(result) for f in _folders(frame)} if stack[-1] else set()
            held = {f for f in stack[-1] if _bare(f) in read}
            return result
        finally:
            for folder in stack.pop() - held:
                _delete(SparkSession.active(), folder)
            if stack:
                stack[-1] |= held

    return run


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (a checkout on one machine)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
