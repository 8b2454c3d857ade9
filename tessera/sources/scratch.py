"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders named since the innermost tidy() operator began.
_named: ContextVar[list[str] | None] = ContextVar("named", default=None)


def new_folder(spark: SparkSession) -> str:
    """A new folder name in the session's spark.checkpoint.dir; where that is unset, one is made if the master is this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = context._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: branches share it, the plan starts anew, a lost executor costs nothing."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(operator: Callable) -> Callable:
    """An operator that removes the tables it wrote as it returns, but for those that its result reads.

    What the result reads stays until an operator around this one returns, or for good.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs):
        mine: list[str] = []
        token, kept = _named.set(mine), []
        try:
            out = operator(*args, **kwargs)
            read = [root for x in (out if isinstance(out, tuple) else [out]) if isinstance(x, DataFrame) for root in _roots(x)]
            kept = [path for path in mine if any(root.endswith(path.rsplit("/", 1)[1]) for root in read)]
        finally:
            _named.reset(token)
            _remove([path for path in mine if path not in kept])
        if (outer := _named.get()) is not None:
            outer += kept
        return out

    return run


def _roots(df: DataFrame) -> list[str]:
    """The folders that a DataFrame reads."""
    out, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                out.append(paths.next().toString())
    return out


def _remove(paths: list[str]) -> None:
    if not paths:
        return
    context = SparkSession.active().sparkContext
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
