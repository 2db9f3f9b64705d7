"""Tables staged between steps in the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

_JOB: ContextVar[str] = ContextVar("job", default="")  # the folder of the running job
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # table -> its folder
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING, _FREED = threading.Lock(), []  # what the option was before, once for each write that runs


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, one process on one machine makes a folder of its own; on a
    cluster that would lose rows and is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = found or tempfile.mkdtemp(prefix="earshot-")
        context.setCheckpointDir(found)
    return found


def staging_dir(spark: SparkSession) -> str:
    """The folder of what this application stages, or of what the job around it does (``staged_within``)."""
    return f"{shared_dir(spark)}/earshot-{spark.sparkContext.applicationId}{_JOB.get()}"


@contextmanager
def staged_within(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end; only what was written elsewhere may be read after it."""
    token = _JOB.set(f"{_JOB.get()}/job-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, staging_dir(spark))
        _JOB.reset(token)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is deleted at its end, not when the driver next happens to collect garbage."""
    with _FREEING:
        _FREED.append(_FREED[-1] if _FREED else spark.conf.get(FREES, None))
        spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        with _FREEING:
            before = _FREED.pop()
            if not _FREED:
                spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table written once in the folder that executors share, and read back.

    What several steps read is computed once and outlives lost executors. ``folder`` is
    ``staging_dir`` as it was outside of ``staged_within``, for what is read after it.
    """
    spark = df.sparkSession
    path = f"{folder or staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _STAGED[found] = path
    return found


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; others stay as they are."""
    path = _STAGED.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)


def staged_once(df: DataFrame, name: str) -> DataFrame:
    """The table staged, unless it is a staged table as it stands."""
    return df if df in _STAGED else staged(df, name)


def staged_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables that do not depend on one another, staged at the same time; those that are staged stay as they are."""
    with ThreadPoolExecutor(len(tables) or 1) as pool:
        jobs = {k: pool.submit(copy_context().run, staged_once, df, k) for k, df in tables.items()}
        return {k: job.result() for k, job in jobs.items()}


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that still read it are lost."""
    _delete(spark, staging_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
