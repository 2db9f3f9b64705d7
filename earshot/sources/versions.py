"""Versioned folders behind a pointer: what is read is always one whole build.

A build writes a new folder ``v-...`` and, when all of it is there, adds a pointer to it
with the options it was built with and a fingerprint of its input. The pointer with
the largest number counts, so a build that is killed leaves the one before as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

POINTERS = "pointers"


def fingerprint(spark: SparkSession, path: str) -> str | None:
    """A digest of the names, sizes and times of the files at the path; None if there are none."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    files, found = system.listFiles(root, True), []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.md5(json.dumps(sorted(found)).encode()).hexdigest()


def current(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """(folder, options) of the build that counts, or None."""
    try:
        pointers = spark.read.parquet(f"{path}/{POINTERS}")
    except AnalysisException:
        return None
    last = pointers.orderBy(F.desc("number")).first()
    return None if last is None else (f"{path}/{last.version}", json.loads(last.options))


def _publish(spark: SparkSession, path: str, version: str, options: Mapping) -> None:
    try:
        number = spark.read.parquet(f"{path}/{POINTERS}").agg(F.max("number").alias("n")).first().n + 1
    except AnalysisException:
        number = 0
    row: DataFrame = spark.createDataFrame([(number, version, json.dumps(options))], "number long, version string, options string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/{POINTERS}")


def differing(asked: Mapping, stored: Mapping) -> dict:
    """Options that are not as stored; an input that is gone (None) cannot be told apart."""
    return {k: (stored.get(k), v) for k, v in asked.items() if stored.get(k) != v and not (k.startswith("input") and v is None)}


def built(spark: SparkSession, path: str, options: Mapping, build: Callable[[str], None], overwrite: bool = False) -> str:
    """The folder of the build with these options: the stored one, or a new one that ``build`` fills.

    A stored build with other options or another input is an error unless
    ``overwrite`` is set.
    """
    found = current(spark, path)
    if found is not None and not overwrite:
        other = differing(options, found[1])
        if other:
            told = ", ".join(f"{k} is {was!r}, asked is {now!r}" for k, (was, now) in sorted(other.items()))
            raise ValueError(f"{path} was built otherwise: {told}; set overwrite to build it anew")
        return found[0]
    version = f"v-{uuid.uuid4().hex}"
    build(f"{path}/{version}")
    _publish(spark, path, version, options)
    return f"{path}/{version}"


def drop_old(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions but the one that counts, unfinished ones too; readers of those lose them."""
    found = current(spark, path)
    if found is None:
        return []
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(context._jsc.hadoopConfiguration())
    gone = []
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and f"{path}/{name}" != found[0]:
            system.delete(status.getPath(), True)
            gone.append(name)
    return gone
