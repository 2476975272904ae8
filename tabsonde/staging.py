"""Keeping an intermediate table that several jobs read, and running jobs side by side.

On a cluster the table is written to the shared folder named in ``spark.checkpoint.dir`` and
read back: lineage is cut, executor loss costs nothing, and later scans prune columns. Where
no such folder is set the table is persisted instead, which Spark rebuilds after a loss.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a staged table when the program ends, if its session still runs then."""
    _WRITTEN.append((spark, path))


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        # At the end of a program the session may be gone already.
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(df: DataFrame) -> str | None:
    return df.sparkSession.conf.get("spark.checkpoint.dir", None)


def stage(df: DataFrame) -> DataFrame:
    folder = shared_folder(df)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Submit independent Spark jobs at the same time and wait for all results."""
    carry = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        waiting = [pool.submit(carry(job)) for job in jobs]
        return [w.result() for w in waiting]
