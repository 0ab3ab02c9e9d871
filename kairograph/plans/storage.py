"""Intermediate tables in the shared folder, so that lost executors cost nothing twice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import cache
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session, as in tests, may go without the setting; it then gets a
    folder of its own. On a cluster a missing setting is an error, since a folder
    on one machine is not readable by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="kairograph-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/kairograph/{name}-{uuid.uuid4().hex}"


# So many jobs that do not need each other are given to Spark together: one fills the cores that the last tasks of others leave.
TOGETHER = 4


def together(make: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """What `make` gives for each item, in their order, by some threads; the first error is raised."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        return [*pool.map(make, items)]


class Once:
    """Results by key, each worked out by the thread that asks first, while others wait for it."""

    def __init__(self) -> None:
        self._lock = Lock()
        self._found: dict[Hashable, Future] = {}

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        with self._lock:
            first = key not in self._found
            future = self._found.setdefault(key, Future())
        if first:
            try:
                future.set_result(make())
            except BaseException as error:
                future.set_exception(error)
        return future.result()

    def __len__(self) -> int:
        return len(self._found)


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), rebalance: bool = True) -> DataFrame:
    """Write `df` to the shared folder and return the table read back.

    With partition columns, rows are first rebalanced on them: a value that holds most of
    the rows is split over tasks, and rare values do not leave one small file per task. Rows that lie evenly
    already, with few values in all, need no such shuffle.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if partition_by:
        balanced = df.hint("rebalance", *partition_by) if rebalance else df
        balanced.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
