"""Cutting lineage with tables written to the shared checkpoint folder.

A written table is columnar and compressed, survives the loss of any executor and can be
read with column pruning, so iterative operators use it in place of in-memory blocks. An
operator marked `settled` writes its result and drops every table it wrote on the way.
"""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Tables written, one list for each settled operator under way; the first list is of those that last.
_WRITTEN: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on a local master (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "muster-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it back; the result has no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/muster/{name}-{uuid.uuid4().hex}"
    _WRITTEN[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._muster_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table cut() gave, before its operator ends; nothing read from it may be used any more."""
    for tables in _WRITTEN:
        own = [x for x in tables if x[1] == df._muster_path]
        tables[:] = [x for x in tables if x[1] != df._muster_path]
        _drop(own)


def cut_counted(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """cut(df) and how many rows were written (rows of tasks that ran again may count twice; none is 0)."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get.get("n", 0)


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the session has ended
            return


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result is written as one table, and the tables it wrote on the way are dropped."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _WRITTEN.append([])
        try:
            out = operator(*args, **kwargs)
            own = _WRITTEN.pop()
        except BaseException:
            _drop(_WRITTEN.pop())
            raise
        out = cut(out, operator.__name__)
        _drop(own)
        return out

    return run


def drop_written() -> None:
    """Deletes every table cut() wrote in this process."""
    for tables in _WRITTEN:
        _drop(tables)


atexit.register(drop_written)
