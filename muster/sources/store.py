"""Reading and writing the store: idempotent upserts, deletes, run log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, arrival: str) -> DataFrame:
    """old and those of new whose key is not there yet; within new the first to arrive."""
    first = Window.partitionBy(key).orderBy(arrival)
    fresh = new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: str, arrival: str) -> DataFrame:
    """new, last to arrive for each key, and those of old that it doesn't replace."""
    last = Window.partitionBy(key).orderBy(F.col(arrival).desc())
    fresh = new.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*old.columns))


def json_safe(c: Column) -> Column:
    """NaN and infinite numbers as null, which JSON can hold."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def write_corpus(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a docket, so that a docket's reads touch its own files; overwrite replaces only the dockets in df."""
    df.repartition("docket_id").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("docket_id").parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    df.drop(*without).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_fingerprints(df: DataFrame, path: str) -> None:
    """Adds rows of (docket_id, cluster, argument_hash, ..) to the fingerprints kept."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def cached_json(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows kept at path; where nothing is kept yet, those of make() are written first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        write_json(make(), path)
    return spark.read.json(path)


def read_registry(spark, path: str) -> DataFrame:
    """A registry of entities from CSV: pos, name, sector, type, lobby_intensity; pos is the entry's place in the order that settles ties."""
    return spark.read.schema("pos int, name string, sector string, type string, lobby_intensity string").option("header", True).csv(path)
