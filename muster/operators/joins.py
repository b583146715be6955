"""Join operators Spark has no direct form of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def band_pairs(events: DataFrame, id_col: str, micros_col: str, seconds: int, keep: list[str] | None = None) -> DataFrame:
    """(id_a, id_b, gap_us): pairs of events at most seconds apart, id_a < id_b.

    The time line is cut into cells of that length; each event meets those of its own cell and the
    two beside it in an equi-join on the cell, so no pair is compared across the whole line.
    """
    us = seconds * 1_000_000
    cell = F.floor(F.col(micros_col) / us)
    a = events.select(F.col(id_col).alias("id_a"), F.col(micros_col).alias("ta"), cell.alias("cell"))
    b = events.select(F.col(id_col).alias("id_b"), F.col(micros_col).alias("tb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = (F.col("id_a") < F.col("id_b")) & (F.abs(F.col("ta") - F.col("tb")) <= us)
    return a.join(b, "cell").where(near).select("id_a", "id_b", F.abs(F.col("ta") - F.col("tb")).alias("gap_us"))


def similar_sets(sets: DataFrame, id_col: str, set_col: str, threshold: float) -> DataFrame:
    """(id_a, id_b, jaccard) of sets with a Jaccard index of at least threshold > 0, id_a < id_b; exact.

    Elements are ordered by how rare they are; of a set of n, two similar sets must share one of
    the first n - ceil(threshold * n) + 1, so only those prefixes are joined (and pairs of very
    different size dropped) before the whole sets are compared. Elements of one set only stand
    first in the order and join with nothing, so they are counted, not listed.
    """
    one = sets.select(F.col(id_col).alias("id"), F.size(set_col).alias("n"), F.explode(set_col).alias("g"))
    shared = one.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("df >= 2")
    ranked = shared.groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    prefix = F.slice("s", F.lit(1), F.greatest(F.lit(0), first - (F.col("n") - F.size("s"))))
    heads = ranked.select("id", "n", F.explode(F.transform(prefix, lambda x: x["g"])).alias("g"))
    a, b = (heads.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n{x}"), "g") for x in "ab")
    size = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    cand = a.join(b, "g").where((F.col("id_a") < F.col("id_b")) & size).select("id_a", "id_b").distinct()
    whole = sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("g"))
    both = cand.join(whole.select(F.col("id").alias("id_a"), F.col("g").alias("ga")), "id_a").join(whole.select(F.col("id").alias("id_b"), F.col("g").alias("gb")), "id_b")
    shared = F.size(F.array_intersect("ga", "gb"))
    j = shared / (F.size("ga") + F.size("gb") - shared)
    return both.select("id_a", "id_b", j.alias("jaccard")).where(F.col("jaccard") >= threshold)


def nearest(left: DataFrame, right: DataFrame, by: str, left_at: Column, right_at: Column, value: Column, out: str) -> DataFrame:
    """left with the value of the right row nearest in place within the same `by`; the earlier one on a tie."""
    r = right.select(by, right_at.alias("_at"), value.alias("_v"))
    l = left.withColumn("_key", F.monotonically_increasing_id()).withColumn("_here", left_at)
    gap = F.struct(F.abs(F.col("_at") - F.col("_here")), F.col("_at"))
    best = l.join(r, by).groupBy("_key").agg(F.min_by("_v", gap).alias(out))
    return l.join(best, "_key", "left").drop("_key", "_here")


def ranks_in(events: DataFrame, by: str, at: str) -> DataFrame:
    """events with lo (how many of the same `by` are earlier) and hi (how many are not later)."""
    w = Window.partitionBy(by).orderBy(at)
    return events.withColumn("lo", F.rank().over(w) - 1).withColumn("hi", F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
