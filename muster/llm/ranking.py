"""Problem 4: one ranking from scores on different scales, by robust rank aggregation.

Each score is turned into a normalised rank (1/n for the strongest, ties sharing their mean), so
only its order counts. An item's normalised ranks are sorted; the k-th least of m has, were the
ranks random, a beta distribution of (k, m - k + 1), and the probability of one as small tells
how surprising it is. The least of these probabilities, times the number of scores the item has,
is its significance; items are ranked by its logarithm, which keeps the strongest of very many apart.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from muster.plans.lineage import cut, settled


#: A value that at least one in HOT rows of a score have is joined apart.
HOT = 1_000


def beta_tail(x: Column, k: int, m: int) -> Column:
    """P(the k-th least of m uniform numbers <= x) = sum of the binomial terms from k to m."""
    total = F.lit(0.0)
    for j in range(k, m + 1):
        total = total + F.lit(float(comb(m, j))) * F.pow(x, F.lit(float(j))) * F.pow(F.lit(1.0) - x, F.lit(float(m - j)))
    return total


def _usable(c: Column) -> Column:
    """The score, null where it is missing, NaN or infinite."""
    v = c.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def normalised_ranks(items: DataFrame, key: list[str], scores: dict[str, Column]) -> DataFrame:
    """(key..., score, r): r in (0, 1], small for strong; ties share the mean of their ranks.

    Ranks come from one count for each distinct value of a score and running sums over ranges of
    values, so no score is sorted in one task.
    """
    named = F.array(*[F.struct(F.lit(n).alias("score"), _usable(c).alias("v")) for n, c in scores.items()])
    long = items.select(*key, F.explode(named).alias("s")).select(*key, "s.score", F.col("s.v").alias("v")).where(F.col("v").isNotNull())
    long = cut(long, "scores")
    values = cut(long.groupBy("score", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("score", "v").withColumn("part", F.spark_partition_id()), "values")
    sums = values.groupBy("score", "part").agg(F.sum("n").alias("n"), F.max("v").alias("top"))  # one row for each score and part
    after = Window.partitionBy("score").orderBy(F.col("top").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("score", "part", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy("score")).alias("total"))
    within = Window.partitionBy("score", "part").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(F.broadcast(starts), ["score", "part"]).withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    ranks = placed.select("score", "v", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias("r"), "n", "total")
    # Values that many share (at most HOT a score) go to the rows; the others are joined on (score, value).
    ranks = cut(ranks.withColumn("hot", F.col("n") * HOT >= F.col("total")).drop("n", "total"), "ranks")
    hot = ranks.where("hot").select("score", "v", F.col("r").alias("hot_r"))
    marked = long.join(F.broadcast(hot), ["score", "v"], "left")
    rest = marked.where("hot_r IS NULL").drop("hot_r").join(ranks.where("NOT hot").select("score", "v", "r"), ["score", "v"])
    return marked.where("hot_r IS NOT NULL").select(*key, "score", F.col("hot_r").alias("r")).unionByName(rest.select(*key, "score", "r"))


@settled
def robust_ranking(items: DataFrame, key: list[str], scores: dict[str, Column]) -> DataFrame:
    """(key..., n_scores, significance, log_significance, rank): significance in (0, 1], rank 1 for the least; ties by key.

    The rank goes by the natural logarithm to 9 places; significance is rounded to 12 for reading only.

    Missing, NaN and infinite scores are left out of an item's ranks; an item without any score has
    significance 1 and comes last. Repeated keys count once (the row with the largest scores, null
    least). An empty table gives an empty result; other columns are ignored. At most 60 scores.
    """
    if len(scores) > 60:
        raise ValueError("at most 60 scores")
    m_all = len(scores)
    picked = items.select(*key, *[_usable(c).alias(f"_s{k}") for k, c in enumerate(scores.values())])
    picked = cut(picked.groupBy(*key).agg(F.max(F.struct(*[f"_s{k}" for k in range(m_all)])).alias("_s")), "items")
    ranks = normalised_ranks(picked, key, {n: F.col(f"_s._s{k}") for k, n in enumerate(scores)})
    lists = ranks.groupBy(*key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    found = picked.select(*key).join(lists, key, "left").withColumn("n_scores", F.coalesce(F.size("r"), F.lit(0)))
    significance = F.lit(1.0)
    for m in range(1, m_all + 1):
        least = F.least(*[beta_tail(F.get("r", F.lit(k - 1)), k, m) for k in range(1, m + 1)]) if m > 1 else beta_tail(F.get("r", F.lit(0)), 1, 1)
        significance = F.when(F.col("n_scores") == m, F.least(F.lit(1.0), least * F.lit(float(m)))).otherwise(significance)
    found = found.select(*key, "n_scores", significance.alias("p"))
    found = cut(found.select(*key, "n_scores", F.round("p", 12).alias("significance"), F.round(F.log("p"), 9).alias("log_significance")), "significance")
    # The rank is the place in the order: numbered within ranges, each started at the count before it.
    ordered = cut(found.repartitionByRange("log_significance", *key).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("log_significance", *key))
    return ordered.join(F.broadcast(starts), "part").select(*key, "n_scores", "significance", "log_significance", (F.col("start") + inside).cast("long").alias("rank"))
