"""Statistics of clusters against their run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from muster.functions import text as T
from muster.functions.fixed import CAMPAIGN, UNCERTAIN

BY = ["run_id", "cluster"]


def geography(members: DataFrame) -> DataFrame:
    """members: id, run_id, cluster, state. Concentration of each cluster of three or more against its run's states."""
    run_states = members.where("state IS NOT NULL").groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("dc"))
    total = Window.partitionBy("run_id")
    run_states = run_states.withColumn("dn", F.sum("dc").over(total))
    run_h = run_states.groupBy("run_id").agg((-F.sum(F.col("dc") / F.col("dn") * F.log2(F.col("dc") / F.col("dn")))).alias("dh"))
    own = members.where("cluster <> -1")
    states = own.where("state IS NOT NULL").groupBy(*BY, "state").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    sizes = own.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.count("state").alias("located")).where("n >= 3")
    joined = states.join(sizes, BY).join(run_states, ["run_id", "state"])
    p = F.col("c") / F.col("located")
    top = F.min_by("state", F.struct(-F.col("c"), "first"))
    sums = joined.groupBy(*BY).agg(F.count(F.lit(1)).alias("k"), top.alias("top"), F.max("c").alias("tc"), (-F.sum(p * F.log2(p))).alias("h"), F.sum(p * F.log2(p / (F.col("dc") / F.col("dn")))).alias("kl")).join(run_h, "run_id")
    few = F.col("located") < 3
    share = F.col("located") / F.col("n")
    ratio = F.when(F.col("dh") > 0, F.col("h") / F.nullif("dh", F.lit(0.0))).otherwise(1.0)
    return sizes.join(sums, BY, "left").select(
        *BY, "n", F.round(share, 3).alias("completeness"),
        F.when(few, 0).otherwise(F.col("k")).alias("n_states"),
        F.when(~few, F.col("top")).alias("top_state"),
        F.when(few, 0.0).otherwise(F.round(F.col("tc") / F.col("located"), 3)).alias("top_pct"),
        F.when(few, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio)), 4)).alias("concentration"),
        F.when(~few, F.round("kl", 4)).alias("kl"),
        F.when(few, "low").when(share >= 0.7, "high").when(share >= 0.4, "medium").otherwise("low").alias("confidence"),
    )


def argument_identity(x: str, y: str) -> Column:
    """Score of two argument structures with columns premises_, position_, evidence_, target_ + x and + y."""
    c = lambda n, s: F.col(f"{n}_{s}")
    sets = lambda n: T.jaccard(F.array_distinct(c(n, x)), F.array_distinct(c(n, y)))
    a, b = c("target", x), c("target", y)
    target = F.when((a != "") & (b != "") & T.either_contains(a, b), 1.0).otherwise(0.0)
    return 0.5 * sets("premises") + 0.25 * F.when(c("position", x).eqNullSafe(c("position", y)), 1.0).otherwise(0.0) + 0.15 * sets("evidence") + 0.1 * target


def centres(vectors: DataFrame, by: list[str]) -> DataFrame:
    """(by.., c): mean vector of each group, of length one. Sums by dimension, so no group is gathered."""
    dims = vectors.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("m"))
    return dims.groupBy(*by).agg(T.unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("c"))


def to_centre(vectors: DataFrame, by: list[str]) -> DataFrame:
    return vectors.join(centres(vectors, by), by).select(*by, "id", T.dot(F.col("v"), F.col("c")).alias("sim"))


def timeline(comments: DataFrame, at: str) -> DataFrame:
    """(hour, n, is_burst): counts of each hour from first to last, also empty ones; a burst lies over three deviations above the mean."""
    n = comments.where(F.col(at).isNotNull()).groupBy(F.date_trunc("hour", at).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    ends = n.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo IS NOT NULL")
    every = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("h"))
    filled = every.join(n, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))
    stats = filled.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count(F.lit(1)).alias("k"))
    z = (F.col("n") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    burst = F.when(F.col("k") < 3, False).otherwise(F.coalesce(z > 3, F.lit(False)))
    return filled.crossJoin(F.broadcast(stats)).select(F.date_format("h", "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour"), "n", burst.alias("is_burst"))  # stats is one row


def agreement(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """Homogeneity, completeness, V measure, normalised mutual information and adjusted Rand index, from the contingency table."""
    n = pairs.groupBy(truth, pred).agg(F.count(F.lit(1)).cast("double").alias("c"))
    a, b = n.groupBy(truth).agg(F.sum("c").alias("ca")), n.groupBy(pred).agg(F.sum("c").alias("cb"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    z = n.agg(F.sum("c").alias("z"), two("c").alias("s"))
    h = lambda c: -F.sum(F.col(c) / F.col("z") * F.log(F.col(c) / F.col("z")))
    ta = a.crossJoin(F.broadcast(z)).agg(h("ca").alias("ht"), two("ca").alias("sa"))  # one row each
    tb = b.crossJoin(F.broadcast(z)).agg(h("cb").alias("hp"), two("cb").alias("sb"))
    ab = n.join(a, truth).join(b, pred).crossJoin(F.broadcast(z)).agg((-F.sum(F.col("c") / F.col("z") * F.log(F.col("c") / F.col("cb")))).alias("htp"), (-F.sum(F.col("c") / F.col("z") * F.log(F.col("c") / F.col("ca")))).alias("hpt"))
    one = z.crossJoin(ta).crossJoin(tb).crossJoin(ab)
    hom, com = 1 - F.try_divide("htp", "ht"), 1 - F.try_divide("hpt", "hp")
    chance = F.col("sa") * F.col("sb") / (F.col("z") * (F.col("z") - 1) / 2)
    r = lambda c, name: F.round(c, 6).alias(name)
    return one.select(r(hom, "homogeneity"), r(com, "completeness"), r(2 * hom * com / (hom + com), "v_measure"), r((F.col("ht") - F.col("htp")) / ((F.col("ht") + F.col("hp")) / 2), "nmi"), r((F.col("s") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance), "ari"))


def verdict(score: Column) -> Column:
    return F.when(score >= CAMPAIGN, "campaign").when(score >= UNCERTAIN, "uncertain").otherwise("organic")


HASHES, PRIME = 126, 2147483647


def minhash(sets: DataFrame, id_col: str, set_col: str, hashes: int = HASHES) -> DataFrame:
    """(id, sig): least hashes of each set under `hashes` random linear functions; empty sets are left out."""
    rng = np.random.default_rng(42)
    a, b = rng.integers(1, PRIME, hashes).astype(np.uint64), rng.integers(0, PRIME, hashes).astype(np.uint64)

    def run(frames):
        for pdf in frames:
            sig = []
            for x in pdf["h"]:
                h = np.asarray(x, dtype=np.int64).astype(np.uint64) % np.uint64(1 << 31)
                sig.append(((h[:, None] * a + b) % np.uint64(PRIME)).min(axis=0).astype(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "sig": sig})

    kind = sets.select(id_col).dtypes[0][1]
    hashed = sets.where(F.size(set_col) > 0).select(F.col(id_col).alias("id"), F.transform(set_col, lambda g: F.xxhash64(g)).alias("h"))
    return hashed.mapInPandas(run, f"id {kind}, sig array<long>")


def bands(signatures: DataFrame, id_col: str, n_bands: int, rows: int) -> DataFrame:
    """(id, band): hash of each band of a signature."""
    each = F.array(*[F.xxhash64(F.lit(k), F.slice("sig", k * rows + 1, rows)) for k in range(n_bands)])
    return signatures.select(F.col(id_col).alias("id"), F.explode(each).alias("band"))


def principal(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(id, pc): the first k principal components, in place of a neighbour embedding. Moments are summed where the rows lie."""

    def moments(frames):
        total = None
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf[vec_col].to_numpy())
                m = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "m": total})

    sums = [r.m for r in vectors.select(vec_col).mapInPandas(moments, "i int, m double").groupBy("i").agg(F.sum("m").alias("m")).orderBy("i").collect()]  # 1 + d + d * d numbers
    if not sums:
        return vectors.select(id_col, F.lit(None).cast("array<double>").alias("pc")).where("1 = 0")
    d = int((-1 + (1 + 4 * (len(sums) - 1)) ** 0.5) / 2)
    n, mean = sums[0], np.array(sums[1 : d + 1]) / sums[0]
    cov = np.array(sums[d + 1 :]).reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({id_col: pdf[id_col], "pc": list((np.stack(pdf[vec_col].to_numpy()) - mean) @ axes)})

    kind = vectors.select(id_col).dtypes[0][1]
    return vectors.select(id_col, vec_col).mapInPandas(run, f"{id_col} {kind}, pc array<double>")
