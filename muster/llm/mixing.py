"""Problem 9: sources mixed to target weights, by entropy balancing.

Each document gets a rate, the number of copies of it expected. Among all rates that meet the
token target of every source and keep its mean document length, those closest in relative
entropy to taking each document once are exp(a + b * length), with two multipliers a source.
(Without the second constraint large sources would give their shortest documents only.) The
multipliers come from the convex dual by Newton's method: each step needs sums by source over
all documents, made where the documents lie; only one row a source comes back. Rates are kept
within the source's cap and rounded into copies, longest documents first, each carrying what it
misses on to the next, so that a source's tokens come out right; then the shares are counted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from muster.plans.lineage import cut, settled

ROUNDS = 30
#: Relative miss of a source's tokens at which Newton's steps end.
ENOUGH = 1e-6
#: Documents of a source rounded in one task, about.
PART_DOCS = 50_000
#: Sources of the target list at most; one row each comes to the driver.
MAX_SOURCES = 10_000


def wanted_tokens(goal: list[tuple[str, float, float]], total: float | None) -> dict[str, float]:
    """goal: (source, target share, most tokens it can give). Tokens wanted of each source.

    Without a total the largest mixture in which every source meets its share. With one, the shares
    nearest to the targets that reach it: sources that cannot meet their share give all they can, the others
    share what is left by their targets, until all are exhausted.
    """
    whole = sum(share for _, share, _ in goal)
    if total is None:
        total = min(most * whole / share for _, share, most in goal)
        return {s: total * share / whole for s, share, _ in goal}
    want: dict[str, float] = {}
    left, still = float(total), list(goal)
    while still:
        whole = sum(share for _, share, _ in still)
        short = [g for g in still if g[2] < left * g[1] / whole]
        for s, share, most in short or still:
            want[s] = most if short else left * share / whole
        if not short:
            break
        left -= sum(most for _, _, most in short)
        still = [g for g in still if g not in short]
    return want


def mixture_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, float]:
    """(id, source, n_tokens, rate, max_repeats) of the documents used, and the mixture's total tokens.

    total: tokens wanted, see wanted_tokens; shares of listed sources without documents are spread
    over the others. Raises if Newton's steps do not end.
    """
    spark = sizes.sparkSession
    goal = [r for r in targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect() if r.source is not None and r.target_share and r.target_share > 0 and r.max_repeats and r.max_repeats > 0]
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    listed = spark.createDataFrame([(r.source, int(r.max_repeats)) for r in goal], "source string, max_repeats int")
    docs = cut(sizes.where("n_tokens > 0").join(F.broadcast(listed), "source").select("id", "source", F.col("n_tokens").cast("double").alias("x"), "max_repeats"), "mixable")
    have = {r.source: (r.t, r.n) for r in docs.groupBy("source").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    goal = [r for r in goal if r.source in have]
    if not goal:
        return docs.select("id", "source", F.col("x").cast("long").alias("n_tokens"), F.lit(0.0).alias("rate"), "max_repeats"), 0.0
    want = wanted_tokens([(r.source, r.target_share, have[r.source][0] * r.max_repeats) for r in goal], total)
    mean = {s: t / n for s, (t, n) in have.items()}
    cap = {r.source: float(r.max_repeats) for r in goal}

    # The dual: for each source (a, b) with sum(r) and sum(r * z) both want / mean, for r = min(cap, exp(a + b * z)), z = x / mean.
    ab = {s: (math.log(want[s] / have[s][0]), 0.0) for s in want}

    def known() -> DataFrame:
        return F.broadcast(spark.createDataFrame([(s, *map(float, ab[s]), float(mean[s]), cap[s]) for s in ab], "source string, a double, b double, mean double, cap double"))

    z = F.col("x") / F.col("mean")
    tilt = F.exp(F.least(F.lit(50.0), F.col("a") + F.col("b") * z))
    rate = F.least(F.col("cap"), tilt)
    free = F.when(tilt < F.col("cap"), tilt).otherwise(0.0)
    for _ in range(ROUNDS):
        sums = docs.join(known(), "source").groupBy("source").agg(F.sum(rate).alias("r0"), F.sum(rate * z).alias("r1"), F.sum(free).alias("h0"), F.sum(free * z).alias("h1"), F.sum(free * z * z).alias("h2")).collect()
        worst = 0.0
        for x in sums:
            goal_n = want[x.source] / mean[x.source]
            miss = np.array([x.r0 - goal_n, x.r1 - goal_n])
            worst = max(worst, float(np.abs(miss).max()) / goal_n)
            bend = np.array([[x.h0, x.h1], [x.h1, x.h2]]) + 1e-9 * goal_n * np.eye(2)
            step = np.linalg.lstsq(bend, miss, rcond=1e-9)[0]
            step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
            ab[x.source] = tuple(np.array(ab[x.source]) - step)
        if worst <= ENOUGH:
            break
    else:
        raise RuntimeError(f"the dual of the mixture missed its tokens by a share of {worst:.2g} after {ROUNDS} steps")
    rated = docs.join(known(), "source").select("id", "source", F.col("x").cast("long").alias("n_tokens"), rate.alias("rate"), "max_repeats")
    return rated, sum(want.values())


@settled
def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(id, source, n_tokens, copies): documents of the mixture with their number of copies, 1 to the source's cap.

    sizes: id, source, n_tokens; targets: source, target_share, max_repeats. Documents of no listed
    source, null sources and empty documents are left out, as are targets that are null, not
    positive or without documents. total: tokens of the mixture (None: as many as keep every share
    exact), see wanted_tokens; mixture_shares reports what was reached. A part of a source (about PART_DOCS documents, by hash) misses
    its tokens by half its shortest document or so.
    """
    rated, _ = mixture_rates(sizes, targets, total)
    rated = cut(rated, "rated")
    kind = rated.select("id").dtypes[0][1]
    parts = rated.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / PART_DOCS).cast("int").alias("parts"))
    parted = rated.join(F.broadcast(parts), "source").withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int"))

    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        carried, out = 0.0, []
        for n, r, most in zip(pdf["n_tokens"].tolist(), pdf["rate"].tolist(), pdf["max_repeats"].tolist()):
            carried += r * n
            c = min(most, max(0, math.floor(carried / n + 0.5)))
            carried -= c * n
            out.append(c)
        pdf = pdf.assign(copies=np.array(out, dtype="int32"))
        return pdf.loc[pdf["copies"] > 0, ["id", "source", "n_tokens", "copies"]]

    return parted.select("id", "source", "n_tokens", "rate", "max_repeats", "part").groupBy("source", "part").applyInPandas(copies, f"id {kind}, source string, n_tokens long, copies int")


def mixture_shares(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, target_share, n_documents, n_copies, tokens, share, most_repeats) of every listed source, 0 where it gives nothing."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_repeats"))
    full = targets.select("source", "target_share").join(got, "source", "left")
    every = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a listed source
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select("source", "target_share", zero("n_documents"), zero("n_copies"), zero("tokens"), F.coalesce(F.round(F.try_divide(F.coalesce("tokens", F.lit(0)), every), 6), F.lit(0.0)).alias("share"), zero("most_repeats"))
