"""The temporal scan statistic of a cluster against its docket."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.operators.joins import ranks_in

#: The longest window, as a share of the docket's span.
LONGEST = 0.5
#: Windows worked on at a time.
WINDOWS = 1_000_000


def scan(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, docket_n: int, longest: float) -> tuple[float, int, int]:
    """(likelihood ratio, first, last) of the window from one of the sorted times to another that stands out most.

    lo and hi are the counts of the docket's times before, and up to, each time. A window holds n of
    N times where mu would be expected; it counts if n > mu, n < N, and mu lies between 0 and N.
    """
    n_all = len(t)
    best = (0.0, 0, 0)
    last = np.searchsorted(t, t + longest, side="right") - 1
    step = max(1, WINDOWS // max(1, n_all))
    for a in range(0, n_all, step):
        i = np.arange(a, min(a + step, n_all))[:, None]
        j = np.arange(a, last[i[-1, 0]] + 1)[None, :]
        n = (j - i + 1).astype(float)
        mu = n_all * (hi[j] - lo[i]) / docket_n
        ok = (j >= i) & (j <= last[i]) & (n > mu) & (n < n_all) & (mu > 0) & (mu < n_all)
        at = np.flatnonzero(ok)  # by first, then by last: of equal windows the first counts
        if len(at):
            n, mu = n.ravel()[at], mu.ravel()[at]
            lam = n * np.log(n / mu) + (n_all - n) * np.log((n_all - n) / (n_all - mu))
            k = int(np.argmax(lam))
            if lam[k] > best[0]:
                best = (float(lam[k]), a + int(at[k]) // ok.shape[1], a + int(at[k]) % ok.shape[1])
    return best


def cluster_scan(events: DataFrame, least: int = 3) -> DataFrame:
    """events: run_id, cluster, us (microseconds). One row a cluster (noise left out) of `least` times or more.

    Docket ranks come from windows over all of a run's events; only a cluster's own times go to its task.
    """
    ranked = ranks_in(events, "run_id", "us")
    span = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("m"), (F.max("us") - F.min("us")).alias("span"))
    rows = ranked.where("cluster <> -1").join(span, "run_id").select("run_id", "cluster", "us", "lo", "hi", "m", "span")

    groups = rows.groupBy("run_id", "cluster").agg(F.first("m").alias("m"), F.first("span").alias("span"), F.array_sort(F.collect_list(F.struct("us", "lo", "hi"))).alias("e")).where(F.size("e") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, e = b.column("e").offsets.to_numpy(), b.column("e").values
            us, lo, hi = (e.field(k).to_numpy() for k in range(3))
            out = []
            for k, (m, span) in enumerate(zip(b.column("m").to_pylist(), b.column("span").to_pylist())):
                part = slice(ends[k], ends[k + 1])
                t, n = us[part], int(ends[k + 1] - ends[k])
                lam, i, j = scan(t, lo[part], hi[part], m, LONGEST * span)
                out.append((n, lam, int(t[i]), int(t[j]), j - i + 1 if lam > 0 else 0, 1 - math.exp(-lam / n), 0.5 * math.erfc(math.sqrt(lam))))
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("run_id"), b.column("cluster"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["run_id", "cluster", "n", "lambda_star", "start_us", "end_us", "peak_count", "tcs", "p"])

    return groups.mapInArrow(run, "run_id long, cluster int, n long, lambda_star double, start_us long, end_us long, peak_count long, tcs double, p double")


def count_windows(events: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, cluster, n_windows, n_dense): windows between a cluster's times, and those with more than expected."""
    ranked = ranks_in(events, "run_id", "us")
    span = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("m"), (F.max("us") - F.min("us")).alias("span"))
    rows = ranked.where("cluster <> -1").join(span, "run_id").select("run_id", "cluster", "us", "lo", "hi", "m", "span")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us", kind="stable")
        n, m = len(pdf), int(pdf["m"].iloc[0])
        t, lo, hi = pdf["us"].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        last = np.searchsorted(t, t + LONGEST * int(pdf["span"].iloc[0]), side="right") - 1
        windows = dense = 0
        for i in range(n):
            j = np.arange(i, last[i] + 1)
            k, mu = (j - i + 1).astype(float), n * (hi[j] - lo[i]) / m
            windows += len(j)
            ok = (k > mu) & (k < n) & (mu > 0) & (mu < n)
            with np.errstate(all="ignore"):
                dense += int((np.where(ok, k * np.log(k / mu) + (n - k) * np.log((n - k) / (n - mu)), 0) > 0).sum())
        out = pd.DataFrame({"run_id": [pdf["run_id"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "n_windows": [windows], "n_dense": [dense]})
        return out if n >= least else out.iloc[:0]

    return rows.groupBy("run_id", "cluster").applyInPandas(run, "run_id long, cluster int, n_windows long, n_dense long")
