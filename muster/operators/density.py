"""Density clustering of vectors within a run: core distances, mutual reachability, a minimum spanning forest and its leaf clusters.

Neighbours are looked for among vectors that share a bucket of random hyperplanes in any of several
tables; buckets over a limit are cut by more planes. A substitution for the usual exact
neighbour search: distances found are exact, a neighbour may be missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from muster.operators.graph import components
from muster.plans.lineage import cut

TABLES, PLANES, LIMIT = 6, 3, 600


def neighbours(vectors: DataFrame, k: int, tables: int = TABLES, planes: int = PLANES, limit: int = LIMIT) -> DataFrame:
    """vectors: run_id, id, v (length one). (run_id, id, other, d): the k nearest found for each, cosine distance."""
    rng = np.random.default_rng(42)
    first = vectors.select(F.size("v").alias("d")).first()
    dim = first.d if first else 1
    sides = rng.normal(size=(tables, 16, dim))

    def hashed(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            for t in range(tables):
                bits = (x @ sides[t].T > 0).astype(np.int64)
                yield pd.DataFrame({"run_id": pdf["run_id"], "id": pdf["id"], "v": pdf["v"], "t": t, "bits": list(bits.astype(np.int32))})

    h = cut(vectors.select("run_id", "id", "v").mapInPandas(hashed, "run_id long, id string, v array<double>, t int, bits array<int>"), "planes")
    key = lambda n: F.concat_ws("", F.slice("bits", 1, n))
    pending, parts, n = h.withColumn("key", key(planes)), [], planes
    while True:
        sizes = pending.groupBy("run_id", "t", "key").agg(F.count(F.lit(1)).alias("c"))
        done = pending.join(sizes, ["run_id", "t", "key"])
        parts.append(done.where(f"c <= {limit}" if n < 16 else "true").select("run_id", "t", "key", "id", "v"))
        if n >= 16:
            break
        n = min(16, n + 2)
        pending = cut(done.where(f"c > {limit}").drop("c", "key").withColumn("key", key(n)), "planes")
        if pending.isEmpty():
            break
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        ids, run = pdf["id"].to_numpy(), pdf["run_id"].iloc[0]
        out = []
        for a in range(0, len(x), 512):
            d = 1 - x[a : a + 512] @ x.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            m = min(k, len(x) - 1)
            if m:
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                out.append(pd.DataFrame({"run_id": run, "id": np.repeat(ids[a : a + len(d)], m), "other": ids[at.ravel()], "d": np.take_along_axis(d, at, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"run_id": pd.Series(dtype="int64"), "id": pd.Series(dtype=str), "other": pd.Series(dtype=str), "d": pd.Series(dtype=float)})

    found = every.groupBy("run_id", "t", "key").applyInPandas(near, "run_id long, id string, other string, d double")
    best = found.groupBy("run_id", "id", "other").agg(F.greatest(F.lit(0.0), F.min("d")).alias("d"))
    r = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("d", "other"))
    return best.withColumn("r", r).where(F.col("r") <= k)


def core_distances(near: DataFrame, k: int) -> DataFrame:
    """(run_id, id, core): distance of the k-th neighbour, of the last found where there are fewer."""
    return near.where(F.col("r") <= k).groupBy("run_id", "id").agg(F.max("d").alias("core"))


def mutual_reachability(near: DataFrame, core: DataFrame) -> DataFrame:
    """(run_id, a, b, w), a < b: the greatest of the distance and both core distances."""
    e = near.select("run_id", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d").distinct()
    ca, cb = core.select("run_id", F.col("id").alias("a"), F.col("core").alias("ca")), core.select("run_id", F.col("id").alias("b"), F.col("core").alias("cb"))
    return e.join(ca, ["run_id", "a"]).join(cb, ["run_id", "b"]).groupBy("run_id", "a", "b").agg(F.min(F.greatest("d", "ca", "cb")).alias("w"))


def spanning_forest(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(run_id, a, b, w) of a minimum spanning forest, by Boruvka's rounds: each component takes its lightest edge out."""
    edges = cut(edges.select("run_id", "a", "b", "w"), "mst")
    tree, label = None, None
    live = edges.withColumn("la", F.col("a")).withColumn("lb", F.col("b"))
    for _ in range(rounds):
        out = live.select("run_id", F.col("la").alias("c"), "a", "b", "w").unionByName(live.select("run_id", F.col("lb").alias("c"), "a", "b", "w"))
        pick = out.groupBy("c").agg(F.min(F.struct("w", "a", "b", "run_id")).alias("m")).select("m.run_id", "m.a", "m.b", "m.w").distinct()
        pick = cut(pick, "mst")
        if pick.isEmpty():
            break
        tree = pick if tree is None else cut(tree.unionByName(pick).distinct(), "mst")
        label = cut(components(tree, "a", "b"), "mst")
        la, lb = label.select(F.col("id").alias("a"), F.col("group_id").alias("la")), label.select(F.col("id").alias("b"), F.col("group_id").alias("lb"))
        live = cut(edges.join(la, "a", "left").join(lb, "b", "left").withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b")).where("la <> lb"), "mst")
    return tree if tree is not None else edges


def leaves(tree: pd.DataFrame, least: int) -> dict[str, int]:
    """Leaf clusters of the condensed tree of one run's spanning forest: id -> cluster.

    Edges are joined from the lightest on; where two parts of `least` or more meet, both stand as
    clusters of their own, and what joins later is noise to them.
    """
    parent: dict[str, str] = {}
    members: dict[str, list[str]] = {}
    cluster: dict[str, list[int]] = {}
    made: list[list[str]] = []

    def find(x: str) -> str:
        parent.setdefault(x, x)
        members.setdefault(x, [x])
        cluster.setdefault(x, [])
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in tree.sort_values(["w", "a", "b"])[["a", "b"]].itertuples(index=False):
        x, y = find(a), find(b)
        if x == y:
            continue
        if len(members[x]) < len(members[y]):
            x, y = y, x
        both = len(members[x]) >= least and len(members[y]) >= least
        if both:
            for z in (x, y):
                if not cluster[z]:
                    cluster[z] = [len(made)]
                    made.append(list(members[z]))
        parent[y] = x
        members[x] += members.pop(y)
        cluster[x] += cluster.pop(y)
    for r in list(members):
        if not cluster[r] and len(members[r]) >= least:
            made.append(list(members[r]))
    return {i: k for k, ids in enumerate(made) for i in ids}


def density_clusters(vectors: DataFrame, least: int | None = None, k: int = 5) -> DataFrame:
    """(run_id, id, cluster), -1 for noise. The forest of one run (its number of vectors less one edges) is condensed in one task.

    least: cluster size; by default max(5, floor(sqrt(n) / 3)) for a run of n. Runs under 30 are all noise.
    """
    near = cut(neighbours(vectors, max(k, 10)), "near")
    core = core_distances(near, k)
    tree = spanning_forest(mutual_reachability(near, core))
    n = vectors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["n"].iloc[0])
        got = leaves(pdf, least or max(5, int(size**0.5 / 3))) if size >= 30 else {}
        return pd.DataFrame({"run_id": int(pdf["run_id"].iloc[0]), "id": list(got), "cluster": list(got.values())}).astype({"run_id": "int64", "id": "object", "cluster": "int32"})

    found = tree.join(n, "run_id").groupBy("run_id").applyInPandas(run, "run_id long, id string, cluster int")
    return vectors.select("run_id", "id").join(found, ["run_id", "id"], "left").select("run_id", "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def soft_membership(vectors: DataFrame, centres: DataFrame, sharpness: float = 10.0) -> DataFrame:
    """(run_id, id, cluster, p): softmax of cosine with each cluster's centre of the run."""
    from muster.functions.text import dot

    s = vectors.join(centres, "run_id").select("run_id", "id", "cluster", F.exp(sharpness * dot(F.col("v"), F.col("c"))).alias("e"))
    return s.select("run_id", "id", "cluster", (F.col("e") / F.sum("e").over(Window.partitionBy("run_id", "id"))).alias("p"))


def reclaim(labels: DataFrame, soft: DataFrame, threshold: float = 0.5) -> DataFrame:
    """labels: run_id, id, cluster. Noise goes to its likeliest cluster if that is likelier than the threshold."""
    best = soft.groupBy("run_id", "id").agg(F.max("p").alias("p"), F.max_by("cluster", F.struct("p", -F.col("cluster"))).alias("best"))
    take = (F.col("cluster") == -1) & (F.col("p") > threshold)
    return labels.join(best, ["run_id", "id"], "left").select("run_id", "id", F.when(take, F.col("best")).otherwise(F.col("cluster")).alias("cluster"))


def silhouette(vectors: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(run_id, validity): mean simplified silhouette by centres, in place of a density-based validity."""
    from muster.functions.text import dot

    d = vectors.join(labels.where("cluster <> -1"), ["run_id", "id"]).join(centres.withColumnRenamed("cluster", "other"), "run_id")
    d = d.select("run_id", "id", "cluster", "other", (1 - dot(F.col("v"), F.col("c"))).alias("d"))
    one = d.groupBy("run_id", "id").agg(F.min(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("other"), F.col("d"))).alias("b"))
    return one.where("b IS NOT NULL").groupBy("run_id").agg(F.avg(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("validity"))
