"""Density clustering (ML7 to ML11) and the synthetic corpus (SY)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster.operators import clusters as C
from muster.operators import density, synthetic
from muster.suite.base import Tables, query, view

BY = ["run_id", "cluster"]


@view
def vr(t: Tables) -> DataFrame:
    """Vectors of the members of the last runs, with the label given."""
    return t.ve.join(t.lab, "id").select("run_id", "id", "v", "cluster")


@query()
def ml7_density_clusters(t: Tables) -> DataFrame:
    return density.density_clusters(t.vr.select("run_id", "id", "v"))


@query()
def ml7b_core_distances(t: Tables) -> DataFrame:
    return density.core_distances(density.neighbours(t.vr.select("run_id", "id", "v"), 5), 5)


@query()
def ml7c_mutual_reachability(t: Tables) -> DataFrame:
    near = density.neighbours(t.vr.select("run_id", "id", "v"), 5)
    return density.mutual_reachability(near, density.core_distances(near, 5))


@query()
def ml8_tree_campaigns(t: Tables) -> DataFrame:
    """Clusters of 100 or more at the level below the root of a run's tree, numbered from 10000."""
    c = density.density_clusters(t.vr.select("run_id", "id", "v"), least=100)
    return c.where("cluster <> -1").select("run_id", "id", (F.col("cluster") + 10000).alias("cluster"))


@query()
def ml10_soft_membership(t: Tables) -> DataFrame:
    own = t.vr.where("cluster <> -1")
    return density.soft_membership(t.vr.select("run_id", "id", "v"), C.centres(own, BY))


@query()
def ml9b_reclaimed(t: Tables) -> DataFrame:
    own = t.vr.where("cluster <> -1")
    soft = density.soft_membership(t.vr.select("run_id", "id", "v"), C.centres(own, BY))
    return density.reclaim(t.vr.select("run_id", "id", "cluster"), soft)


@query()
def ml11_validity(t: Tables) -> DataFrame:
    own = t.vr.where("cluster <> -1")
    return density.silhouette(t.vr.select("run_id", "id", "v"), own.select("run_id", "id", "cluster"), C.centres(own, BY))


@query()
def sy5_corpus(t: Tables) -> DataFrame:
    return synthetic.corpus(t.spark)


@query()
def sy7_ground_truth(t: Tables) -> DataFrame:
    return synthetic.ground_truth(synthetic.corpus(t.spark))
