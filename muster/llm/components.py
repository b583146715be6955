"""Problem 2: one group identifier over all records linked directly or through others.

Vertices are hashed into blocks and every edge goes to the cell (block of one end, block of
the other). Each cell runs a local union-find and keeps one edge per vertex, to the
representative of its local tree. Then the representatives are exchanged along rows and
columns: a vertex takes the least of those its row and column found as parent, its others are
joined to that parent by new edges, and if it represents no one itself it leaves the graph.
Rounds repeat until no edge is left. Representatives are chosen by a hash that changes with
the round, so a chain loses a third of its vertices in a round however its ids are sorted,
and a hub's edges spread over a whole row of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

import xxhash

from muster.plans.lineage import cut, cut_counted, settled

#: Edges aimed at per cell, as a multiple of the root of their number, so that cells grow in size and in number: 1,600 edges
#: make one cell, a million 25 of 40,000, ten thousand millions 2,500 of four millions.
EDGES_PER_ROOT = 40
#: Vertices a worker holds; a cell with more is worked on in parts, each with a union-find of its own.
HELD = 400_000


def _forest(seed: int, held: int = HELD):
    """Local union-find over the edges of a cell: (vertex, representative), and (representative, null) for those that stand for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        rank: dict = {}

        def find(x):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        def order(x):
            if x not in rank:
                rank[x] = (xxhash.xxh64_intdigest(str(x), seed), x)
            return rank[x]

        def found(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            links = [(x, r) for x in list(parent) if (r := find(x)) != x]
            links += [(r, None) for r in {r for _, r in links}]
            for k in range(0, len(links), 50_000):
                part = links[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], ["v", "root"])
            parent.clear()
            rank.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a == b:
                    continue
                if order(a) < order(b):
                    parent[b] = a
                else:
                    parent[a] = b
            if len(parent) > held:
                yield from found(kind)
        if parent:
            yield from found(kind)

    return run


@settled
def connected_components(edges: DataFrame, src: str, dst: str, edges_per_root: int = EDGES_PER_ROOT, held: int = HELD) -> DataFrame:
    """(id, group_id) for each end of an edge between two different vertices; group_id is the least id of the group.

    Nulls: an edge with a null end links nothing. Repeated and turned edges count once, and an
    edge from a vertex to itself links nothing. An empty input gives an empty result. Columns
    other than the two ends are ignored. Works for strings (by code point) and for integers.
    """
    a, b = F.col(src), F.col(dst)
    kind = edges.select(src).dtypes[0][1]
    active = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    active, n = cut_counted(active, "edges")
    parents: list[DataFrame] = []
    while n:
        blocks = ceil((n**0.5 / edges_per_root) ** 0.5)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        cells = active.repartitionById(blocks * blocks, block(F.col("a")) * blocks + block(F.col("b")))
        stars = cells.mapInArrow(_forest(len(parents), held), f"v {kind}, root {kind}")
        # What the cells of its row and column found for a vertex; it has at most one representative a cell (or part of one).
        met = stars.groupBy("v").agg(F.min("root").alias("parent"), F.max(F.col("root").isNull()).alias("stands"), F.collect_set("root").alias("roots"))
        met = cut(met.where("parent IS NOT NULL"), "stars")
        parents.append(met.where("NOT stands").select("v", "parent"))
        kept = met.where("stands").select(F.col("v").alias("a"), F.col("parent").alias("b"))
        others = met.where(F.size("roots") > 1).select(F.col("parent").alias("a"), F.explode("roots").alias("b")).where("a <> b")
        active, n = cut_counted(kept.unionByName(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not parents:
        return edges.select(F.col(src).alias("id"), F.col(src).alias("group_id")).where(F.lit(False))
    # A parent is a vertex that stayed in the graph, so it may have a parent of a later round.
    labels = parents[-1]
    for p in reversed(parents[:-1]):
        later = labels.select(F.col("v").alias("parent"), F.col("parent").alias("top"))
        labels = cut(labels.unionByName(p.join(later, "parent", "left").select("v", F.coalesce("top", "parent").alias("parent"))), "labels")
    # Representatives were chosen by hash: each group is named by its least id.
    names = labels.groupBy("parent").agg(F.least(F.min("v"), F.first("parent")).alias("least"))
    members = labels.unionByName(names.select(F.col("parent").alias("v"), "parent"))
    return members.join(names, "parent").select(F.col("v").alias("id"), F.col("least").alias("group_id"))


def match_groups(matches: DataFrame, src: str = "left_id", dst: str = "right_id") -> DataFrame:
    """Groups over raw pairs of typed ids: ids compare trimmed and in upper case and come out so; blank ends are missing."""
    clean = lambda c: F.nullif(F.upper(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")), F.lit(""))
    return connected_components(matches.select(clean(src).alias("a"), clean(dst).alias("b")), "a", "b")
