"""Coordination graph: edges, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster.functions.fixed import EDGE_LIMIT, METADATA, TEMPLATE, TIMING, TOGETHER_S
from muster.operators.joins import band_pairs, similar_sets
from muster.plans.lineage import cut


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, group_id): connected components by alternating large-star and small-star steps; group_id is the least id.

    Each step is one grouping by vertex with partial aggregation of its least neighbour.
    """
    e = edges.where(f"{src} <> {dst}").select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = cut(e, "stars")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct(), "stars")
        sign = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(sign) == last:
            break
        last = tuple(sign)
    return e.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def near_groups(sets: DataFrame, id_col: str, set_col: str, threshold: float) -> DataFrame:
    """(id, group_id) of sets similar to another by at least threshold, directly or through others; group_id is the least id.

    Sets of the same elements (known by 64-bit hashes) form a class, shown by its least id; classes are
    joined by similar_sets and copies follow their class. An empty set is like an empty one only.
    """
    hashed = F.array_sort(F.transform(set_col, lambda x: F.xxhash64(x)))
    held = cut(sets.select(F.col(id_col).alias("id"), hashed.alias("s")).withColumn("k", F.md5(F.array_join("s", " "))), "sets")
    classes = cut(held.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("r", F.monotonically_increasing_id()), "classes")  # numbers are shorter than ids
    reps = held.join(classes.select(F.col("first").alias("id"), "r"), "id").select("r", "s")
    joined = components(similar_sets(reps, "r", "s", threshold), "id_a", "id_b").select(F.col("id").alias("r"), F.col("group_id").alias("g"))
    joined = classes.join(joined, "r", "left").where("n > 1 OR g IS NOT NULL").select("k", "first", F.coalesce("g", "r").alias("g"))
    least = joined.groupBy("g").agg(F.min("first").alias("group_id"))
    named = joined.join(least, "g").select("k", "group_id")
    return held.select("id", "k").join(named, "k").select("id", "group_id")


def timing_edges(comments: DataFrame) -> DataFrame:
    at = comments.where("posted_date IS NOT NULL").select("id", F.unix_micros(F.col("posted_date").cast("timestamp")).alias("us"))
    return band_pairs(at, "id", "us", TOGETHER_S).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.lit(TIMING).alias("weight"), F.lit("timing").alias("kind"))


def group_edges(members: DataFrame, key: str, largest: int | None = None) -> DataFrame:
    """(src, dst, g): pairs within groups of two or more; groups over `largest` are hubs and give none."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("g")).where("g >= 2" + (f" AND g <= {largest}" if largest else ""))
    m = members.join(sizes, key)
    a, b = m.select(key, F.col("id").alias("src"), "g"), m.select(key, F.col("id").alias("dst"))
    return a.join(b, key).where("src < dst").select("src", "dst", "g")


def metadata_edges(comments: DataFrame) -> DataFrame:
    """Pairs sharing an organisation, or the first three letters of the first name and the state; groups of 2 to 50."""
    org = comments.select("id", F.concat(F.lit("o|"), F.lower(F.trim("organization"))).alias("key")).where("trim(organization) <> ''")
    who = comments.where("trim(submitter_first) <> '' AND trim(state_prov) <> ''").select("id", F.concat(F.lit("n|"), F.lower(F.substring(F.trim("submitter_first"), 1, 3)), F.lit("|"), F.upper(F.trim("state_prov"))).alias("key"))
    e = group_edges(org.unionByName(who), "key", 50)
    return e.select("src", "dst", (F.lit(METADATA) / (F.col("g") - 1)).alias("weight"), F.lit("metadata").alias("kind"))


def template_edges(groups: DataFrame) -> DataFrame:
    """groups: (id, group_id) of duplicates, group_id the least id. An edge from that to each of the others.

    A group of n stands for n (n - 1) / 2 links of this weight; its star keeps it together without
    making them, so a group of copies costs its size.
    """
    return groups.where("id <> group_id").select(F.col("group_id").alias("src"), F.col("id").alias("dst"), F.lit(TEMPLATE).alias("weight"), F.lit("template").alias("kind"))


def combine_edges(*lists: DataFrame) -> DataFrame:
    """(src, dst, weight, kinds): weights added up for each pair, only those over the limit."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).where(F.col("weight") > EDGE_LIMIT)


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 10) -> DataFrame:
    """(id, community): modularity communities, named by their least member.

    Each round every vertex looks at the communities of its neighbours (one join and two groupings)
    and moves to the one of largest gain, chance deciding which half of the vertices moves, so that
    neighbours don't change places; total weights are of the whole graph. A substitution for the
    usual sequential method, with the same objective.
    """
    both = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight")), "graph")
    two_m = both.agg(F.sum("weight")).first()[0] or 1.0
    degree = cut(both.groupBy("u").agg(F.sum("weight").alias("k")), "degree")
    label = degree.select("u", F.col("u").alias("c"))
    for r in range(rounds):
        total = label.join(degree, "u").groupBy("c").agg(F.sum("k").alias("tot"))
        to = both.join(label.select(F.col("u").alias("v"), "c"), "v").where("u <> v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
        own = label.select("u", F.col("c").alias("mine")).join(degree, "u")
        gain = to.join(own, "u").join(total, "c").withColumn("gain", F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / two_m)
        best = gain.groupBy("u").agg(F.max_by("c", F.struct("gain", F.xxhash64("c"))).alias("best"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("stay"))
        moves = best.where((F.col("gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12) & (F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0))
        moved = cut(label.join(moves.select("u", "best"), "u", "left").select("u", F.coalesce("best", "c").alias("c")), "labels")
        label = moved
    names = label.groupBy("c").agg(F.min("u").alias("community"))
    return label.join(names, "c").select(F.col("u").alias("id"), "community")


def community_stats(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, n, weight, density) of communities of three or more."""
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    a, b = (member.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("weight").alias("weight"))
    return size.join(inside, "community", "left").select("community", "n", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"), F.round(2 * F.coalesce("weight", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)), 6).alias("density"))
