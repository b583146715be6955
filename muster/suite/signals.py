"""Group signals against their docket's baseline (AG), learned ones (ML) and scores (SC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from muster.functions import text as T
from muster.functions.fixed import CAMPAIGN, WEIGHTS
from muster.operators import clusters as C
from muster.operators import graph
from muster.operators.scan import cluster_scan, count_windows
from muster.suite.base import Tables, nested, query, view
from muster.suite.relational import KEY, META, RESOLVED, fuzzy_resolved, registry, resolved
from muster.suite import style as style_suite
from muster.suite.text import ARGS, SHINGLES, VEC

BY = ["run_id", "cluster"]
#: Least Jaccard index of near-duplicates.
SIMILAR = 0.8
DUP = f"{SHINGLES}, hs AS (SELECT id, md5(array_to_string(list_sort(g), ' ')) AS k, g FROM sh), kl AS (SELECT k, min(id) AS f, any_value(g) AS g FROM hs GROUP BY 1), ex AS (SELECT f, unnest(g) AS s, len(g) AS n FROM kl), sm AS (SELECT a.f AS a, b.f AS b FROM ex a JOIN ex b ON a.s = b.s AND a.f <> b.f GROUP BY 1, 2 HAVING count(*) >= {SIMILAR} * (any_value(a.n) + any_value(b.n) - count(*))), rc(f, g) AS (SELECT f, f FROM kl UNION SELECT sm.b, rc.g FROM rc JOIN sm ON sm.a = rc.f WHERE rc.g < sm.b), gr AS (SELECT f, min(g) AS g FROM rc GROUP BY 1), gn AS (SELECT hs.id, gr.g, count(*) OVER (PARTITION BY gr.g) AS m FROM hs JOIN kl USING (k) JOIN gr USING (f)), dg AS (SELECT id, g FROM gn WHERE m >= 2)"


@view
def dg(t: Tables) -> DataFrame:
    """(id, g) of texts in a near-duplicate group: Jaccard index of their five-word shingles at least SIMILAR, directly or through others."""
    return graph.near_groups(t.tx.select("id", T.shingles(F.col("text")).alias("s")), "id", "s", SIMILAR).withColumnRenamed("group_id", "g")


@view
def size(t: Tables) -> DataFrame:
    return t.lab.where("cluster <> -1").groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))


SIZE = "size AS (SELECT run_id, cluster, count(*) AS n FROM lab WHERE cluster <> -1 GROUP BY 1, 2)"


@query(f"RECURSIVE, {DUP}, {SIZE}, o AS (SELECT run_id, cluster, g, count(*) AS c FROM lab JOIN dg USING (id) WHERE cluster <> -1 GROUP BY 1, 2, 3) SELECT size.run_id, size.cluster, any_value(n) AS n_members, coalesce(sum(c), 0)::BIGINT AS n_duplicates, round(coalesce(sum(c), 0) / any_value(n), 6) AS dup_fraction, coalesce(max(c), 0) AS largest FROM size LEFT JOIN o USING (run_id, cluster) GROUP BY 1, 2")
def ag1_duplicates(t: Tables) -> DataFrame:
    return duplicate_stats(t, t.dg)


def duplicate_stats(t: Tables, groups: DataFrame) -> DataFrame:
    o = t.lab.where("cluster <> -1").join(groups, "id").groupBy(*BY, "g").agg(F.count(F.lit(1)).alias("c")).groupBy(*BY).agg(F.sum("c").alias("s"), F.max("c").alias("m"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.size.join(o, BY, "left").select(*BY, F.col("n").alias("n_members"), zero("s").alias("n_duplicates"), F.round(zero("s") / F.col("n"), 6).alias("dup_fraction"), zero("m").alias("largest"))


CHAIN = f"ch AS (SELECT run_id, cluster, sum(c)::BIGINT AS n, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS n_exact, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END)::BIGINT AS n_unique, max(c) AS largest FROM (SELECT run_id, cluster, {KEY} AS k, count(*) AS c FROM tc WHERE cluster <> -1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(c) >= 3)"


@view
def chain(t: Tables) -> DataFrame:
    c = t.tc.where("cluster <> -1").groupBy(*BY, F.md5(T.exact_key(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*BY).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_exact"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n_unique"), F.max("c").alias("largest")).where("n >= 3")


@query(f", {CHAIN} SELECT * FROM ch")
def ag2_exact_chain(t: Tables) -> DataFrame:
    return t.chain


@query(f"RECURSIVE, {DUP} SELECT run_id, cluster, count(*) AS n_near, count(DISTINCT g) AS n_groups FROM lab JOIN dg USING (id) WHERE cluster <> -1 GROUP BY 1, 2")
def ag3_near_groups(t: Tables) -> DataFrame:
    return group_members(t, t.dg)


def group_members(t: Tables, groups: DataFrame) -> DataFrame:
    return t.lab.where("cluster <> -1").join(groups, "id").groupBy(*BY).agg(F.count(F.lit(1)).alias("n_near"), F.count_distinct("g").alias("n_groups"))


SAMPLE = f"{VEC}, v1 AS (SELECT * FROM (SELECT ve.id, v, run_id, cluster, row_number() OVER (PARTITION BY run_id, cluster ORDER BY md5(id)) AS k FROM ve JOIN lab USING (id) WHERE cluster <> -1) WHERE k <= 100), ps AS (SELECT a.run_id, a.cluster, avg(c) AS mean, median(c) AS med, min(c) AS least FROM (SELECT a.run_id, a.cluster, list_inner_product(a.v, b.v) AS c FROM v1 a JOIN v1 b ON a.run_id = b.run_id AND a.cluster = b.cluster AND a.id < b.id) a GROUP BY 1, 2)"


@view
def pair_similarity(t: Tables) -> DataFrame:
    """Mean, median and least cosine over the pairs of at most 100 members of a cluster (those of least hash)."""
    k = F.row_number().over(Window.partitionBy(*BY).orderBy(F.md5("id")))
    v = t.ve.join(t.lab.where("cluster <> -1"), "id").withColumn("k", k).where("k <= 100")
    a, b = v.select(*BY, F.col("id").alias("ia"), F.col("v").alias("va")), v.select(*BY, F.col("id").alias("ib"), F.col("v").alias("vb"))
    c = a.join(b, BY).where("ia < ib").select(*BY, T.dot(F.col("va"), F.col("vb")).alias("c"))
    return c.groupBy(*BY).agg(F.avg("c").alias("mean"), F.median("c").alias("med"), F.min("c").alias("least"))


@query(f", {SAMPLE} SELECT run_id, cluster, round(mean, 6) AS mean, round(med, 6) AS med, round(least, 6) AS least FROM ps")
def ag4_pair_similarity(t: Tables) -> DataFrame:
    return t.pair_similarity.select(*BY, *(F.round(c, 6).alias(c) for c in ("mean", "med", "least")))


@query(f", {CHAIN}, {SAMPLE} SELECT ch.run_id, ch.cluster, CASE WHEN n_exact / n > 0.5 THEN 'lazy_template' WHEN coalesce(mean, 0) > 0.85 AND n_exact / n < 0.1 THEN 'ai_paraphrased' WHEN coalesce(mean, 0) > 0.75 THEN 'near_duplicate' ELSE 'organic' END AS sophistication FROM ch LEFT JOIN ps USING (run_id, cluster)")
def ag5_sophistication(t: Tables) -> DataFrame:
    exact, mean = F.col("n_exact") / F.col("n"), F.coalesce("mean", F.lit(0.0))
    label = F.when(exact > 0.5, "lazy_template").when((mean > 0.85) & (exact < 0.1), "ai_paraphrased").when(mean > 0.75, "near_duplicate").otherwise("organic")
    return t.chain.join(t.pair_similarity, BY, "left").select(*BY, label.alias("sophistication"))


STATE = r"nullif(upper(regexp_replace(coalesce(state_prov, ''), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '')"
GEO = f"st AS (SELECT id, run_id, cluster, {STATE} AS state FROM cc), ds AS (SELECT run_id, state, count(*) AS c FROM st WHERE state IS NOT NULL GROUP BY 1, 2), dn AS (SELECT run_id, sum(c) AS total, -sum(c / t * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY run_id) AS t FROM ds) GROUP BY 1)"


@view
def st(t: Tables) -> DataFrame:
    return t.cc.select("id", "run_id", "cluster", T.normal_state(F.col("state_prov")).alias("state"))


@query(f", {GEO} SELECT run_id, state, c AS n FROM ds")
def ag6_docket_states(t: Tables) -> DataFrame:
    return t.st.where("state IS NOT NULL").groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f", {GEO}, cs AS (SELECT run_id, cluster, state, count(*) AS c, min(id) AS first FROM st WHERE cluster <> -1 AND state IS NOT NULL GROUP BY 1, 2, 3), cn AS (SELECT run_id, cluster, count(*) AS n, count(state) AS located FROM st WHERE cluster <> -1 GROUP BY 1, 2 HAVING count(*) >= 3), "
       "g AS (SELECT cs.run_id, cs.cluster, count(*) AS k, arg_max(cs.state, cs.c * 1000000 - rk) AS top, max(cs.c) AS tc, any_value(located) AS located, -sum(cs.c / located * log2(cs.c / located)) AS h, sum(cs.c / located * log2((cs.c / located) / (ds.c / total))) AS kl, any_value(dn.h) AS dh FROM (SELECT *, rank() OVER (PARTITION BY run_id, cluster ORDER BY first) AS rk FROM cs) cs JOIN cn USING (run_id, cluster) JOIN ds ON ds.run_id = cs.run_id AND ds.state = cs.state JOIN dn ON dn.run_id = cs.run_id GROUP BY 1, 2) "
       "SELECT cn.run_id, cn.cluster, cn.n, round(cn.located / cn.n, 3) AS completeness, CASE WHEN cn.located < 3 THEN 0 ELSE k END AS n_states, CASE WHEN cn.located >= 3 THEN top END AS top_state, CASE WHEN cn.located < 3 THEN 0.0 ELSE round(tc / cn.located, 3) END AS top_pct, CASE WHEN cn.located < 3 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1 - CASE WHEN dh > 0 THEN h / dh ELSE 1.0 END)), 4) END AS concentration, CASE WHEN cn.located >= 3 THEN round(kl, 4) END AS kl, CASE WHEN cn.located < 3 THEN 'low' WHEN cn.located / cn.n >= 0.7 THEN 'high' WHEN cn.located / cn.n >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM cn LEFT JOIN g USING (run_id, cluster)")  # fmt: skip
def ag7_geography(t: Tables) -> DataFrame:
    return C.geography(t.st).select(*BY, "n", "completeness", "n_states", "top_state", "top_pct", "concentration", "kl", "confidence")


@query(f", {RESOLVED}, m AS (SELECT cc.id, cc.run_id, cc.cluster, reg.name, reg.sector, reg.intensity FROM cc LEFT JOIN rs USING (organization) LEFT JOIN reg ON reg.pos = rs.pos WHERE cluster <> -1), e AS (SELECT run_id, cluster, name, count(*) AS c FROM m WHERE name IS NOT NULL GROUP BY 1, 2, 3) SELECT m.run_id, m.cluster, count(m.name) AS n_matched, round(count(m.name) / count(*), 3) AS match_rate, count(DISTINCT m.name) AS n_entities, round(sum(CASE WHEN intensity IN ('high', 'very_high') THEN 1 ELSE 0 END) / greatest(1, count(m.name)), 3) AS high_pct, (SELECT round(max(c) / sum(c), 4) FROM e WHERE e.run_id = m.run_id AND e.cluster = m.cluster) AS concentration FROM m GROUP BY 1, 2 HAVING count(*) >= 3")
def ag8_entities(t: Tables) -> DataFrame:
    """By the two exact stages of resolving; ag8_fuzzy has all three."""
    return entities(t, resolved(t))


@query()
def ag8_fuzzy(t: Tables) -> DataFrame:
    return entities(t, fuzzy_resolved(t))


def entities(t: Tables, found: DataFrame) -> DataFrame:
    e = found.join(F.broadcast(registry(t)), "pos").select("organization", "name", "intensity")
    m = t.cc.where("cluster <> -1").select(*BY, "organization").join(e, "organization", "left")
    c = m.groupBy(*BY, "name").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("intensity").isin("high", "very_high"), 1).otherwise(0)).alias("hi"))
    named = F.col("name").isNotNull()
    matched = F.sum(F.when(named, F.col("c")).otherwise(0))
    out = c.groupBy(*BY).agg(F.sum("c").alias("n"), matched.alias("n_matched"), F.count("name").alias("n_entities"), F.sum("hi").alias("hi"), F.max(F.when(named, F.col("c"))).alias("top")).where("n >= 3")
    return out.select(*BY, "n_matched", F.round(F.col("n_matched") / F.col("n"), 3).alias("match_rate"), "n_entities", F.round(F.col("hi") / F.greatest(F.lit(1), "n_matched"), 3).alias("high_pct"), F.round(F.try_divide("top", "n_matched"), 4).alias("concentration"))


EV = "ev AS (SELECT run_id, cluster, epoch_us(posted_date) AS us FROM cc WHERE posted_date IS NOT NULL)"
SCAN = f"{EV}, rk AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY us) - 1 AS lo, count(*) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, count(*) OVER (PARTITION BY run_id) AS m, (max(us) OVER (PARTITION BY run_id) - min(us) OVER (PARTITION BY run_id)) AS span FROM ev), nn AS (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY us) AS i, count(*) OVER (PARTITION BY run_id, cluster) AS n FROM rk WHERE cluster <> -1), w AS (SELECT a.run_id, a.cluster, a.n, a.us AS t0, b.us AS t1, (b.i - a.i + 1)::DOUBLE AS k, a.n * (b.hi - a.lo)::DOUBLE / a.m AS mu, a.i AS i, b.i AS j FROM nn a JOIN nn b ON a.run_id = b.run_id AND a.cluster = b.cluster AND b.i >= a.i AND b.us <= a.us + 0.5 * a.span WHERE a.n >= 3), l AS (SELECT *, CASE WHEN k > mu AND k < n AND mu > 0 AND mu < n THEN k * ln(k / mu) + (n - k) * ln((n - k) / (n - mu)) ELSE 0 END AS lam FROM w), sc AS (SELECT run_id, cluster, any_value(n) AS n, max(lam) AS lam FROM l GROUP BY 1, 2)"


@view
def scans(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("posted_date").cast("timestamp"))
    return cluster_scan(t.cc.where("posted_date IS NOT NULL").select("run_id", "cluster", us.alias("us")))


@query(f", {SCAN} SELECT run_id, cluster, n, round(lam, 6) AS lambda_star, round(1 - exp(-lam / n), 6) AS tcs FROM sc")
def ag10_scan(t: Tables) -> DataFrame:
    return t.scans.select(*BY, "n", F.round("lambda_star", 6).alias("lambda_star"), F.round("tcs", 6).alias("tcs"))


@query(f", {SCAN}, p AS (SELECT run_id, cluster, any_value(n) AS n, max(lam) AS lam, arg_max(struct_pack(t0 := t0, t1 := t1, k := k), round(lam, 9) * 1e9 - i * 1e-3 - j * 1e-7) AS b FROM l GROUP BY 1, 2) SELECT run_id, cluster, round(lam, 4) AS lambda_star, CASE WHEN lam > 0 THEN b.k::BIGINT ELSE 0 END AS peak_count FROM p WHERE n >= 10")
def ag11_temporal_table(t: Tables) -> DataFrame:
    return t.scans.where("n >= 10").select(*BY, F.round("lambda_star", 4).alias("lambda_star"), "peak_count")


ARG15 = f"{ARGS}, a15 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY id) AS k FROM ar WHERE cluster <> -1) WHERE k <= 15), pr AS (SELECT a.run_id, a.cluster, 0.5 * CASE WHEN len(a.premises) = 0 OR len(b.premises) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a.premises), list_distinct(b.premises))) / len(list_distinct(list_concat(a.premises, b.premises))) END + 0.25 * CASE WHEN a.position IS NOT DISTINCT FROM b.position THEN 1 ELSE 0 END + 0.15 * CASE WHEN len(a.evidence) = 0 OR len(b.evidence) = 0 THEN 0 ELSE len(list_intersect(a.evidence, b.evidence)) / len(list_distinct(list_concat(a.evidence, b.evidence))) END + 0.1 * CASE WHEN a.target <> '' AND b.target <> '' AND (contains(a.target, b.target) OR contains(b.target, a.target)) THEN 1 ELSE 0 END AS s FROM a15 a JOIN a15 b ON a.run_id = b.run_id AND a.cluster = b.cluster AND a.id < b.id)"


@view
def argument_pairs(t: Tables) -> DataFrame:
    """Identity score of each pair among the first fifteen members of a cluster."""
    k = F.row_number().over(Window.partitionBy(*BY).orderBy("id"))
    a15 = t.ar.where("cluster <> -1").withColumn("k", k).where("k <= 15")
    cols = ("id", "premises", "position", "evidence", "target")
    a, b = (a15.select(*BY, *(F.col(c).alias(f"{c}_{x}") for c in cols)) for x in "ab")
    return a.join(b, BY).where("id_a < id_b").select(*BY, C.argument_identity("a", "b").alias("s"))


@query(f", {SCAN} SELECT run_id, cluster, count(*) AS n_windows, sum(CASE WHEN lam > 0 THEN 1 ELSE 0 END)::BIGINT AS n_dense FROM l GROUP BY 1, 2")
def j16_windows(t: Tables) -> DataFrame:
    """How many windows of a cluster are looked at, and how many of them hold more than expected."""
    us = F.unix_micros(F.col("posted_date").cast("timestamp"))
    return count_windows(t.cc.where("posted_date IS NOT NULL").select("run_id", "cluster", us.alias("us")))


@query(f", {ARG15} SELECT run_id, cluster, count(*) AS n_pairs, round(sum(s), 6) AS total FROM pr GROUP BY 1, 2")
def sc1_argument_identity(t: Tables) -> DataFrame:
    return t.argument_pairs.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("s"), 6).alias("total"))


@query(f", {ARG15}, po AS (SELECT run_id, cluster, max(c) / sum(c) AS u FROM (SELECT run_id, cluster, position, count(*) AS c FROM a15 GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT pr.run_id, pr.cluster, round(avg(s), 4) AS mean_identity, round(median(s), 4) AS median_identity, round(any_value(u), 3) AS unanimity FROM pr JOIN po USING (run_id, cluster) GROUP BY 1, 2")
def ag14_arguments(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*BY).orderBy("id"))
    a15 = t.ar.where("cluster <> -1").withColumn("k", k).where("k <= 15")
    u = a15.groupBy(*BY, "position").agg(F.count(F.lit(1)).alias("c")).groupBy(*BY).agg(F.round(F.max("c") / F.sum("c"), 3).alias("unanimity"))
    return t.argument_pairs.groupBy(*BY).agg(F.round(F.avg("s"), 4).alias("mean_identity"), F.round(F.median("s"), 4).alias("median_identity")).join(u, BY)


@query(f", {ARG15} SELECT a.run_id, a.cluster, round(avg(CASE WHEN len(a.evidence) = 0 OR len(b.evidence) = 0 THEN 0 ELSE len(list_intersect(a.evidence, b.evidence)) / len(list_distinct(list_concat(a.evidence, b.evidence))) END), 6) AS mean_jaccard FROM a15 a JOIN a15 b ON a.run_id = b.run_id AND a.cluster = b.cluster AND a.id < b.id GROUP BY 1, 2")
def ag15_rhetoric(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*BY).orderBy("id"))
    a15 = t.ar.where("cluster <> -1").withColumn("k", k).where("k <= 15")
    a, b = (a15.select(*BY, F.col("id").alias(f"id_{x}"), F.col("evidence").alias(f"e_{x}")) for x in "ab")
    return a.join(b, BY).where("id_a < id_b").groupBy(*BY).agg(F.round(F.avg(T.jaccard(F.col("e_a"), F.col("e_b"))), 6).alias("mean_jaccard"))


EDGES = f"{META}, te AS (SELECT a.id AS src, b.id AS dst, 0.4::DOUBLE AS weight, 'timing' AS kind FROM cm a JOIN cm b ON a.id < b.id AND b.posted_date BETWEEN a.posted_date - INTERVAL 60 SECOND AND a.posted_date + INTERVAL 60 SECOND), {DUP}, tp AS (SELECT g AS src, id AS dst, 0.4::DOUBLE AS weight, 'template' AS kind FROM dg WHERE id <> g), ed AS (SELECT src, dst, round(sum(weight), 9) AS weight, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (SELECT * FROM te UNION ALL SELECT * FROM tp UNION ALL SELECT src, dst, weight, 'metadata' FROM me) GROUP BY 1, 2 HAVING round(sum(weight), 9) > 0.1)"


def coordination(t: Tables, groups: DataFrame) -> DataFrame:
    cm = t.cm
    return graph.combine_edges(graph.timing_edges(cm), graph.template_edges(groups.withColumnRenamed("g", "group_id")), graph.metadata_edges(cm))


@view
def edges(t: Tables) -> DataFrame:
    return coordination(t, t.dg)


@query(f"RECURSIVE, {EDGES} SELECT src, dst, weight, kinds FROM ed")
def ag16_edges(t: Tables) -> DataFrame:
    return t.edges


#: For the statistics of given communities the clusters of the last runs stand in for them.
MEMBER = "mb AS (SELECT id, run_id || ':' || cluster AS community FROM lab WHERE cluster <> -1)"


@view
def member(t: Tables) -> DataFrame:
    return t.lab.where("cluster <> -1").select("id", F.concat_ws(":", "run_id", "cluster").alias("community"))


@query(f"RECURSIVE, {EDGES}, {MEMBER}, s AS (SELECT community, count(*) AS n FROM mb GROUP BY 1 HAVING count(*) >= 3), i AS (SELECT a.community, sum(weight) AS w FROM ed JOIN mb a ON a.id = src JOIN mb b ON b.id = dst AND b.community = a.community GROUP BY 1) SELECT community, n, round(coalesce(w, 0), 6) AS weight, round(2 * coalesce(w, 0) / (n * (n - 1)), 6) AS density FROM s LEFT JOIN i USING (community)")
def ag17_community_stats(t: Tables) -> DataFrame:
    return graph.community_stats(t.edges, t.member)


@query(f"RECURSIVE, {DUP}, o AS (SELECT dg.g AS community, run_id, cluster, count(*) AS c FROM dg JOIN lab USING (id) GROUP BY 1, 2, 3) SELECT community, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS overlap FROM o GROUP BY 1")
def ag18_overlap(t: Tables) -> DataFrame:
    """Share of each near-duplicate group's members that lie in its commonest cluster; ag18_communities has the communities."""
    return overlap(t.dg.withColumnRenamed("g", "community"), t.lab)


def overlap(members: DataFrame, labels: DataFrame) -> DataFrame:
    o = members.join(labels, "id").groupBy("community", *BY).agg(F.count(F.lit(1)).alias("c"))
    return o.groupBy("community").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("overlap"))


@query()
def ag18_communities(t: Tables) -> DataFrame:
    return overlap(graph.communities(t.edges), t.lab)


@query()
def ag17_communities(t: Tables) -> DataFrame:
    return graph.community_stats(t.edges, graph.communities(t.edges))


@query(f", {VEC}, xy AS (SELECT run_id, cluster, v[1] AS x, v[2] AS y FROM ve JOIN lab USING (id) WHERE cluster <> -1) SELECT run_id, cluster, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(sqrt(greatest(0, (sum(x * x) + sum(y * y)) / (2 * count(*)) - pow((sum(x) + sum(y)) / (2 * count(*)), 2))), 6) AS radius FROM xy GROUP BY 1, 2")
def ag19_centre(t: Tables) -> DataFrame:
    """Centre of two coordinates, and the spread of both flattened together."""
    xy = t.ve.join(t.lab.where("cluster <> -1"), "id").select(*BY, F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"))
    n2 = 2 * F.count(F.lit(1))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / n2 - F.pow(F.sum(F.col("x") + F.col("y")) / n2, F.lit(2.0))))
    return xy.groupBy(*BY).agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(spread, 6).alias("radius"))


CENT = f"{VEC}, vc AS (SELECT ve.id, v, run_id, cluster FROM ve JOIN lab USING (id) WHERE cluster <> -1), ct AS (SELECT run_id, cluster, list(s ORDER BY i) AS c FROM (SELECT run_id, cluster, i, avg(v[i]) AS s FROM vc, range(1, 65) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2), cs AS (SELECT vc.run_id, vc.cluster, vc.id, list_inner_product(v, c) / (sqrt(list_inner_product(c, c)) + 1e-12) AS sim FROM vc JOIN ct USING (run_id, cluster))"


@view
def to_centre(t: Tables) -> DataFrame:
    """(run_id, cluster, id, sim): cosine of each member with its cluster's renormalised mean vector."""
    return C.to_centre(t.ve.join(t.lab.where("cluster <> -1"), "id"), BY)


@query(f", {CENT} SELECT run_id, cluster, count(*) AS n, round(median(1 - sim), 6) AS median_distance FROM cs GROUP BY 1, 2")
def ag20_centroid(t: Tables) -> DataFrame:
    return t.to_centre.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(1 - F.col("sim")), 6).alias("median_distance"))


@query(f", {CENT} SELECT run_id, cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY round(sim, 9) DESC, id) AS k FROM cs) WHERE k <= 3")
def wn5_exemplars(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*BY).orderBy(F.round("sim", 9).desc(), "id"))
    return t.to_centre.withColumn("k", k).where("k <= 3").select(*BY, "id")


@query(f", {CENT}, r AS (SELECT run_id, cluster, 1.5 * median(1 - sim) AS radius FROM cs GROUP BY 1, 2), h AS (SELECT c.run_id, c.cluster, p.v FROM (SELECT DISTINCT run_id, cluster FROM lab WHERE cluster <> -1) c JOIN (SELECT run_id, v FROM ve JOIN lab USING (id) WHERE cluster = -1) p USING (run_id)) SELECT h.run_id, h.cluster, count(*) AS n, round(avg(CASE WHEN 1 - list_inner_product(h.v, c) / (sqrt(list_inner_product(c, c)) + 1e-12) <= radius THEN 1.0 ELSE 0.0 END), 6) AS reachability FROM h JOIN ct USING (run_id, cluster) JOIN r USING (run_id, cluster) GROUP BY 1, 2")
def ml15_probe(t: Tables) -> DataFrame:
    """Share of probe vectors within 1.5 median distances of the centre; the noise of a run stands in for its paraphrases."""
    radius = t.to_centre.groupBy(*BY).agg((1.5 * F.median(1 - F.col("sim"))).alias("radius"))
    centre = C.centres(t.ve.join(t.lab.where("cluster <> -1"), "id"), BY)
    probes = t.ve.join(t.lab.where("cluster = -1"), "id").select("run_id", "v")
    inside = F.when(1 - T.dot(F.col("v"), F.col("c")) <= F.col("radius"), 1.0).otherwise(0.0)
    return probes.join(centre.join(radius, BY), "run_id").groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 6).alias("reachability"))


@query(", c AS (SELECT DISTINCT run_id, cluster_id, n_comments, campaign_score FROM clusters), r AS (SELECT run_id, count(*) AS n_clusters, sum(CASE WHEN campaign_score >= 0.4 THEN 1 ELSE 0 END)::BIGINT AS n_campaigns, sum(CASE WHEN campaign_score >= 0.4 THEN n_comments ELSE 0 END)::BIGINT AS n_manufactured FROM c GROUP BY 1), l AS (SELECT run_id, count(*) AS n, sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END)::BIGINT AS noise FROM (SELECT DISTINCT run_id, id, cluster FROM cluster_labels) GROUP BY 1) SELECT run_id, n_clusters, n_campaigns, n_manufactured, greatest(0, n - n_manufactured - noise) AS n_unique, round(n_manufactured / n * 100, 1) AS manufactured_pct FROM r JOIN l USING (run_id)")
def ag21_rollup(t: Tables) -> DataFrame:
    hit = F.col("campaign_score") >= CAMPAIGN
    c = t.clusters.select("run_id", "cluster_id", "n_comments", "campaign_score").distinct()
    r = c.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum(F.when(hit, 1).otherwise(0)).alias("n_campaigns"), F.sum(F.when(hit, F.col("n_comments")).otherwise(0)).alias("n_manufactured"))
    n = t.cluster_labels.select("run_id", "id", "cluster").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cluster") == -1, 1).otherwise(0)).alias("noise"))
    unique = F.greatest(F.lit(0), F.col("n") - F.col("n_manufactured") - F.col("noise"))
    return r.join(n, "run_id").select("run_id", "n_clusters", "n_campaigns", "n_manufactured", unique.alias("n_unique"), F.round(F.col("n_manufactured") / F.col("n") * 100, 1).alias("manufactured_pct"))


HOURS = "hr AS (SELECT date_trunc('hour', posted_date) AS h, count(*) AS n FROM cm WHERE posted_date IS NOT NULL GROUP BY 1), fl AS (SELECT g.h, coalesce(hr.n, 0) AS n FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hr) g LEFT JOIN hr ON hr.h = g.h), tl AS (SELECT strftime(h, '%Y-%m-%dT%H:00:00Z') AS hour, n, CASE WHEN count(*) OVER () < 3 THEN false ELSE coalesce((n - avg(n) OVER ()) / nullif(stddev_samp(n) OVER (), 0) > 3, false) END AS is_burst FROM fl)"


@view
def timeline(t: Tables) -> DataFrame:
    return C.timeline(t.cm, "posted_date")


@query(f", {HOURS} SELECT hour, n, is_burst FROM tl")
def ag22_timeline(t: Tables) -> DataFrame:
    return t.timeline


@query(f", {SIZE} SELECT run_id, cluster, n FROM size")
def ag23_sizes(t: Tables) -> DataFrame:
    return t.size


PAIRED = "tp AS (SELECT coalesce(c.organization, '?') AS truth, l.run_id || ':' || l.cluster AS pred FROM lab l JOIN cm c USING (id) WHERE l.cluster <> -1)"


@view
def paired(t: Tables) -> DataFrame:
    """True classes (the organisation as typed stands in) and predicted clusters of the members of clusters."""
    return t.cc.where("cluster <> -1").select(F.coalesce("organization", F.lit("?")).alias("truth"), F.concat_ws(":", "run_id", "cluster").alias("pred"))


@query(f", {PAIRED}, n AS (SELECT truth, pred, count(*)::DOUBLE AS c FROM tp GROUP BY 1, 2), a AS (SELECT truth, sum(c) AS c FROM n GROUP BY 1), b AS (SELECT pred, sum(c) AS c FROM n GROUP BY 1), z AS (SELECT sum(c) AS n FROM n), h AS (SELECT (SELECT -sum(c / z.n * ln(c / z.n)) FROM a, z) AS ht, (SELECT -sum(c / z.n * ln(c / z.n)) FROM b, z) AS hp, (SELECT -sum(n.c / z.n * ln(n.c / b.c)) FROM n JOIN b USING (pred), z) AS htp, (SELECT -sum(n.c / z.n * ln(n.c / a.c)) FROM n JOIN a USING (truth), z) AS hpt, (SELECT sum(c * (c - 1) / 2) FROM n) AS s, (SELECT sum(c * (c - 1) / 2) FROM a) AS sa, (SELECT sum(c * (c - 1) / 2) FROM b) AS sb, (SELECT n * (n - 1) / 2 FROM z) AS sz) SELECT round(1 - htp / ht, 6) AS homogeneity, round(1 - hpt / hp, 6) AS completeness, round(2 * (1 - htp / ht) * (1 - hpt / hp) / ((1 - htp / ht) + (1 - hpt / hp)), 6) AS v_measure, round((ht - htp) / ((ht + hp) / 2), 6) AS nmi, round((s - sa * sb / sz) / ((sa + sb) / 2 - sa * sb / sz), 6) AS ari FROM h")
def ag24_agreement(t: Tables) -> DataFrame:
    return C.agreement(t.paired, "truth", "pred")


@query(", tp AS (SELECT coalesce(organization, '?') AS truth, cluster, run_id || ':' || cluster AS pred FROM cc), n AS (SELECT truth, pred, any_value(cluster) AS cluster, count(*) AS c FROM tp GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY c DESC, pred) AS k FROM n WHERE cluster <> -1) SELECT n.truth, count(*) FILTER (WHERE n.cluster <> -1) AS n_clusters, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (WHERE n.cluster = -1), 0)::BIGINT AS n_noise, (SELECT string_agg(pred || '=' || c, ',' ORDER BY k) FROM f WHERE f.truth = n.truth AND k <= 3) AS top FROM n GROUP BY n.truth")
def ag25_fragmentation(t: Tables) -> DataFrame:
    """Of each class its clusters, how many of it are noise, and its three largest clusters."""
    n = t.cc.select(F.coalesce("organization", F.lit("?")).alias("truth"), "cluster", F.concat_ws(":", "run_id", "cluster").alias("pred")).groupBy("truth", "pred", "cluster").agg(F.count(F.lit(1)).alias("c"))
    k = F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("c"), "pred"))
    f = n.where("cluster <> -1").withColumn("k", k).where("k <= 3").groupBy("truth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("=", "pred", "c").alias("p")))), lambda x: x["p"]), ",").alias("top"))
    noise = F.col("cluster") == -1
    a = n.groupBy("truth").agg(F.count_if(~noise).alias("n_clusters"), F.sum("c").alias("n"), F.sum(F.when(noise, F.col("c")).otherwise(0)).alias("n_noise"))
    return a.join(f, "truth", "left")


@query(f", {PAIRED} SELECT pred, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS purity FROM (SELECT truth, pred, count(*) AS c FROM tp GROUP BY 1, 2) GROUP BY 1 ORDER BY n DESC, pred LIMIT 10")
def ag26_purity(t: Tables) -> DataFrame:
    c = t.paired.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("pred").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("purity")).orderBy(F.desc("n"), "pred").limit(10)


@query(f"RECURSIVE, {DUP} SELECT g AS community, run_id, cluster, count(*) AS n FROM dg JOIN lab USING (id) GROUP BY 1, 2, 3")
def j14_members_labels(t: Tables) -> DataFrame:
    return t.dg.join(t.lab, "id").groupBy(F.col("g").alias("community"), *BY).agg(F.count(F.lit(1)).alias("n"))


# Learned operators


@query()
def ml1_minhash(t: Tables) -> DataFrame:
    return C.minhash(t.tx.select("id", T.shingles(F.col("text")).alias("g")), "id", "g").select("id", F.element_at("sig", 1).alias("s1"), F.element_at("sig", 126).alias("s126"))


@query()
def j7_band_collisions(t: Tables) -> DataFrame:
    """(id, n): with how many bands each text collides with another text."""
    bands = C.bands(C.minhash(t.tx.select("id", T.shingles(F.col("text")).alias("g")), "id", "g"), "id", 14, 9)
    hit = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    return bands.join(hit, "band").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query()
def ml2_lsh_pairs(t: Tables) -> DataFrame:
    """How many texts each text shares a band with, by bands of nine of 126 least hashes."""
    bands = C.bands(C.minhash(t.tx.select("id", T.shingles(F.col("text")).alias("g")), "id", "g"), "id", 14, 9)
    return bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n >= 2")


@query()
def ml3_lsh_groups(t: Tables) -> DataFrame:
    """Groups of texts that share bands: each band links its texts to its least id, so no pairs are made."""
    bands = C.bands(C.minhash(t.tx.select("id", T.shingles(F.col("text")).alias("g")), "id", "g"), "id", 14, 9)
    first = bands.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    links = bands.join(first, "band").where("id <> first").select("id", "first").distinct()
    return graph.components(links, "id", "first")


@query(f", {SIZE} SELECT run_id, cluster, n, greatest(5, floor(sqrt(t) / 3))::BIGINT AS min_cluster FROM (SELECT *, sum(n) OVER (PARTITION BY run_id) AS t FROM size)")
def ml7_min_sizes(t: Tables) -> DataFrame:
    """The automatic least cluster size of a run beside its clusters' sizes."""
    total = F.sum("n").over(Window.partitionBy("run_id"))
    return t.size.select(*BY, "n", F.greatest(F.lit(5), F.floor(F.sqrt(total) / 3)).alias("min_cluster"))


@query()
def ml5_reduced(t: Tables) -> DataFrame:
    return C.principal(t.ve, "id", "v", 15)


@query()
def ml6_projected(t: Tables) -> DataFrame:
    return C.principal(t.ve, "id", "v", 2)


@query()
def ml12_communities(t: Tables) -> DataFrame:
    return graph.communities(t.edges)


@query("SELECT id, CASE WHEN cluster = -1 AND p > 0.5 THEN best ELSE cluster END AS cluster FROM (SELECT a.id, a.cluster, max(m.p) AS p, arg_max(m.cluster, m.p) AS best FROM lab a JOIN (SELECT run_id, cluster, count(*) / (sum(count(*)) OVER (PARTITION BY run_id)) AS p FROM lab WHERE cluster <> -1 GROUP BY 1, 2) m USING (run_id) GROUP BY 1, 2)")
def ml9_largest(t: Tables) -> DataFrame:
    """Noise goes to its run's largest cluster if that holds more than half of the clustered; ml9b_reclaimed goes by soft membership."""
    n = t.lab.where("cluster <> -1").groupBy("run_id", F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("c"))
    p = n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("run_id"))).groupBy("run_id").agg(F.max("p").alias("p"), F.max_by("other", "p").alias("best"))
    return t.lab.join(p, "run_id").select("id", F.when((F.col("cluster") == -1) & (F.col("p") > 0.5), F.col("best")).otherwise(F.col("cluster")).alias("cluster"))


# Scores

PART = {"duplicate": "score_breakdown.duplicate", "temporal_coupling": "1 - exp(-score_breakdown.temporal_coupling)", "stylometric": "score_breakdown.stylometric / (100 + score_breakdown.stylometric)", "argument_identity": "score_breakdown.argument_identity", "ai_detection": "score_breakdown.ai_detection / 100", "paraphrase_reachable": "score_breakdown.paraphrase_reachable / (10 + score_breakdown.paraphrase_reachable)"}
SCORED = "sx AS (SELECT DISTINCT run_id, docket_id, cluster_id, n_comments, is_tree_campaign, center_x, center_y, radius, score_breakdown FROM clusters), sq AS (SELECT *, " + ", ".join(f"CASE WHEN {e} IS NULL OR isnan({e}) THEN 0.0 ELSE greatest(0.0, least(1.0, {e})) END AS s_{k}" for k, e in PART.items()) + " FROM sx), sd AS (SELECT *, round(least(1.0, " + " + ".join(f"{w} * s_{k}" for k, w in WEIGHTS.items()) + "), 3) AS score FROM sq)"


@view
def scored(t: Tables) -> DataFrame:
    """Clusters with each signal brought into [0, 1] (missing is 0) and their weighted sum."""
    c = t.clusters.select("run_id", "docket_id", "cluster_id", "n_comments", "is_tree_campaign", "center_x", "center_y", "radius", "score_breakdown").distinct()
    for k, e in PART.items():
        c = c.withColumn(f"s_{k}", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(T.finite_or_large(F.expr(e)), F.lit(0.0)))))
    total = None
    for k, w in WEIGHTS.items():
        total = F.lit(w) * F.col(f"s_{k}") if total is None else total + F.lit(w) * F.col(f"s_{k}")
    return c.withColumn("score", F.round(F.least(F.lit(1.0), total), 3))


#: The signals of the score: the query that works each out, and its column.
PARTS = {"duplicate": ("ag1_duplicates", "dup_fraction"), "temporal_coupling": ("ag10_scan", "tcs"), "stylometric": ("ag9_style", "style_score"), "argument_identity": ("ag14_arguments", "mean_identity"), "ai_detection": ("ag13_generated_score", "ai_score"), "paraphrase_reachable": ("ml15_probe", "reachability")}
COMPUTED = f"{SIZE}, " + ", ".join(f"g_{k} AS ({nested(q)})" for k, (q, _) in PARTS.items()) + ", cs0 AS (SELECT size.run_id, size.cluster, size.n, " + ", ".join(f"coalesce(g_{k}.{c}, 0.0) AS {k}" for k, (_, c) in PARTS.items()) + " FROM size " + " ".join(f"LEFT JOIN g_{k} ON g_{k}.run_id = size.run_id AND g_{k}.cluster = size.cluster" for k in PARTS) + "), cs1 AS (SELECT *, round(least(1.0, " + " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items()) + "), 3) AS score FROM cs0)"


@view
def computed(t: Tables) -> DataFrame:
    """Clusters of the last runs with each signal worked out from the texts, times, names and vectors (missing is 0), and their weighted sum."""
    t = t.kept()
    works = {"ag1_duplicates": ag1_duplicates, "ag10_scan": ag10_scan, "ag9_style": style_suite.ag9_style, "ag14_arguments": ag14_arguments, "ag13_generated_score": style_suite.ag13_generated_score, "ml15_probe": ml15_probe}
    c = t.size
    for k, (q, col) in PARTS.items():
        c = c.join(works[q](t).select(*BY, F.col(col).alias(k)), BY, "left").withColumn(k, F.coalesce(k, F.lit(0.0)))
    total = None
    for k, w in WEIGHTS.items():
        total = F.lit(w) * F.col(k) if total is None else total + F.lit(w) * F.col(k)
    return c.withColumn("score", F.round(F.least(F.lit(1.0), total), 3))


@query(f"RECURSIVE, {COMPUTED} SELECT run_id, cluster, score FROM cs1")
def sc2_score(t: Tables) -> DataFrame:
    return t.computed.select(*BY, "score")


@query(f", {SCORED} SELECT run_id, cluster_id, score FROM sd")
def sc2_stored(t: Tables) -> DataFrame:
    """The same sum over the stored breakdown of clusters."""
    return t.scored.select("run_id", "cluster_id", "score")


@query(f"RECURSIVE, {COMPUTED} SELECT run_id, cluster, CASE WHEN score >= 0.4 THEN 'campaign' WHEN score >= 0.28 THEN 'uncertain' ELSE 'organic' END AS verdict FROM cs1")
def sc3_verdict(t: Tables) -> DataFrame:
    return t.computed.select(*BY, C.verdict(F.col("score")).alias("verdict"))


@query(f"RECURSIVE, {COMPUTED}, ctr AS ({nested('ag19_centre')}) SELECT cs1.run_id, cs1.cluster, n AS n_comments, cs1.cluster >= 10000 AS is_tree_campaign, {', '.join(PARTS)}, score, CASE WHEN score >= 0.4 THEN 'campaign' WHEN score >= 0.28 THEN 'uncertain' ELSE 'organic' END AS verdict, cx, cy, radius FROM cs1 LEFT JOIN ctr ON ctr.run_id = cs1.run_id AND ctr.cluster = cs1.cluster WHERE n >= 3")
def sc4_clusters(t: Tables) -> DataFrame:
    """Scored clusters of three or more, with the signals the score is made of and where they lie."""
    return t.computed.where("n >= 3").join(ag19_centre(t), BY, "left").select(*BY, F.col("n").alias("n_comments"), (F.col("cluster") >= 10000).alias("is_tree_campaign"), *PARTS, "score", C.verdict(F.col("score")).alias("verdict"), "cx", "cy", "radius")


@query(f", {ARGS}, f AS (SELECT run_id, cluster, min(id) AS id FROM ar WHERE cluster <> -1 AND len(premises) > 0 GROUP BY 1, 2) SELECT f.run_id, f.cluster, substring(md5(array_to_string(list_sort(premises), '||')), 1, 16) AS argument_hash FROM f JOIN ar USING (id)")
def sc5_fingerprints(t: Tables) -> DataFrame:
    a = t.ar.where("cluster <> -1").where(F.size("premises") > 0)
    return a.groupBy(*BY).agg(F.min_by("premises", "id").alias("premises")).select(*BY, T.premise_hash(F.col("premises")).alias("argument_hash"))


@query("SELECT docket_id, count(*) AS n FROM tx GROUP BY 1 HAVING count(*) >= 30")
def sc6_guard(t: Tables) -> DataFrame:
    return t.tx.groupBy("docket_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
