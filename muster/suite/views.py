"""Serving queries (AP) and dashboard queries (DB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from muster.functions import text as T
from muster.suite.base import Tables, query
from muster.suite.relational import RESOLVED, registry, resolved
from muster.suite.signals import BY, GEO, HOURS, SCORED

CL = "cl AS (SELECT DISTINCT run_id, docket_id, cluster_id, n_comments, is_tree_campaign, classification, campaign_score, score_breakdown, center_x, center_y, radius FROM clusters), lc AS (SELECT cl.* FROM cl JOIN (SELECT docket_id, max(id) AS run_id FROM analysis_runs WHERE id % 2 = 0 GROUP BY 1) r USING (run_id))"
DOCKET = "OLRB-2029-0003"


def last_clusters(t: Tables) -> DataFrame:
    """Clusters of each docket's last finished run, each once."""
    last = t.analysis_runs.where("id % 2 = 0").groupBy("docket_id").agg(F.max("id").alias("run_id")).select("run_id")
    return t.clusters.distinct().join(last, "run_id")


@query("SELECT docket_id, n_comments, n_clusters, n_campaigns, max(id) AS last_id FROM analysis_runs WHERE id % 2 = 0 GROUP BY 1, 2, 3, 4 ORDER BY last_id DESC")
def ap1_dockets(t: Tables) -> DataFrame:
    return t.analysis_runs.where("id % 2 = 0").groupBy("docket_id", "n_comments", "n_clusters", "n_campaigns").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id"))


@query(f", {CL}, s AS (SELECT docket_id, count(*) AS n_clusters, sum(CASE WHEN campaign_score >= 0.4 THEN 1 ELSE 0 END)::BIGINT AS n_campaigns, sum(CASE WHEN campaign_score >= 0.4 THEN n_comments ELSE 0 END)::BIGINT AS n_manufactured FROM lc GROUP BY 1), n AS (SELECT docket_id, count(*) AS n, sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END)::BIGINT AS noise FROM cc GROUP BY 1) SELECT docket_id, n AS n_comments, n_clusters, n_campaigns, n_manufactured, greatest(0, n - n_manufactured - noise) AS n_unique, round(n_manufactured / greatest(1, n) * 100, 1) AS manufactured_pct FROM s JOIN n USING (docket_id)")
def ap2_summary(t: Tables) -> DataFrame:
    hit = F.col("campaign_score") >= 0.4
    s = last_clusters(t).groupBy("docket_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum(F.when(hit, 1).otherwise(0)).alias("n_campaigns"), F.sum(F.when(hit, F.col("n_comments")).otherwise(0)).alias("n_manufactured"))
    n = t.cc.groupBy("docket_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cluster") == -1, 1).otherwise(0)).alias("noise"))
    return s.join(n, "docket_id").select("docket_id", F.col("n").alias("n_comments"), "n_clusters", "n_campaigns", "n_manufactured", F.greatest(F.lit(0), F.col("n") - F.col("n_manufactured") - F.col("noise")).alias("n_unique"), F.round(F.col("n_manufactured") / F.greatest(F.lit(1), "n") * 100, 1).alias("manufactured_pct"))


@query(f", {CL} SELECT cluster_id, n_comments, classification, campaign_score FROM lc WHERE docket_id = '{DOCKET}'")
def ap3_clusters(t: Tables) -> DataFrame:
    return last_clusters(t).where(F.col("docket_id") == DOCKET).select("cluster_id", "n_comments", "classification", "campaign_score")


@query(f", {CL} SELECT cluster_id, n_comments, classification, campaign_score, radius FROM lc WHERE docket_id = '{DOCKET}' AND cluster_id = 3")
def ap4_cluster(t: Tables) -> DataFrame:
    return last_clusters(t).where((F.col("docket_id") == DOCKET) & (F.col("cluster_id") == 3)).select("cluster_id", "n_comments", "classification", "campaign_score", "radius")


@query(f", hr AS (SELECT date_trunc('hour', posted_date) AS h, count(*) AS n FROM cm WHERE posted_date IS NOT NULL AND docket_id = '{DOCKET}' GROUP BY 1), fl AS (SELECT g.h, coalesce(hr.n, 0) AS n FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hr) g LEFT JOIN hr ON hr.h = g.h) SELECT strftime(h, '%Y-%m-%dT%H:00:00Z') AS hour, n FROM fl")
def ap5_timeline(t: Tables) -> DataFrame:
    from muster.operators.clusters import timeline

    return timeline(t.cm.where(F.col("docket_id") == DOCKET), "posted_date").select("hour", "n")


@query()
def ap6_document(t: Tables) -> DataFrame:
    """One JSON document a docket; its clusters in order, each docket's bounded by its run."""
    c = last_clusters(t).groupBy("docket_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "n_comments", "classification", "campaign_score"))).alias("clusters"))
    return c.select("docket_id", F.to_json(F.struct("docket_id", "run_id", "clusters")).alias("document"))


@query(f", {CL} SELECT run_id, cluster_id, campaign_score FROM lc WHERE classification = 'organic' AND n_comments >= 5 AND (run_id, cluster_id) IN (SELECT run_id, cluster FROM tc WHERE contains(lower(text), 'permit')) ORDER BY campaign_score DESC, run_id, cluster_id")
def db1_screener(t: Tables) -> DataFrame:
    hits = t.tc.where(F.contains(F.lower("text"), F.lit("permit"))).select("run_id", F.col("cluster").alias("cluster_id"))
    c = last_clusters(t).where("classification = 'organic' AND n_comments >= 5").join(hits, ["run_id", "cluster_id"], "left_semi")
    return c.select("run_id", "cluster_id", "campaign_score").orderBy(F.desc("campaign_score"), "run_id", "cluster_id")


@query(f", {CL} SELECT docket_id, arg_max(cluster_id, n_comments * 100000 - cluster_id) AS cluster_id FROM lc WHERE classification = 'campaign' GROUP BY 1")
def db2_largest_campaign(t: Tables) -> DataFrame:
    return last_clusters(t).where("classification = 'campaign'").groupBy("docket_id").agg(F.max_by("cluster_id", F.struct("n_comments", -F.col("cluster_id"))).alias("cluster_id"))


@query("SELECT run_id, cluster, org, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY n DESC, org) AS k FROM (SELECT run_id, cluster, trim(organization) AS org, count(*) AS n FROM cc WHERE trim(organization) <> '' GROUP BY 1, 2, 3)) WHERE k <= 14")
def db3_top_orgs(t: Tables) -> DataFrame:
    n = t.cc.where("trim(organization) <> ''").groupBy(*BY, F.trim("organization").alias("org")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("n"), "org"))).where("k <= 14").select(*BY, "org", "n")


@query("SELECT run_id, cluster, substring(text, 1, 200) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY run_id, cluster) AS n FROM tc) WHERE k = 7 % n")
def db4_kth_text(t: Tables) -> DataFrame:
    w = Window.partitionBy(*BY)
    rows = t.tc.withColumn("k", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where("k = 7 % n").select(*BY, F.substring("text", 1, 200).alias("sample"))


@query(f", {CL} SELECT least(9, floor(campaign_score * 10))::INT AS bin, count(*) AS n FROM cl WHERE campaign_score IS NOT NULL GROUP BY 1")
def db6_histogram(t: Tables) -> DataFrame:
    c = t.clusters.distinct().where("campaign_score IS NOT NULL")
    return c.groupBy(F.least(F.lit(9), F.floor(F.col("campaign_score") * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f", {HOURS} SELECT max(n) AS peak, sum(n)::BIGINT AS total, sum(CASE WHEN is_burst THEN 1 ELSE 0 END)::BIGINT AS bursts, round(avg(CASE WHEN n > 0 THEN n END), 6) AS mean_busy FROM tl")
def db7_kpis(t: Tables) -> DataFrame:
    return t.timeline.agg(F.max("n").alias("peak"), F.sum("n").alias("total"), F.sum(F.when(F.col("is_burst"), 1).otherwise(0)).alias("bursts"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("mean_busy"))


@query(f", {CL} SELECT classification, count(*) AS n, round(avg(center_x), 9) AS cx, round(avg(center_y), 9) AS cy FROM lc GROUP BY 1")
def db8_centres(t: Tables) -> DataFrame:
    return last_clusters(t).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("center_x"), 9).alias("cx"), F.round(F.avg("center_y"), 9).alias("cy"))


@query(f", {CL} SELECT classification, sum(n_comments)::BIGINT AS volume, round(sum(n_comments) / sum(sum(n_comments)) OVER () * 100, 4) AS pct FROM lc GROUP BY 1")
def db9_volume(t: Tables) -> DataFrame:
    v = last_clusters(t).groupBy("classification").agg(F.sum("n_comments").alias("volume"))
    return v.select("classification", "volume", F.round(F.col("volume") / F.sum("volume").over(Window.partitionBy()) * 100, 4).alias("pct"))  # one row a class


@query(f", {CL}, b AS (SELECT floor(center_y / 1.5 + 0.5)::BIGINT AS row, * FROM lc WHERE center_x IS NOT NULL AND center_y IS NOT NULL) SELECT row, floor(center_x / 1.7 - (abs(row) % 2) * 0.5 + 0.5)::BIGINT AS col, count(*) AS n, sum(CASE WHEN classification = 'campaign' THEN 1 ELSE 0 END)::BIGINT AS campaigns FROM b GROUP BY 1, 2")
def db10_hexbin(t: Tables) -> DataFrame:
    b = last_clusters(t).where("center_x IS NOT NULL AND center_y IS NOT NULL").withColumn("row", F.floor(F.col("center_y") / 1.5 + 0.5))
    col = F.floor(F.col("center_x") / 1.7 - (F.abs("row") % 2) * 0.5 + 0.5)
    return b.groupBy("row", col.alias("col")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("classification") == "campaign", 1).otherwise(0)).alias("campaigns"))


@query("SELECT docket_id, count(DISTINCT cluster) AS n_clusters, count(*) AS volume, arg_max(cluster, c * 1000000 - cluster) AS top_cluster FROM (SELECT docket_id, cluster, count(*) OVER (PARTITION BY docket_id, cluster) AS c FROM cc WHERE cluster <> -1) GROUP BY 1")
def db11_community_rows(t: Tables) -> DataFrame:
    c = t.cc.where("cluster <> -1").groupBy("docket_id", "cluster").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("docket_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("c").alias("volume"), F.max_by("cluster", F.struct("c", -F.col("cluster"))).alias("top_cluster"))


@query(f", {GEO} SELECT state, count(*) AS n FROM st WHERE state IS NOT NULL AND cluster <> -1 GROUP BY 1")
def db12_states(t: Tables) -> DataFrame:
    return t.st.where("state IS NOT NULL AND cluster <> -1").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f", {SCORED} SELECT run_id, cluster_id, round(s_duplicate, 4) AS exact, round(greatest(0, s_argument_identity - s_duplicate), 4) AS near, round(greatest(0, 1 - greatest(s_argument_identity, s_duplicate)), 4) AS rest FROM sd")
def db13_gradient(t: Tables) -> DataFrame:
    d, a = F.col("s_duplicate"), F.col("s_argument_identity")
    return t.scored.select("run_id", "cluster_id", F.round(d, 4).alias("exact"), F.round(F.greatest(F.lit(0.0), a - d), 4).alias("near"), F.round(F.greatest(F.lit(0.0), 1 - F.greatest(a, d)), 4).alias("rest"))


_S = ["s_duplicate", "s_temporal_coupling", "s_stylometric", "s_argument_identity", "s_ai_detection", "s_paraphrase_reachable"]


@query(f", {SCORED} SELECT run_id, cluster_id, ({' + '.join(f'CASE WHEN {s} > 0.5 THEN 1 ELSE 0 END' for s in _S)})::INT AS firing FROM sd")
def db14_firing(t: Tables) -> DataFrame:
    return t.scored.select("run_id", "cluster_id", F.size(F.filter(F.array(*_S), lambda x: x > 0.5)).alias("firing"))


@query(f", {SCORED}, t30 AS (SELECT * FROM sd ORDER BY score DESC, run_id, cluster_id LIMIT 30) " + " UNION ALL ".join(f"SELECT run_id, cluster_id, '{s}' AS signal, round({s}, 4) AS value FROM t30" for s in _S))
def db15_heatmap(t: Tables) -> DataFrame:
    top = t.scored.orderBy(F.desc("score"), "run_id", "cluster_id").limit(30)
    return top.unpivot(["run_id", "cluster_id"], _S, "signal", "value").select("run_id", "cluster_id", "signal", F.round("value", 4).alias("value"))


@query(f", {SCORED} SELECT score >= 0.4 AS campaign, " + ", ".join(f"round(median({s}), 5) AS {s}" for s in _S) + ", sum(CASE WHEN s_duplicate BETWEEN 0.1 AND 0.9 AND s_argument_identity BETWEEN 0.2 AND 0.8 THEN 1 ELSE 0 END)::BIGINT AS brushed FROM sd GROUP BY 1")
def db16_parallel(t: Tables) -> DataFrame:
    brush = F.col("s_duplicate").between(0.1, 0.9) & F.col("s_argument_identity").between(0.2, 0.8)
    return t.scored.groupBy((F.col("score") >= 0.4).alias("campaign")).agg(*[F.round(F.median(s), 5).alias(s) for s in _S], F.sum(F.when(brush, 1).otherwise(0)).alias("brushed"))


@query(f", {CL}, s AS (SELECT 'all' AS src, docket_id AS dst, sum(n_comments)::BIGINT AS value FROM lc GROUP BY 2 UNION ALL SELECT docket_id, classification, sum(n_comments)::BIGINT FROM lc GROUP BY 1, 2) SELECT src, dst, value FROM s")
def db17_sankey(t: Tables) -> DataFrame:
    c = last_clusters(t)
    one = c.groupBy(F.lit("all").alias("src"), F.col("docket_id").alias("dst")).agg(F.sum("n_comments").alias("value"))
    return one.unionByName(c.groupBy(F.col("docket_id").alias("src"), F.col("classification").alias("dst")).agg(F.sum("n_comments").alias("value")))


ORG8 = "o8 AS (SELECT org FROM (SELECT trim(organization) AS org, count(*) AS n FROM cc WHERE trim(organization) <> '' GROUP BY 1 ORDER BY n DESC, org LIMIT 8)), co AS (SELECT DISTINCT run_id, cluster, trim(organization) AS org FROM cc WHERE trim(organization) IN (SELECT org FROM o8)), ch AS (SELECT a.org AS org_a, b.org AS org_b, count(*) AS n FROM co a JOIN co b ON a.run_id = b.run_id AND a.cluster = b.cluster AND a.org <> b.org GROUP BY 1, 2)"


def _chord(t: Tables) -> DataFrame:
    named = t.cc.where("trim(organization) <> ''").select(*BY, F.trim("organization").alias("org"))
    top = named.groupBy("org").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "org").limit(8).select("org")
    co = named.join(F.broadcast(top), "org").distinct()  # eight orgs a cluster at most
    a, b = co.withColumnRenamed("org", "org_a"), co.withColumnRenamed("org", "org_b")
    return a.join(b, BY).where("org_a <> org_b").groupBy("org_a", "org_b").agg(F.count(F.lit(1)).alias("n"))


@query(f", {ORG8} SELECT org_a, org_b, n FROM ch UNION ALL SELECT org, org, 1 FROM o8 WHERE org NOT IN (SELECT org_a FROM ch)")
def db18_chord(t: Tables) -> DataFrame:
    named = t.cc.where("trim(organization) <> ''").select(F.trim("organization").alias("org"))
    top = named.groupBy("org").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "org").limit(8).select("org")
    ch = _chord(t)
    alone = top.join(ch.select(F.col("org_a").alias("org")), "org", "left_anti")
    return ch.unionByName(alone.select(F.col("org").alias("org_a"), F.col("org").alias("org_b"), F.lit(1).cast("long").alias("n")))


@query(f", {ORG8} SELECT org_a AS org, count(*) AS partners, sum(n)::BIGINT AS links, arg_max(org_b, n) AS any_top FROM (SELECT * FROM ch) GROUP BY 1".replace(", arg_max(org_b, n) AS any_top", ""))
def db19_partners(t: Tables) -> DataFrame:
    return _chord(t).groupBy(F.col("org_a").alias("org")).agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("links"))


@query("SELECT p.state_code, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct, any_value(p.population) > 1000000 AS flagged FROM cm JOIN (SELECT state_code, sum(population) AS population FROM places GROUP BY 1) p ON upper(trim(cm.state_prov)) = p.state_code GROUP BY 1")
def db20_regions(t: Tables) -> DataFrame:
    p = t.places.groupBy("state_code").agg(F.sum("population").alias("population"))
    n = t.cm.select(F.upper(F.trim("state_prov")).alias("state_code")).join(F.broadcast(p), "state_code").groupBy("state_code").agg(F.count(F.lit(1)).alias("n"), F.first("population").alias("population"))
    return n.select("state_code", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 4).alias("pct"), (F.col("population") > 1000000).alias("flagged"))  # one row a state


@query(f", {RESOLVED}, m AS (SELECT cc.run_id, cc.cluster, reg.name FROM cc JOIN rs USING (organization) JOIN reg ON reg.pos = rs.pos), s AS (SELECT run_id, cluster, count(*) AS n FROM cc GROUP BY 1, 2) SELECT name, run_id, cluster, c, pct FROM (SELECT name, m.run_id, m.cluster, count(*) AS c, round(count(*) / any_value(n), 4) AS pct, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, m.run_id, m.cluster) AS k FROM m JOIN s ON s.run_id = m.run_id AND s.cluster = m.cluster GROUP BY 1, 2, 3) WHERE k <= 10")
def db21_entity_drilldown(t: Tables) -> DataFrame:
    e = resolved(t).join(F.broadcast(registry(t)), "pos").select("organization", "name")
    c = t.cc.select(*BY, "organization").join(e, "organization").groupBy("name", *BY).agg(F.count(F.lit(1)).alias("c"))
    n = t.cc.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("c"), *BY))
    return c.join(n, BY).withColumn("k", k).where("k <= 10").select("name", *BY, "c", F.round(F.col("c") / F.col("n"), 4).alias("pct"))


@query(f", {SCORED}, m AS (SELECT cc.id, sd.* FROM cc JOIN sd ON sd.run_id = cc.run_id AND sd.cluster_id = cc.cluster WHERE sd.score >= 0.28) SELECT id, CASE WHEN s_duplicate > 0.5 THEN 'template' WHEN s_temporal_coupling > 0.5 THEN 'burst' WHEN s_argument_identity > 0.4 THEN 'argument' WHEN s_ai_detection > 0.6 THEN 'generated' WHEN s_stylometric > 0.5 THEN 'style' ELSE 'score' END AS reason FROM m")
def db22_firehose(t: Tables) -> DataFrame:
    s = t.scored.where("score >= 0.28").withColumnRenamed("cluster_id", "cluster").select(*BY, *_S)
    reason = F.when(F.col("s_duplicate") > 0.5, "template").when(F.col("s_temporal_coupling") > 0.5, "burst").when(F.col("s_argument_identity") > 0.4, "argument").when(F.col("s_ai_detection") > 0.6, "generated").when(F.col("s_stylometric") > 0.5, "style").otherwise("score")
    return t.cc.select("id", *BY).join(s, BY).select("id", reason.alias("reason"))


_ALERTS = (("burst", "s_temporal_coupling", 0.5), ("high_score", "score", 0.7), ("argument", "s_argument_identity", 0.4), ("generated", "s_ai_detection", 0.6))


@query(f", {SCORED}, t30 AS (SELECT * FROM sd WHERE score >= 0.4 ORDER BY score DESC, run_id, cluster_id LIMIT 30) " + " UNION ALL ".join(f"SELECT run_id, cluster_id, '{a}' AS alert FROM t30 WHERE {c} > {x}" for a, c, x in _ALERTS))
def db23_alerts(t: Tables) -> DataFrame:
    top = t.scored.where("score >= 0.4").orderBy(F.desc("score"), "run_id", "cluster_id").limit(30)
    each = F.array(*[F.when(F.col(c) > x, F.lit(a)) for a, c, x in _ALERTS])
    return top.select("run_id", "cluster_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("alert"))


@query(f", {SCORED}, l AS (" + " UNION ALL ".join(f"SELECT run_id, cluster_id, '{s}' AS signal, {s} AS v FROM sd" for s in _S) + ") SELECT run_id, cluster_id, signal FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY v DESC, signal) AS k FROM l WHERE v > 0.2) WHERE k <= 2")
def db24_brief(t: Tables) -> DataFrame:
    named = F.array(*[F.struct((-F.col(s)).alias("v"), F.lit(s).alias("signal")) for s in _S])
    top = F.slice(F.array_sort(F.filter(named, lambda x: -x["v"] > 0.2)), 1, 2)
    return t.scored.select("run_id", "cluster_id", F.explode(top).alias("x")).select("run_id", "cluster_id", "x.signal")


@query(r"SELECT docket_id, sum(replace(regexp_extract(text, '\$([0-9][0-9,]*)', 1), ',', '')::DOUBLE) AS spend, count(*) AS n FROM tx WHERE regexp_matches(text, '\$[0-9]') GROUP BY 1")
def db25_spend(t: Tables) -> DataFrame:
    amount = T.dollars(F.nullif(F.regexp_extract("text", r"(\$[0-9][0-9,]*)", 1), F.lit("")))
    return t.tx.withColumn("amount", amount).where("amount IS NOT NULL").groupBy("docket_id").agg(F.sum("amount").alias("spend"), F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, cluster, (floor((epoch_us(min(posted_date)) - any_value(t0)) / 86400000000))::BIGINT AS bar, (floor((epoch_us(max(posted_date)) - epoch_us(min(posted_date))) / 86400000000) + 1)::BIGINT AS width FROM cc, (SELECT epoch_us(min(posted_date)) AS t0 FROM cm) WHERE posted_date IS NOT NULL AND cluster <> -1 GROUP BY 1, 2")
def db26_burst_bars(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    start = t.cm.agg(us(F.min("posted_date")).alias("t0"))
    c = t.cc.where("posted_date IS NOT NULL AND cluster <> -1").groupBy(*BY).agg(us(F.min("posted_date")).alias("a"), us(F.max("posted_date")).alias("b"))
    day = 86_400_000_000
    return c.crossJoin(F.broadcast(start)).select(*BY, F.floor((F.col("a") - F.col("t0")) / day).alias("bar"), (F.floor((F.col("b") - F.col("a")) / day) + 1).alias("width"))  # start is one row


@query(f", {SCORED} SELECT docket_id, run_id, grouping(run_id)::INT AS total, count(*) AS n, sum(n_comments)::BIGINT AS volume FROM sd GROUP BY ROLLUP (docket_id, run_id)")
def ag21b_rollup_levels(t: Tables) -> DataFrame:
    return t.scored.rollup("docket_id", "run_id").agg(F.grouping("run_id").cast("int").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("n_comments").alias("volume"))
