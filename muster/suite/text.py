"""Scalar functions and text projections (FN)."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from muster.functions import text as T
from muster.functions.fixed import LEGAL_FORMS
from muster.functions.stats import chi2_sf_df1, chi2_sf_df19, ratcliff
from muster.suite.base import Tables, query, view

STRIP = r"regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '[\s\x{00A0}]+'), x -> x <> '')"
SHINGLES = f"sh AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), i -> array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM (SELECT id, {TOKENS} AS w FROM tx))"


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS cleaned FROM cm WHERE text IS NOT NULL""")
def fn1_clean(t: Tables) -> DataFrame:
    return t.cm.where(F.col("text").isNotNull()).select("id", T.clean_html(F.col("text")).alias("cleaned"))


@query(f", {SHINGLES} SELECT id, len(g) AS n, list_min(g) AS first_shingle FROM sh")
def fn2_shingles(t: Tables) -> DataFrame:
    g = T.shingles(F.col("text"))
    return t.tx.select("id", F.size(g).cast("long").alias("n"), F.array_min(g).alias("first_shingle"))


@query(f"SELECT id, md5(lower({STRIP.format('text')})) AS exact_key FROM tx")
def fn3_exact_key(t: Tables) -> DataFrame:
    return t.tx.select("id", F.md5(T.exact_key(F.col("text"))).alias("exact_key"))


NORMAL_ORG = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(organization), '\b({'|'.join(LEGAL_FORMS)})\b', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT id, {NORMAL_ORG} AS org FROM cm WHERE organization IS NOT NULL")
def fn4_org(t: Tables) -> DataFrame:
    return t.cm.where("organization IS NOT NULL").select("id", T.normal_org(F.col("organization")).alias("org"))


STATE = "nullif(upper(" + STRIP.format("coalesce(state_prov, '')") + "), '')"
CITY = STRIP.format("coalesce(city, '')")


@query(f"SELECT id, CASE WHEN {STATE} IS NULL THEN NULL WHEN {CITY} = '' THEN {STATE} ELSE {CITY} || ', ' || {STATE} END AS location FROM cm")
def fn5_location(t: Tables) -> DataFrame:
    return t.cm.select("id", T.location_key(F.col("city"), F.col("state_prov")).alias("location"))


@query(f"SELECT id, {STATE} AS state FROM cm")
def fn6_state(t: Tables) -> DataFrame:
    return t.cm.select("id", T.normal_state(F.col("state_prov")).alias("state"))


@query("SELECT id, epoch_us(posted_date) / 1e6 AS unix_s FROM cm")
def fn7_unix(t: Tables) -> DataFrame:
    return t.cm.select("id", (F.unix_micros(F.col("posted_date").cast("timestamp")) / 1e6).alias("unix_s"))


@query("SELECT id, strftime(posted_date, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM cm")
def fn8_iso(t: Tables) -> DataFrame:
    return t.cm.select("id", F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT id, greatest(1, floor(length(substring(text, 1, 4000)) / 4)::INT) AS n_tokens FROM tx")
def fn9_token_estimate(t: Tables) -> DataFrame:
    return t.tx.select("id", T.token_estimate(F.col("text")).alias("n_tokens"))


#: Argument structures made from the texts: premises are the first three sentences, the rest follows from words in them.
ARGS = r"""ar AS (SELECT id, run_id, cluster, list_transform(list_filter(string_split_regex(text, '[.!?]+[\s\x{00A0}]+'), s -> regexp_replace(s, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') <> '')[1:3], s -> lower(regexp_replace(s, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))) AS premises,
 CASE WHEN regexp_matches(lower(text), 'drop|repeal|withdraw') THEN 'oppose' WHEN regexp_matches(lower(text), 'extend|fund|keep') THEN 'support' END AS position,
 list_filter([CASE WHEN contains(text, '$') THEN 'economic' END, CASE WHEN regexp_matches(lower(text), 'law|court|statut') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), '\bmy\b') THEN 'anecdotal' END], x -> x IS NOT NULL) AS evidence,
 lower(regexp_extract(text, '(?i)(board|agency|bureau|commission|department|drafting team|office)', 1)) AS target FROM tc)"""


@view
def ar(t: Tables) -> DataFrame:
    text, low = F.col("text"), F.lower("text")
    first = F.slice(T.sentences(text), 1, 3)
    evidence = F.array(F.when(F.contains(text, F.lit("$")), "economic"), F.when(low.rlike("law|court|statut"), "legal"), F.when(low.rlike(r"\bmy\b"), "anecdotal"))
    return t.tc.select(
        "id", "run_id", "cluster",
        F.transform(first, lambda s: F.lower(T.strip(s))).alias("premises"),
        F.when(low.rlike("drop|repeal|withdraw"), "oppose").when(low.rlike("extend|fund|keep"), "support").alias("position"),
        F.filter(evidence, lambda x: x.isNotNull()).alias("evidence"),
        F.lower(F.regexp_extract("text", r"(?i)(board|agency|bureau|commission|department|drafting team|office)", 1)).alias("target"),
    )


@query(f", {ARGS} SELECT id, substring(md5(array_to_string(list_sort(premises), '||')), 1, 16) AS argument_hash FROM ar")
def fn10_premise_hash(t: Tables) -> DataFrame:
    return t.ar.select("id", T.premise_hash(F.col("premises")).alias("argument_hash"))


@query(r"SELECT id, regexp_extract('note: ' || coalesce(results_json, '') || ' end', '(?s)(\{.*\})', 1) AS block FROM analysis_runs")
def fn11_json_block(t: Tables) -> DataFrame:
    return t.analysis_runs.select("id", F.regexp_extract(F.concat(F.lit("note: "), F.coalesce("results_json", F.lit("")), F.lit(" end")), r"(?s)(\{.*\})", 1).alias("block"))


@query("SELECT id, (params_json->>'min_cluster')::INT AS min_cluster, (params_json->>'neighbors')::INT AS neighbors, (results_json->>'noise')::INT AS noise FROM analysis_runs WHERE params_json IS NOT NULL AND json_valid(params_json)")
def fn12_parse_json(t: Tables) -> DataFrame:
    p, r = F.from_json("params_json", "min_cluster int, neighbors int"), F.from_json("results_json", "noise int")
    return t.analysis_runs.where("params_json IS NOT NULL").select("id", p["min_cluster"].alias("min_cluster"), p["neighbors"].alias("neighbors"), r["noise"].alias("noise"))


@query("SELECT docket_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT docket_id, n / sum(n) OVER (PARTITION BY docket_id) AS p FROM (SELECT docket_id, title, count(*) AS n FROM cm GROUP BY 1, 2)) GROUP BY 1")
def fn13_entropy(t: Tables) -> DataFrame:
    n = t.cm.groupBy("docket_id", "title").agg(F.count(F.lit(1)).alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N needs no list
    return n.groupBy("docket_id").agg(F.round(F.greatest(F.lit(0.0), F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")), 6).alias("entropy"))


@query("SELECT id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(text) - 1), i -> substring(lower(text), i, 3))) AS g FROM tx) GROUP BY 1, 2)) GROUP BY 1")
def fn14_trigram_entropy(t: Tables) -> DataFrame:
    grams = T.let(F.lower("text"), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))
    n = t.tx.select("id", F.explode(grams).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N needs no list
    return n.groupBy("id").agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy"))


VEC = """vv AS (SELECT comment_id AS id, embedding, embedded_at FROM comment_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, x -> x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(embedding, x -> x * x)) > 0),
ve AS (SELECT id, list_transform(embedding, x -> x::DOUBLE / (sqrt(list_sum(list_transform(embedding, y -> y::DOUBLE * y::DOUBLE))) + 1e-12)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY embedded_at DESC) AS rn FROM vv) WHERE rn = 1)"""


@view
def ve(t: Tables) -> DataFrame:
    """One usable vector of length one for each id, the last embedded."""
    from pyspark.sql import Window

    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = t.comment_vectors.where(e.isNotNull() & (F.size(e) == 64)).where(~bad & F.exists(e, lambda x: x != 0))
    last = Window.partitionBy("comment_id").orderBy(F.col("embedded_at").desc())
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(F.col("comment_id").alias("id"), T.unit(e).alias("v"))


@query(f", {VEC} SELECT id, round(v[1], 6) AS v1, round(v[64], 6) AS v64, round(sqrt(list_sum(list_transform(v, x -> x * x))), 6) AS norm FROM ve")
def fn15_unit(t: Tables) -> DataFrame:
    return t.ve.select("id", F.round(F.element_at("v", 1), 6).alias("v1"), F.round(F.element_at("v", 64), 6).alias("v64"), F.round(F.sqrt(T.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


@query(f", {VEC} SELECT match_id, round(list_sum(list_transform(range(1, 65), i -> a.v[i] * b.v[i])), 6) AS cosine FROM comment_matches m JOIN ve a ON a.id = m.left_id JOIN ve b ON b.id = m.right_id")
def fn16_cosine(t: Tables) -> DataFrame:
    a, b = t.ve.select(F.col("id").alias("left_id"), F.col("v").alias("va")), t.ve.select(F.col("id").alias("right_id"), F.col("v").alias("vb"))
    return t.comment_matches.join(a, "left_id").join(b, "right_id").select("match_id", F.round(T.dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query(f", {SHINGLES} SELECT match_id, round(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END, 6) AS jaccard FROM comment_matches m JOIN sh a ON a.id = m.left_id JOIN sh b ON b.id = m.right_id")
def fn17_jaccard(t: Tables) -> DataFrame:
    g = t.tx.select("id", T.shingles(F.col("text")).alias("g"))
    a, b = g.select(F.col("id").alias("left_id"), F.col("g").alias("ga")), g.select(F.col("id").alias("right_id"), F.col("g").alias("gb"))
    return t.comment_matches.join(a, "left_id").join(b, "right_id").select("match_id", F.round(T.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


@query("SELECT p.place_id, s.state_code, contains(p.state_name, s.state_name) OR contains(s.state_name, p.state_name) AS related FROM places p CROSS JOIN states s WHERE contains(p.state_name, s.state_name) OR contains(s.state_name, p.state_name)")
def fn18_either_contains(t: Tables) -> DataFrame:
    s = F.broadcast(t.states.withColumnRenamed("state_name", "other"))  # 20 rows, fixed
    related = T.either_contains(F.col("state_name"), F.col("other"))
    return t.places.select("place_id", "state_name").join(s.select("state_code", "other"), related).select("place_id", "state_code", related.alias("related"))


@query()
def fn19_ratio(t: Tables) -> DataFrame:
    orgs = t.cm.where("organization IS NOT NULL").select(T.normal_org(F.col("organization")).alias("org")).where("org <> ''").distinct()
    return orgs.select("org", F.round(ratcliff("org", F.lit("chamber of commerce of the united states")), 6).alias("ratio"))


@query("SELECT run_id, cluster_id, greatest(0.0, least(1.0, campaign_score * 2)) AS clip1, greatest(0.0, least(0.95, campaign_score * 2)) AS clip95 FROM (SELECT DISTINCT run_id, cluster_id, campaign_score FROM clusters WHERE campaign_score IS NOT NULL)")
def fn20_clip(t: Tables) -> DataFrame:
    x = F.col("campaign_score") * 2
    c = t.clusters.select("run_id", "cluster_id", "campaign_score").where("campaign_score IS NOT NULL").distinct()
    return c.select("run_id", "cluster_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).alias("clip1"), F.greatest(F.lit(0.0), F.least(F.lit(0.95), x)).alias("clip95"))


@query()
def fn21_chi2_df1(t: Tables) -> DataFrame:
    return t.clusters.select("run_id", "cluster_id", chi2_sf_df1(F.coalesce(T.finite(F.col("score_breakdown.temporal_coupling")), F.lit(0.0))).alias("p"))


@query()
def fn22_chi2_df19(t: Tables) -> DataFrame:
    return t.clusters.select("run_id", "cluster_id", chi2_sf_df19(F.coalesce(T.finite(F.col("score_breakdown.stylometric")), F.lit(0.0))).alias("p"))


@query("SELECT run_id, cluster_id, round(center_x, 2) AS x2, round(center_y, 3) AS y3 FROM (SELECT DISTINCT run_id, cluster_id, center_x, center_y FROM clusters)")
def fn23_round(t: Tables) -> DataFrame:
    return t.clusters.select("run_id", "cluster_id", "center_x", "center_y").distinct().select("run_id", "cluster_id", F.round("center_x", 2).alias("x2"), F.round("center_y", 3).alias("y3"))


@query("SELECT id, substring(text, 1, 200) AS t200, substring(text, 1, 1000) AS t1000 FROM tx")
def fn24_truncate(t: Tables) -> DataFrame:
    return t.tx.select("id", F.substring("text", 1, 200).alias("t200"), F.substring("text", 1, 1000).alias("t1000"))


@F.pandas_udf(DoubleType())
def zlib_ratio(s: pd.Series) -> pd.Series:
    raw = [x.encode() for x in s]
    return pd.Series([len(zlib.compress(b)) / len(b) if b else 0.0 for b in raw])


@query()
def fn25_zlib(t: Tables) -> DataFrame:
    return t.tx.select("id", zlib_ratio("text").alias("ratio"))


@query(r"SELECT id, CASE WHEN regexp_matches(text, '\$[0-9]') THEN replace(regexp_extract(text, '\$([0-9][0-9,]*)', 1), ',', '')::DOUBLE END AS amount FROM tx")
def fn26_dollars(t: Tables) -> DataFrame:
    found = F.regexp_extract("text", r"(\$[0-9][0-9,]*)", 1)
    return t.tx.select("id", T.dollars(F.nullif(found, F.lit(""))).alias("amount"))


@query(r"SELECT DISTINCT organization, upper(array_to_string(list_transform(list_filter(string_split_regex(lower(organization), '[^a-z]+'), x -> length(x) >= 3 AND x NOT IN ('of', 'the', 'and', 'for')), x -> substring(x, 1, 1))[1:6], '')) AS acronym FROM cm WHERE organization IS NOT NULL")
def fn27_acronym(t: Tables) -> DataFrame:
    return t.cm.where("organization IS NOT NULL").select("organization").distinct().select("organization", T.acronym(F.col("organization")).alias("acronym"))


#: Categories of a text by the first of six patterns that matches.
CATEGORY_RULES = (("bank|loan|credit", "BANKING"), ("rent|tenant|housing", "HOUSING"), ("energy|power|grid", "ENERGY"), ("patient|clinic|hospital", "HEALTH"), ("school|student|teacher", "EDUCATION"), ("truck|transit|freight", "TRANSPORT"))


@query("SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{c}'" for p, c in CATEGORY_RULES) + " ELSE 'OTHER' END AS category FROM tx")
def fn28_category(t: Tables) -> DataFrame:
    c = F.lit("OTHER")
    for p, name in reversed(CATEGORY_RULES):
        c = F.when(F.lower("text").rlike(p), name).otherwise(c)
    return t.tx.select("id", c.alias("category"))


@query(r"SELECT id, CASE WHEN length(s) > 110 THEN substring(s, 1, 107) || '...' ELSE s END AS headline FROM (SELECT id, coalesce(nullif(title, ''), string_split_regex(text, '[.!?]')[1]) AS s FROM tx)")
def fn29_headline(t: Tables) -> DataFrame:
    s = F.coalesce(F.nullif("title", F.lit("")), F.element_at(F.split("text", "[.!?]"), 1))
    return t.tx.select("id", F.when(F.length(s) > 110, F.concat(F.substring(s, 1, 107), F.lit("..."))).otherwise(s).alias("headline"))


@query("SELECT id, upper(strftime(posted_date, '%a %H:%M')) AS peak FROM cm WHERE posted_date IS NOT NULL")
def fn30_weekday(t: Tables) -> DataFrame:
    return t.cm.where("posted_date IS NOT NULL").select("id", F.upper(F.date_format("posted_date", "EEE HH:mm")).alias("peak"))


@query("SELECT run_id, cluster_id, round((center_x - min(center_x) OVER ()) / (max(center_x) OVER () - min(center_x) OVER ()), 6) AS sx FROM (SELECT DISTINCT run_id, cluster_id, center_x FROM clusters WHERE center_x IS NOT NULL)")
def fn31_minmax(t: Tables) -> DataFrame:
    c = t.clusters.where("center_x IS NOT NULL").select("run_id", "cluster_id", "center_x").distinct()
    ends = c.agg(F.min("center_x").alias("lo"), F.max("center_x").alias("hi"))
    return c.crossJoin(F.broadcast(ends)).select("run_id", "cluster_id", F.round((F.col("center_x") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("sx"))  # one row


@query("SELECT run_id, cluster_id, least(7, floor(campaign_score * 8))::INT AS level, ['▁','▂','▃','▄','▅','▆','▇','█'][least(7, floor(campaign_score * 8))::INT + 1] AS glyph FROM (SELECT DISTINCT run_id, cluster_id, campaign_score FROM clusters WHERE campaign_score >= 0)")
def fn32_glyph(t: Tables) -> DataFrame:
    level = F.least(F.lit(7), F.floor(F.col("campaign_score") * 8)).cast("int")
    c = t.clusters.where("campaign_score >= 0").select("run_id", "cluster_id", "campaign_score").distinct()
    return c.select("run_id", "cluster_id", level.alias("level"), F.element_at(F.array(*map(F.lit, "▁▂▃▄▅▆▇█")), level + 1).alias("glyph"))


@query("SELECT place_id, CASE WHEN population >= 1e6 THEN round(population / 1e6, 1)::VARCHAR || 'M' WHEN population >= 1e3 THEN round(population / 1e3, 1)::VARCHAR || 'K' ELSE population::VARCHAR END AS compact FROM places")
def fn33_compact(t: Tables) -> DataFrame:
    return t.places.select("place_id", T.compact_number(F.col("population")).alias("compact"))


@query("SELECT run_id, cluster_id, CASE WHEN campaign_score >= 0.7 THEN 4 WHEN campaign_score >= 0.5 THEN 3 WHEN campaign_score >= 0.3 THEN 2 WHEN campaign_score >= 0.1 THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT run_id, cluster_id, campaign_score FROM clusters)")
def fn34_level(t: Tables) -> DataFrame:
    s = F.col("campaign_score")
    level = F.when(s >= 0.7, 4).when(s >= 0.5, 3).when(s >= 0.3, 2).when(s >= 0.1, 1).otherwise(0)
    return t.clusters.select("run_id", "cluster_id", "campaign_score").distinct().select("run_id", "cluster_id", level.alias("level"))
