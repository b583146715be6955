"""Sources (SRC), joins (J), windows (WN), order (SO) and sets (SE)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from muster.functions import text as T
from muster.functions.fixed import FUNCTION_WORDS, LEGAL_FORMS, REGISTRY
from muster.functions.stats import ratcliff
from muster.operators import graph
from muster.operators.joins import band_pairs, nearest, ranks_in, similar_sets
from muster.sources import store
from muster.suite.base import Tables, query
from muster.suite.text import ARGS, SHINGLES, VEC

#: Least Ratcliff-Obershelp ratio at which an organisation is a mistyped registry name.
FUZZY = 0.85
MATCH_IDS = "SELECT DISTINCT upper(trim(left_id)) AS id FROM comment_matches WHERE trim(left_id) <> ''"


@query(f"SELECT id FROM ({MATCH_IDS}) WHERE id NOT IN (SELECT id FROM comments WHERE withdrawn)")
def src5_new_ids(t: Tables) -> DataFrame:
    listed = t.comment_matches.where("trim(left_id) <> ''").select(F.upper(F.trim("left_id")).alias("id")).distinct()
    return listed.join(t.comments.where("withdrawn").select("id"), "id", "left_anti")


@query("SELECT id, ingested_at FROM cm")
def src8_first_wins(t: Tables) -> DataFrame:
    none = t.comments.where("1 = 0")
    return store.insert_or_ignore(none, t.comments, "id", "ingested_at").select("id", "ingested_at")


@query("SELECT comment_id, max(embedded_at) AS embedded_at FROM comment_vectors GROUP BY 1")
def src9_last_wins(t: Tables) -> DataFrame:
    v = t.comment_vectors.select("comment_id", "embedded_at")
    return store.insert_or_replace(v.where("1 = 0"), v, "comment_id", "embedded_at")


@query("SELECT id, text, submitter_first, submitter_last, organization, city, state_prov, posted_date FROM tx WHERE docket_id = 'OLRB-2029-0003'")
def src10_comments(t: Tables) -> DataFrame:
    return t.tx.where("docket_id = 'OLRB-2029-0003'").select("id", "text", "submitter_first", "submitter_last", "organization", "city", "state_prov", "posted_date")


@query("SELECT DISTINCT docket_id, id FROM comments")
def src11_ids(t: Tables) -> DataFrame:
    return t.comments.select("docket_id", "id").distinct()


@query("SELECT comment_id, len(embedding) AS dim FROM comment_vectors WHERE embedding IS NOT NULL AND comment_id IN (SELECT id FROM comments WHERE text <> '')")
def src12_vectors(t: Tables) -> DataFrame:
    kept = t.comment_vectors.where("embedding IS NOT NULL").join(t.comments.where("text <> ''").select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
    return kept.select("comment_id", F.size("embedding").cast("long").alias("dim"))


@query("SELECT DISTINCT id FROM comments WHERE id IN (SELECT comment_id FROM comment_vectors)")
def src13_embedded_ids(t: Tables) -> DataFrame:
    return t.comments.select("id").distinct().join(t.comment_vectors.select(F.col("comment_id").alias("id")), "id", "left_semi")


@query("SELECT docket_id, max(id) AS run_id, max_by(n_clusters, id) AS n_clusters FROM analysis_runs GROUP BY 1")
def src15_latest_run(t: Tables) -> DataFrame:
    return t.analysis_runs.groupBy("docket_id").agg(F.max("id").alias("run_id"), F.max_by("n_clusters", "id").alias("n_clusters"))


@query(f", {ARGS}, h AS (SELECT id, substring(md5(array_to_string(list_sort(premises), '||')), 1, 16) AS hash FROM ar), d AS (SELECT DISTINCT hash, docket_id FROM h JOIN cm USING (id)) SELECT a.hash, a.docket_id, b.docket_id AS other FROM d a JOIN d b ON a.hash = b.hash AND a.docket_id <> b.docket_id")
def src17_cross_docket(t: Tables) -> DataFrame:
    d = t.ar.select("id", T.premise_hash(F.col("premises")).alias("hash")).join(t.cm.select("id", "docket_id"), "id").select("hash", "docket_id").distinct()
    return d.join(d.select("hash", F.col("docket_id").alias("other")), "hash").where("docket_id <> other").select("hash", "docket_id", "other")


@query("SELECT run_id, cluster_id, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS paraphrase FROM (SELECT DISTINCT run_id, cluster_id, score_breakdown.paraphrase_reachable AS v FROM clusters)")
def src18_json_safe(t: Tables) -> DataFrame:
    return t.clusters.select("run_id", "cluster_id", store.json_safe(F.col("score_breakdown.paraphrase_reachable")).alias("paraphrase")).distinct()


@query("SELECT comment_id, embedded_at FROM comment_vectors WHERE comment_id IN (SELECT id FROM comments WHERE docket_id <> 'OLRB-2029-0003')")
def src21_delete_docket(t: Tables) -> DataFrame:
    left = t.comments.where("docket_id <> 'OLRB-2029-0003'").select(F.col("id").alias("comment_id"))
    return t.comment_vectors.join(left, "comment_id", "left_semi").select("comment_id", "embedded_at")


@query("SELECT cm.id, v.embedded_at FROM cm JOIN comment_vectors v ON v.comment_id = cm.id")
def j1_comments_vectors(t: Tables) -> DataFrame:
    return t.cm.select("id").join(t.comment_vectors.select(F.col("comment_id").alias("id"), "embedded_at"), "id")


@query(f", {VEC} SELECT tx.id, tx.docket_id FROM tx WHERE id IN (SELECT id FROM ve)")
def j2_aligned(t: Tables) -> DataFrame:
    return t.tx.select("id", "docket_id").join(t.ve.select("id"), "id", "left_semi")


@query("SELECT id FROM cm WHERE id NOT IN (SELECT comment_id FROM comment_vectors)")
def j3_not_embedded(t: Tables) -> DataFrame:
    return t.cm.select("id").join(t.comment_vectors.select(F.col("comment_id").alias("id")), "id", "left_anti")


@query("SELECT a.id AS id_a, b.id AS id_b, abs(epoch_us(a.posted_date) - epoch_us(b.posted_date)) AS gap_us FROM cm a JOIN cm b ON a.id < b.id AND b.posted_date BETWEEN a.posted_date - INTERVAL 60 SECOND AND a.posted_date + INTERVAL 60 SECOND")
def j4_timed_together(t: Tables) -> DataFrame:
    at = t.cm.where("posted_date IS NOT NULL").select("id", F.unix_micros(F.col("posted_date").cast("timestamp")).alias("us"))
    return band_pairs(at, "id", "us", 60)


KEY = r"lower(regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))"


@query(f", k AS (SELECT id, min(id) OVER (PARTITION BY {KEY}) AS g FROM tx), s AS (SELECT g, count(*) AS n FROM k GROUP BY 1 HAVING n >= 2) SELECT g AS group_id, n FROM s")
def j5_templates(t: Tables) -> DataFrame:
    """Groups of equal texts with their size; their pairs follow from them."""
    return t.tx.groupBy(F.md5(T.exact_key(F.col("text"))).alias("k")).agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_id", "n")


META = """mk AS (SELECT id, 'o|' || lower(trim(organization)) AS key FROM cm WHERE trim(organization) <> '' UNION ALL SELECT id, 'n|' || lower(substring(trim(submitter_first), 1, 3)) || '|' || upper(trim(state_prov)) FROM cm WHERE trim(submitter_first) <> '' AND trim(state_prov) <> ''),
ms AS (SELECT *, count(*) OVER (PARTITION BY key) AS g FROM mk),
me AS (SELECT a.id AS src, b.id AS dst, 0.2::DOUBLE / (a.g - 1) AS weight FROM ms a JOIN ms b ON a.key = b.key AND a.id < b.id WHERE a.g BETWEEN 2 AND 50)"""


@query(f", {META} SELECT src, dst, round(weight, 9) AS weight FROM me")
def j6_metadata_pairs(t: Tables) -> DataFrame:
    return graph.metadata_edges(t.cm).select("src", "dst", F.round("weight", 9).alias("weight"))


@query(f", {SHINGLES}, rp AS (SELECT min(id) AS id FROM tx GROUP BY {KEY}), e AS (SELECT id, unnest(g) AS g, len(g) AS n FROM sh JOIN rp USING (id)), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b, round(m / (na + nb - m), 6) AS jaccard FROM p WHERE m / (na + nb - m) >= 0.8")
def j8_similar_texts(t: Tables) -> DataFrame:
    """Exact similarity join of the distinct texts, a class of copies shown by its least id; j5_templates has the classes."""
    first = t.tx.groupBy(F.md5(T.exact_key(F.col("text"))).alias("k")).agg(F.min("id").alias("id")).select("id")
    reps = t.tx.join(first, "id", "left_semi").select("id", F.transform(T.shingles(F.col("text")), lambda x: F.xxhash64(x)).alias("g"))
    return similar_sets(reps, "id", "g", 0.8).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


@query(f", {VEC}, vc AS (SELECT ve.id, v, run_id, cluster FROM ve JOIN lab USING (id) WHERE cluster <> -1), s AS (SELECT run_id, cluster, i, sum(v[i]) AS s FROM vc, range(1, 65) r(i) GROUP BY 1, 2, 3), n AS (SELECT run_id, cluster, count(*) AS n FROM vc GROUP BY 1, 2) SELECT run_id, cluster, any_value(n) AS n, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine FROM s JOIN n USING (run_id, cluster) WHERE n >= 2 GROUP BY 1, 2")
def j9_cluster_cosine(t: Tables) -> DataFrame:
    """Mean cosine over all pairs of a cluster, from the length of the sum of its vectors: no pair is made."""
    vc = t.ve.join(t.lab.where("cluster <> -1"), "id")
    s = vc.select("run_id", "cluster", F.posexplode("v").alias("i", "x")).groupBy("run_id", "cluster", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = s.groupBy("run_id", "cluster").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss")).where("n >= 2")
    return out.select("run_id", "cluster", "n", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


FIXED_REG = "freg AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', '{s}', '{ty}', '{li}')" for k, (n, s, ty, li) in enumerate(REGISTRY)) + ") v(pos, name, sector, type, intensity))"
NORMAL = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(organization), '\b({'|'.join(LEGAL_FORMS)})\b', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
ORGS = f"og AS (SELECT DISTINCT organization, {NORMAL} AS org FROM cm WHERE organization IS NOT NULL)"
#: The fixed registry, then the twenty commonest long names of the corpus itself.
REG = f"{FIXED_REG}, reg AS (SELECT * FROM freg UNION ALL SELECT 100 + row_number() OVER (ORDER BY n DESC, name) - 1, name, CASE WHEN contains(name, 'health') THEN 'health' WHEN contains(name, 'credit') OR contains(name, 'lending') THEN 'finance' ELSE 'local' END, 'local', 'medium' FROM (SELECT {NORMAL} AS name, count(*) AS n FROM cm WHERE organization IS NOT NULL GROUP BY 1 HAVING length(name) >= 15 ORDER BY n DESC, name LIMIT 20))"
RESOLVED = f"{REG}, {ORGS}, rs AS (SELECT organization, min(CASE WHEN org = name THEN pos ELSE 1000 + pos END) % 1000 AS pos, CASE WHEN min(CASE WHEN org = name THEN 0 ELSE 1 END) = 0 THEN 1.0 ELSE 0.95 END AS score FROM og JOIN reg ON org <> '' AND (org = name OR contains(org, name) OR contains(name, org)) GROUP BY organization)"


def registry(t: Tables) -> DataFrame:
    """The fixed registry and the twenty commonest long names of the corpus: 62 rows at most."""
    fixed = t.spark.createDataFrame([(k, *r) for k, r in enumerate(REGISTRY)], "pos int, name string, sector string, type string, intensity string")
    n = t.cm.where("organization IS NOT NULL").groupBy(T.normal_org(F.col("organization")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("length(name) >= 15").orderBy(F.desc("n"), "name").limit(20)
    sector = F.when(F.contains("name", F.lit("health")), "health").when(F.contains("name", F.lit("credit")) | F.contains("name", F.lit("lending")), "finance").otherwise("local")
    local = n.select((F.row_number().over(Window.orderBy(F.desc("n"), "name")) + 99).alias("pos"), "name", sector.alias("sector"), F.lit("local").alias("type"), F.lit("medium").alias("intensity"))
    return fixed.unionByName(local)


def resolved(t: Tables, word_boundary: bool = False) -> DataFrame:
    """(organization, pos, score): each distinct organisation's registry entry, equal first, then the first that contains it or is contained."""
    orgs = t.cm.where("organization IS NOT NULL").select("organization").distinct().withColumn("org", T.normal_org(F.col("organization")))
    if word_boundary:
        pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
        within = T.either_contains(pad("org"), pad("name"))
    else:
        within = T.either_contains(F.col("org"), F.col("name"))
    hit = orgs.join(F.broadcast(registry(t)), (F.col("org") != "") & ((F.col("org") == F.col("name")) | within))
    same = F.col("org") == F.col("name")
    best = hit.groupBy("organization").agg(F.min(F.struct((~same).alias("inexact"), "pos")).alias("m"))
    return best.select("organization", F.col("m.pos").alias("pos"), F.when(F.col("m.inexact"), 0.95).otherwise(1.0).alias("score"))


def fuzzy_resolved(t: Tables) -> DataFrame:
    """resolved(), and for organisations left without an entry the registry name of best ratio from FUZZY on, the first of equals."""
    first = resolved(t)
    left = t.cm.where("organization IS NOT NULL").select("organization").distinct().join(first, "organization", "left_anti").withColumn("org", T.normal_org(F.col("organization"))).where("org <> ''")
    names = left.select("org").distinct().join(F.broadcast(registry(t).select("pos", "name"))).withColumn("score", ratcliff("org", "name")).where(F.col("score") >= FUZZY)
    best = names.groupBy("org").agg(F.max(F.struct("score", (-F.col("pos")).alias("first"))).alias("m"))
    mistyped = left.join(best, "org").select("organization", (-F.col("m.first")).cast("int").alias("pos"), F.col("m.score").alias("score"))
    return first.unionByName(mistyped)


@query(f", {RESOLVED} SELECT organization, pos::INT AS pos, score::DOUBLE AS score FROM rs")
def j12_registry(t: Tables) -> DataFrame:
    """The two exact stages; j12_fuzzy has the third."""
    return resolved(t)


@query()
def j12_fuzzy(t: Tables) -> DataFrame:
    return fuzzy_resolved(t)


@query(f", {RESOLVED} SELECT cm.id, reg.name, reg.sector, reg.intensity FROM cm JOIN rs USING (organization) JOIN reg ON reg.pos = rs.pos")
def j13_attributes(t: Tables) -> DataFrame:
    """By the two exact stages; j13_fuzzy has all three."""
    return attributes(t, resolved(t))


@query()
def j13_fuzzy(t: Tables) -> DataFrame:
    return attributes(t, fuzzy_resolved(t))


def attributes(t: Tables, found: DataFrame) -> DataFrame:
    e = found.join(F.broadcast(registry(t)), "pos").select("organization", "name", "sector", "intensity")
    return t.cm.select("id", "organization").join(e, "organization").select("id", "name", "sector", "intensity")


@query("SELECT cm.id, (rank() OVER (PARTITION BY docket_id ORDER BY posted_date) - 1)::BIGINT AS lo, count(*) OVER (PARTITION BY docket_id ORDER BY posted_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM cm WHERE posted_date IS NOT NULL")
def j15_docket_rank(t: Tables) -> DataFrame:
    return ranks_in(t.cm.where("posted_date IS NOT NULL").select("id", "docket_id", "posted_date"), "docket_id", "posted_date").select("id", F.col("lo").cast("long").alias("lo"), "hi")


@query("SELECT r.id AS run_id, min_by(c.posted_date, abs(epoch_us(c.posted_date) - epoch_us(r.run_at)) * 1e17 + epoch_us(c.posted_date)) AS nearest FROM analysis_runs r JOIN cm c ON c.docket_id = r.docket_id AND c.posted_date IS NOT NULL GROUP BY 1")
def j17_nearest(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = nearest(t.analysis_runs.select("id", "docket_id", "run_at"), t.cm.where("posted_date IS NOT NULL").select("docket_id", "posted_date"), "docket_id", us("run_at"), us("posted_date"), F.col("posted_date"), "nearest")
    return out.where("nearest IS NOT NULL").select(F.col("id").alias("run_id"), "nearest")


FW = "fw AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + "]) AS word)"


@query(rf", {FW}, wd AS (SELECT docket_id, w, count(*) AS n FROM (SELECT docket_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM tx) GROUP BY 1, 2) SELECT d.docket_id, fw.word, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT docket_id FROM tx) d CROSS JOIN fw LEFT JOIN wd ON wd.docket_id = d.docket_id AND wd.w = fw.word")
def j19_function_words(t: Tables) -> DataFrame:
    """Every docket with each of the 70 function words, also those it never uses; the word list is fixed."""
    words = t.tx.select("docket_id", F.explode(T.words(F.col("text"))).alias("word")).where(F.col("word").isin(*FUNCTION_WORDS)).groupBy("docket_id", "word").agg(F.count(F.lit(1)).alias("n"))
    every = t.tx.select("docket_id").distinct().select("docket_id", F.explode(F.array(*map(F.lit, FUNCTION_WORDS))).alias("word"))
    return every.join(words, ["docket_id", "word"], "left").select("docket_id", "word", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l.run_id, l.cluster, l.n, coalesce(c.campaign_score, 0.0) AS score FROM (SELECT run_id, cluster, count(*) AS n FROM lab GROUP BY 1, 2) l LEFT JOIN (SELECT DISTINCT run_id, cluster_id, campaign_score FROM clusters) c ON c.run_id = l.run_id AND c.cluster_id = l.cluster")
def j20_missing_is_zero(t: Tables) -> DataFrame:
    c = t.clusters.select("run_id", F.col("cluster_id").alias("cluster"), "campaign_score").distinct()
    return t.lab.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("n")).join(c, ["run_id", "cluster"], "left").select("run_id", "cluster", "n", F.coalesce("campaign_score", F.lit(0.0)).alias("score"))


@query("SELECT id, (epoch_us(posted_date) - lag(epoch_us(posted_date)) OVER w) / 1e6 AS d1 FROM cm WHERE posted_date IS NOT NULL WINDOW w AS (PARTITION BY docket_id ORDER BY posted_date, id)")
def wn2_differences(t: Tables) -> DataFrame:
    w = Window.partitionBy("docket_id").orderBy("posted_date", "id")
    us = F.unix_micros(F.col("posted_date").cast("timestamp"))
    return t.cm.where("posted_date IS NOT NULL").select("id", ((us - F.lag(us).over(w)) / 1e6).alias("d1"))


@query("SELECT run_id, cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster ORDER BY id) AS k FROM lab) WHERE k <= 5")
def wn4_first_five(t: Tables) -> DataFrame:
    return t.lab.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "cluster").orderBy("id"))).where("k <= 5").select("run_id", "cluster", "id")


@query("SELECT id, count(*) OVER (PARTITION BY docket_id ORDER BY epoch_us(posted_date) RANGE BETWEEN CURRENT ROW AND 60000000 FOLLOWING) AS n FROM cm WHERE posted_date IS NOT NULL")
def wn6_next_minute(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("posted_date").cast("timestamp"))
    w = Window.partitionBy("docket_id").orderBy("us").rangeBetween(0, 60_000_000)
    return t.cm.where("posted_date IS NOT NULL").withColumn("us", us).select("id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT day, round(sum(n) OVER (ORDER BY day) / sum(n) OVER (), 6) AS share FROM (SELECT strftime(posted_date, '%Y-%m-%d') AS day, count(*) AS n FROM cm WHERE posted_date IS NOT NULL GROUP BY 1)")
def wn7_cumulative(t: Tables) -> DataFrame:
    days = t.cm.where("posted_date IS NOT NULL").groupBy(F.date_format("posted_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return days.select("day", F.round(F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("SELECT bar, sum(n)::BIGINT AS n, bool_or(n > 40) AS burst FROM (SELECT (row_number() OVER (ORDER BY h) - 1) // 24 AS bar, n FROM (SELECT date_trunc('hour', posted_date) AS h, count(*) AS n FROM cm WHERE posted_date IS NOT NULL GROUP BY 1)) GROUP BY 1")
def wn8_rebinned(t: Tables) -> DataFrame:
    hours = t.cm.where("posted_date IS NOT NULL").groupBy(F.date_trunc("hour", "posted_date").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    bar = F.floor((F.row_number().over(Window.orderBy("h")) - 1) / 24)  # one row an hour
    return hours.withColumn("bar", bar).groupBy("bar").agg(F.sum("n").alias("n"), F.bool_or(F.col("n") > 40).alias("burst"))


@query()
def wn9_batches(t: Tables) -> DataFrame:
    """Greedy batches of at most 128 rows and 25,000 estimated tokens, within each partition in order of id."""

    def run(frames):
        batch, rows, tokens = 0, 0, 0
        for pdf in frames:
            out = []
            for n in pdf["n_tokens"]:
                if rows and (rows >= 128 or tokens + n > 25_000):
                    batch, rows, tokens = batch + 1, 0, 0
                rows, tokens = rows + 1, tokens + n
                out.append(batch)
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": pdf["n_tokens"], "batch": out})

    sized = t.tx.select("id", T.token_estimate(F.col("text")).alias("n_tokens")).repartitionByRange("id").sortWithinPartitions("id")
    return sized.mapInPandas(run, "id string, n_tokens int, batch long")


@query(f", {SHINGLES} SELECT shingle, count(*) AS n FROM (SELECT unnest(g) AS shingle FROM sh) GROUP BY 1 HAVING count(*) >= 2")
def wn10_shared_shingles(t: Tables) -> DataFrame:
    """Shingles that more than one text has."""
    return t.tx.select(F.explode(T.shingles(F.col("text"))).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT run_id, cluster, count(*) AS n FROM lab WHERE cluster <> -1 GROUP BY 1, 2 HAVING n >= 15 ORDER BY n DESC, run_id, cluster LIMIT 30")
def so1_largest(t: Tables) -> DataFrame:
    return t.lab.where("cluster <> -1").groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("n")).where("n >= 15").orderBy(F.desc("n"), "run_id", "cluster").limit(30)


@query("SELECT docket_id, state, n FROM (SELECT *, row_number() OVER (PARTITION BY docket_id ORDER BY n DESC, first) AS k FROM (SELECT docket_id, upper(trim(state_prov)) AS state, count(*) AS n, min(id) AS first FROM cm WHERE trim(state_prov) <> '' GROUP BY 1, 2)) WHERE k <= 3")
def so2_most_common(t: Tables) -> DataFrame:
    n = t.cm.where("trim(state_prov) <> ''").groupBy("docket_id", F.upper(F.trim("state_prov")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    k = F.row_number().over(Window.partitionBy("docket_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("k", k).where("k <= 3").select("docket_id", "state", "n")


@query("SELECT id, posted_date FROM cm WHERE posted_date IS NOT NULL ORDER BY posted_date, id LIMIT 100")
def so3_limit(t: Tables) -> DataFrame:
    return t.cm.where("posted_date IS NOT NULL").select("id", "posted_date").orderBy("posted_date", "id").limit(100)


@query("SELECT max(id) AS run_id FROM analysis_runs")
def so4_latest(t: Tables) -> DataFrame:
    return t.analysis_runs.agg(F.max("id").alias("run_id"))


@query("SELECT run_id, cluster_id, n_comments FROM (SELECT DISTINCT run_id, cluster_id, n_comments FROM clusters) ORDER BY n_comments DESC, run_id, cluster_id")
def so5_sorted(t: Tables) -> DataFrame:
    return t.clusters.select("run_id", "cluster_id", "n_comments").distinct().orderBy(F.desc("n_comments"), "run_id", "cluster_id")


@query("SELECT id FROM cm ORDER BY md5(id), id LIMIT 150")
def so6_sample(t: Tables) -> DataFrame:
    """A sample without replacement that is the same in every run: the least hashes."""
    return t.cm.select("id").orderBy(F.md5("id"), "id").limit(150)


@query("SELECT id, 'both' AS side FROM cm WHERE id IN (SELECT comment_id FROM comment_vectors) UNION ALL SELECT id, 'comments' FROM cm WHERE id NOT IN (SELECT comment_id FROM comment_vectors)")
def se1_sets(t: Tables) -> DataFrame:
    c, v = t.cm.select("id"), t.comment_vectors.select(F.col("comment_id").alias("id")).distinct()
    return c.intersect(v).withColumn("side", F.lit("both")).unionByName(c.exceptAll(v).withColumn("side", F.lit("comments")))


@query("SELECT id, 'vector' AS source FROM (SELECT DISTINCT comment_id AS id FROM comment_vectors) UNION ALL SELECT DISTINCT id, 'label' FROM lab")
def se2_union(t: Tables) -> DataFrame:
    return t.comment_vectors.select(F.col("comment_id").alias("id")).distinct().withColumn("source", F.lit("vector")).unionByName(t.lab.select("id").distinct().withColumn("source", F.lit("label")))


@query(r"""WITH RECURSIVE e0 AS (SELECT upper(trim(left_id)) AS a, upper(trim(right_id)) AS b FROM comment_matches WHERE upper(trim(left_id)) <> upper(trim(right_id)) AND trim(left_id) <> '' AND trim(right_id) <> '' AND method = 'text'),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.g FROM reach r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id, min(g) AS group_id FROM reach GROUP BY id""")
def se3_components(t: Tables) -> DataFrame:
    e = t.comment_matches.where("method = 'text' AND trim(left_id) <> '' AND trim(right_id) <> ''").select(F.upper(F.trim("left_id")).alias("a"), F.upper(F.trim("right_id")).alias("b"))
    return graph.components(e, "a", "b")
