"""SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

P2_FOUND = r"""
WITH RECURSIVE typed AS (
  SELECT nullif(upper(regexp_replace(left_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '') AS a,
         nullif(upper(regexp_replace(right_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '') AS b
  FROM comment_matches),
e AS (SELECT a, b FROM typed WHERE a <> b UNION SELECT b, a FROM typed WHERE a <> b),
reach(id, g) AS (
  SELECT DISTINCT a, a FROM e
  UNION
  SELECT e.b, r.g FROM reach r JOIN e ON e.a = r.id WHERE r.g < e.b)
SELECT id, min(g) AS group_id FROM reach GROUP BY id
"""


_PARTS = ("duplicate", "temporal_coupling", "stylometric", "argument_identity", "ai_detection", "paraphrase_reachable")


def p4_ranking_sql() -> str:
    usable = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN NULL ELSE {c}::DOUBLE END"
    scores = [f"score_breakdown.{p}" for p in _PARTS] + ["campaign_score"]
    rows = " UNION ALL ".join(f"SELECT run_id, cluster_id, {k} AS score, {usable(c)} AS v FROM c" for k, c in enumerate(scores))
    return f"""
WITH c AS (SELECT DISTINCT run_id, cluster_id, score_breakdown, campaign_score FROM clusters),
long AS (SELECT DISTINCT * FROM ({rows}) WHERE v IS NOT NULL),
r AS (SELECT run_id, cluster_id, (rank() OVER (PARTITION BY score ORDER BY v DESC) - 1 + (count(*) OVER (PARTITION BY score, v) + 1) / 2.0) / count(*) OVER (PARTITION BY score) AS r FROM long),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY r) AS k, count(*) OVER (PARTITION BY run_id, cluster_id) AS m FROM r),
tail AS (SELECT run_id, cluster_id, m, (SELECT sum((factorial(m::INT) / (factorial(j::INT) * factorial((m - j)::INT)))::DOUBLE * pow(k.r, j) * pow(1 - k.r, m - j)) FROM range(1, 8) t(j) WHERE j >= k.k AND j <= k.m) AS p FROM k),
sig AS (SELECT run_id, cluster_id, max(m)::INT AS n_scores, least(1.0, min(p) * max(m)) AS p FROM tail GROUP BY 1, 2),
every AS (SELECT DISTINCT run_id, cluster_id FROM c),
a AS (SELECT run_id, cluster_id, coalesce(n_scores, 0) AS n_scores, round(coalesce(p, 1.0), 12) AS significance, round(ln(coalesce(p, 1.0)), 9) AS log_significance FROM every LEFT JOIN sig USING (run_id, cluster_id))
SELECT run_id, cluster_id, n_scores, significance, log_significance, row_number() OVER (ORDER BY log_significance, run_id, cluster_id) AS rank FROM a
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p4_ranking": p4_ranking_sql()}
