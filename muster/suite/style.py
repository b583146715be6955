"""Style features (ST), the style signal (AG9) and surprisal (ML13, AG12, AG13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from muster.functions import text as T
from muster.functions.fixed import DISCOURSE_MARKERS, FUNCTION_WORDS, GENERATED_WORDS, MARKS
from muster.operators import style
from muster.plans.lineage import cut
from muster.suite.base import Tables, nested, query, view
from muster.suite.text import zlib_ratio

BY = ["run_id", "cluster"]
_quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_marks = ", ".join(f"length(text) - length(replace(text, '{m.replace(chr(39), chr(39) * 2)}', ''))" for m in MARKS)
FEATS = rf"""wd AS (SELECT id, text, regexp_extract_all(lower(text), '\p{{L}}+') AS w, list_transform(list_filter(string_split_regex(text, '[.!?]+[\s\x{{00A0}}]+'), s -> regexp_replace(s, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') <> ''), s -> len(regexp_extract_all(lower(s), '\p{{L}}+'))::DOUBLE) AS sl, [{_marks}] AS mk FROM tx),
wn AS (SELECT *, len(w)::DOUBLE AS n, greatest(1.0, len(sl)::DOUBLE) AS sn, list_avg(sl) AS sm, sqrt(list_avg(list_transform(sl, x -> (x - list_avg(sl)) * (x - list_avg(sl))))) AS sd, list_sum(list_transform(w, x -> length(x)))::DOUBLE AS letters, list_sum(list_transform(w, x -> greatest(1, len(regexp_extract_all(x, '[aeiouy]+')))))::DOUBLE AS syl, len(list_filter(w, x -> len(regexp_extract_all(x, '[aeiouy]+')) >= 3))::DOUBLE AS hard, list_sum(mk)::DOUBLE AS mt FROM wd WHERE len(w) > 0),
ft AS (SELECT id, CASE WHEN len(sl) < 2 OR sd + sm = 0 THEN 0.0 ELSE (sd - sm) / (sd + sm) END AS burstiness_sent, CASE WHEN len(sl) < 2 OR sm = 0 THEN 0.0 ELSE sd / sm END AS sent_len_cv, len(list_distinct(w)) / n AS ttr, letters / n AS avg_word_len,
 CASE WHEN mt > 0 THEN 0.0 - list_sum(list_transform(list_filter(mk, x -> x > 0), x -> x / mt * log2(x / mt))) ELSE 0.0 END AS punct_entropy, (length(text) - length(replace(text, '—', ''))) / n AS emdash_rate, 0.39 * n / sn + 11.8 * syl / n - 15.59 AS flesch_kincaid, 5.8 * letters / n - 29.6 * sn / n - 15.8 AS coleman_liau, 0.4 * (n / sn + 100 * hard / n) AS gunning_fog,
 len(list_filter(w, x -> x IN ({_quoted(DISCOURSE_MARKERS)}))) / n AS discourse_marker_rate, len(list_filter(w, x -> x IN ({_quoted(GENERATED_WORDS)}))) / n AS llmism_rate FROM wn)"""


@view
def feats(t: Tables) -> DataFrame:
    return style.features(t.tx.select("id", "text"))


_ROW_FEATURES = {"st1_burstiness_sent": "burstiness_sent", "st2_sent_len_cv": "sent_len_cv", "st6_ttr": "ttr", "st7_avg_word_len": "avg_word_len", "st9_punct_entropy": "punct_entropy", "st10_emdash_rate": "emdash_rate", "st12_flesch_kincaid": "flesch_kincaid", "st13_coleman_liau": "coleman_liau", "st14_gunning_fog": "gunning_fog", "st17_discourse_marker_rate": "discourse_marker_rate", "st18_llmism_rate": "llmism_rate"}


def _feature(col: str):
    return lambda t: t.feats.select("id", F.round(col, 6).alias(col))


for _key, _col in _ROW_FEATURES.items():
    query(f", {FEATS} SELECT id, round({_col}, 6) AS {_col} FROM ft", name=_key)(_feature(_col))

COUNTS = r"wc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM tx) GROUP BY 1, 2)"


@query()
def st3_mtld(t: Tables) -> DataFrame:
    return t.feats.select("id", style.mtld("w").alias("mtld"))


@query(f", {COUNTS} SELECT id, round(10000 * (sum(c * c) - sum(c)) / (sum(c) * sum(c)), 6) AS yule_k FROM wc GROUP BY 1 HAVING sum(c) >= 10")
def st4_yule_k(t: Tables) -> DataFrame:
    n = style.word_counts(t.tx.select("id", "text")).groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).where("n >= 10")
    return n.select("id", F.round(10000 * (F.col("q") - F.col("n")) / (F.col("n") * F.col("n")), 6).alias("yule_k"))


@query(f", {COUNTS} SELECT id, round(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) / count(*), 6) AS hapax_ratio FROM wc GROUP BY 1")
def st5_hapax(t: Tables) -> DataFrame:
    return style.word_counts(t.tx.select("id", "text")).groupBy("id").agg(F.round(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)) / F.count(F.lit(1)), 6).alias("hapax_ratio"))


@query("SELECT id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, length(text) - 1), i -> substring(lower(text), i, 3))) AS g FROM tx) GROUP BY 1, 2) GROUP BY 1")
def st8_trigram_entropy(t: Tables) -> DataFrame:
    grams = T.let(F.lower("text"), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))
    n = t.tx.select("id", F.explode(grams).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy("id").agg(F.round(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), 6).alias("entropy"))


FWL = f"({_quoted(FUNCTION_WORDS)})"


@query(rf", wl AS (SELECT id, docket_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM tx), dn AS (SELECT docket_id, count(*) AS dn FROM wl GROUP BY 1), rt AS (SELECT docket_id, w, count(*) / any_value(dn) AS p FROM wl JOIN dn USING (docket_id) WHERE w IN {FWL} GROUP BY 1, 2), sz AS (SELECT id, docket_id, count(*) AS n FROM wl GROUP BY 1, 2), o AS (SELECT id, w, count(*) AS o FROM wl WHERE w IN {FWL} GROUP BY 1, 2) SELECT sz.id, round(sum(CASE WHEN p * n > 0.5 THEN pow(coalesce(o.o, 0) - p * n, 2) / (p * n) ELSE 0 END), 5) AS chi2 FROM sz JOIN rt USING (docket_id) LEFT JOIN o ON o.id = sz.id AND o.w = rt.w GROUP BY 1")
def st11_function_word_chi2(t: Tables) -> DataFrame:
    return style.function_word_chi2(t.tx.select("id", "docket_id", "text"), "docket_id").select("id", F.round("chi2", 5).alias("chi2"))


SENTS = r"list_filter(string_split_regex(text, '[.!?]+[\s\x{00A0}]+'), s -> regexp_replace(s, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') <> '')"


@query(rf", q AS (SELECT id, list_transform({SENTS}, s -> least(200, 1 + length(s) - length(regexp_replace(s, '[,;(\[]', '', 'g')))::DOUBLE) AS d FROM tx) SELECT id, list_sum(d) / len(d) AS depth FROM q WHERE len(d) > 0")
def st15_clause_depth(t: Tables) -> DataFrame:
    """Depth of clauses by commas and brackets, in place of a parser's: one more than the most in a sentence, at most 200."""
    depth = F.transform(T.sentences(F.col("text")), lambda s: F.least(F.lit(200), 1 + F.length(s) - F.length(F.regexp_replace(s, r"[,;(\[]", ""))).cast("double"))
    return t.tx.select("id", depth.alias("d")).where(F.size("d") > 0).select("id", (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("depth"))


_TAGS = "CASE " + " ".join(f"WHEN w IN ({_quoted(ws.split())}) THEN '{tag}'" for tag, ws in reversed(style.CLOSED.items())) + " " + " ".join(f"WHEN w LIKE '%{end}' THEN '{tag}'" for end, tag in style.ENDINGS) + " ELSE 'NOUN' END"


@query(f", {COUNTS}, tg AS (SELECT id, {_TAGS} AS tag, sum(c)::DOUBLE AS c FROM wc GROUP BY 1, 2), q AS (SELECT id, c / sum(c) OVER (PARTITION BY id) AS p FROM tg) SELECT id, round(-sum(p * log2(p)), 6) AS pos_entropy FROM q GROUP BY 1")
def st16_pos_entropy(t: Tables) -> DataFrame:
    return t.feats.select("id", F.round(style.pos_entropy("w"), 6).alias("pos_entropy"))


@query()
def st19_zlib_ratio(t: Tables) -> DataFrame:
    return t.tx.select("id", zlib_ratio("text").alias("zlib_ratio"))


@query(rf", wl AS (SELECT docket_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM tx) SELECT docket_id, w AS word, round(count(*) / (SELECT count(*) FROM wl b WHERE b.docket_id = a.docket_id), 9) AS rate FROM wl a WHERE w IN {FWL} GROUP BY 1, 2")
def st20_baseline(t: Tables) -> DataFrame:
    words = t.tx.select("docket_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("docket_id", "word").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy("docket_id"))
    return words.withColumn("rate", F.round(F.col("c") / n, 9)).where(F.col("word").isin(*FUNCTION_WORDS)).select("docket_id", "word", "rate")


_SCORES = ["duplicate", "temporal_coupling", "stylometric", "argument_identity", "ai_detection", "paraphrase_reachable"]
IMPUTE = "im AS (SELECT DISTINCT run_id, cluster_id, " + ", ".join(f"CASE WHEN isnan(score_breakdown.{c}) OR isinf(score_breakdown.{c}) THEN NULL ELSE score_breakdown.{c} END AS {c}" for c in _SCORES) + " FROM clusters)"


@query(f", {IMPUTE} SELECT run_id, cluster_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM im)) AS {c}" for c in _SCORES) + " FROM im")
def st21_imputed(t: Tables) -> DataFrame:
    """The matrix of the stored signals, which holds missing and non-finite values (the features of texts have none)."""
    c = t.clusters.select("run_id", "cluster_id", *(T.finite(F.col(f"score_breakdown.{c}")).alias(c) for c in _SCORES)).distinct()
    return style.impute(c, _SCORES)


#: The features of the style matrix that SQL has; the two others are the lexical diversity by runs and the compressed size.
STYLE_COLS = ["burstiness_sent", "sent_len_cv", "ttr", "avg_word_len", "punct_entropy", "emdash_rate", "flesch_kincaid", "coleman_liau", "gunning_fog", "discourse_marker_rate", "llmism_rate", "yule_k", "hapax_ratio", "char_entropy", "fw_chi2", "clause_depth", "pos_entropy"]
ALL_COLS = [*STYLE_COLS, "mtld", "zlib_ratio"]
_ADDED = {"yule_k": ("st4_yule_k", "yule_k"), "hapax_ratio": ("st5_hapax", "hapax_ratio"), "char_entropy": ("st8_trigram_entropy", "entropy"), "fw_chi2": ("st11_function_word_chi2", "chi2"), "clause_depth": ("st15_clause_depth", "depth"), "pos_entropy": ("st16_pos_entropy", "pos_entropy")}
MATRIX = f"{FEATS}, " + ", ".join(f"a_{k} AS ({nested(q)})" for k, (q, _) in _ADDED.items()) + ", mx AS (SELECT ft.*, " + ", ".join(f"coalesce(a_{k}.{c}, 0.0) AS {k}" for k, (_, c) in _ADDED.items()) + " FROM ft " + " ".join(f"LEFT JOIN a_{k} ON a_{k}.id = ft.id" for k in _ADDED) + ")"


def text_matrix(t: Tables, more: bool) -> DataFrame:
    """Each text's features are worked out once and kept, as what stands on them reads them several times."""
    f = cut(style.text_features(t.tx.select("id", "docket_id", "text"), "docket_id", more), "features")
    places = {"yule_k": 6, "hapax_ratio": 6, "char_entropy": 6, "pos_entropy": 6}
    m = style.function_words_chi2(f, "docket_id").withColumn("fw_chi2", F.round("chi2", 5))
    return m.select("id", *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in (ALL_COLS if more else STYLE_COLS)])


@view
def matrix(t: Tables) -> DataFrame:
    """(id, the 17 style features that SQL has); a feature a text is too short for is 0."""
    return text_matrix(t, False)


@view
def full_matrix(t: Tables) -> DataFrame:
    return text_matrix(t, True)


@query(f", {MATRIX} SELECT id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9), 5) AS {c}" for c in STYLE_COLS) + " FROM mx")
def st22_standardised(t: Tables) -> DataFrame:
    return style.standardise(t.matrix, STYLE_COLS).select("id", *[F.round(c, 5).alias(c) for c in STYLE_COLS])


TIGHT = f"{MATRIX}, z AS (SELECT id, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9) AS {c}" for c in STYLE_COLS) + " FROM mx), lg AS (" + " UNION ALL ".join(f"SELECT run_id, cluster, '{c}' AS f, {c} AS x FROM z JOIN lab USING (id)" for c in STYLE_COLS) + "), cl AS (SELECT run_id, cluster, f, count(*) AS n, greatest(1e-9, var_pop(x)) AS v FROM lg WHERE cluster <> -1 GROUP BY 1, 2, 3 HAVING count(*) >= 3), rs AS (SELECT c.run_id, c.cluster, c.f, any_value(c.n) AS n, any_value(c.v) AS v, CASE WHEN count(*) FILTER (WHERE l.cluster <> c.cluster) < 5 THEN var_pop(l.x) ELSE var_pop(l.x) FILTER (WHERE l.cluster <> c.cluster) END AS b FROM cl c JOIN lg l ON l.run_id = c.run_id AND l.f = c.f GROUP BY 1, 2, 3)"


@query(f", {TIGHT} SELECT run_id, cluster, any_value(n) AS n, round(least(1.0, any_value(n) / 20.0) * greatest(0.0, least(0.95, 1 - exp(avg(ln(sqrt(v / greatest(1e-6, b)) + 0.01))))), 4) AS style_score FROM rs GROUP BY 1, 2")
def ag9_style(t: Tables) -> DataFrame:
    """By the 17 features that SQL has; ag9_full_style has all 19."""
    z = style.standardise(t.matrix, STYLE_COLS)
    return style.tightness(z.join(t.lab, "id"), STYLE_COLS).select(*BY, "n", "style_score")


@query()
def ag9_full_style(t: Tables) -> DataFrame:
    z = style.standardise(style.impute(t.full_matrix, ALL_COLS), ALL_COLS)
    return style.tightness(z.join(t.lab, "id"), ALL_COLS).select(*BY, "n", "style_score", F.round("chi_stat", 2).alias("chi_stat"), F.round("median_ratio", 4).alias("median_ratio"))


SURP = r"ws AS (SELECT id, unnest(list_zip(range(0, len(w)), w)) AS e FROM (SELECT id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM tx)), wp AS (SELECT id, e[1] AS pos, e[2] AS word, coalesce(lag(e[2]) OVER (PARTITION BY id ORDER BY e[1]), '^') AS prev FROM ws), cp AS (SELECT prev, word, count(*) AS cp FROM wp GROUP BY 1, 2), cw AS (SELECT prev, count(*) AS cw FROM wp GROUP BY 1), vv2 AS (SELECT count(DISTINCT word) AS v FROM cp), sp AS (SELECT id, pos, -log2((cp + 0.1) / (cw + 0.1 * v)) AS s FROM wp JOIN cp USING (prev, word) JOIN cw USING (prev), vv2)"


@query(f", {SURP} SELECT id, count(*) AS n, round(avg(s), 6) AS mean_surprisal FROM sp GROUP BY 1")
def ml13_surprisal(t: Tables) -> DataFrame:
    return style.surprisal(t.tx.select("id", "text")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_surprisal"))


_D = "list_transform(range(1, len({0})), i -> {0}[i + 1] - {0}[i])"
SHAPE = f"{SURP}, q0 AS (SELECT id, list(s ORDER BY pos) AS s FROM sp GROUP BY 1 HAVING count(*) >= 4), q1 AS (SELECT *, {_D.format('s')} AS d1, list_avg(s) AS m, list_var_pop(s) AS v FROM q0), q2 AS (SELECT *, {_D.format('d1')} AS d2 FROM q1), q3 AS (SELECT *, list_avg(d2) AS dm, list_min(d2) AS lo, list_max(d2) AS hi FROM q2), q4 AS (SELECT *, list_transform(d2, x -> CASE WHEN hi > lo THEN least(9, floor((x - lo) / (hi - lo) * 10)) ELSE 0 END) AS bn, list_transform(d2, x -> x - dm) AS dc FROM q3), sf AS (SELECT id, m AS s_mean, v AS s_var, list_avg(list_transform(s, x -> pow(x - m, 3))) / (pow(v, 1.5) + 1e-9) AS s_skew, list_avg(list_transform(s, x -> pow(x - m, 4))) / (v * v + 1e-9) AS s_kurt, list_avg(d1) AS d1_mean, list_var_pop(d1) AS d1_var, list_var_pop(d2) AS d2_var, -list_sum(list_transform(list_filter(list_transform(range(10), b -> len(list_filter(bn, y -> y = b)) / len(bn)), p -> p > 0), p -> p * log2(p))) AS d2_entropy, list_sum(list_transform(range(1, len(dc)), i -> dc[i] * dc[i + 1])) / (list_sum(list_transform(dc, x -> x * x)) + 1e-9) AS d2_ac FROM q4)"
SHAPE_COLS = ["s_mean", "s_var", "s_skew", "s_kurt", "d1_mean", "d1_var", "d2_var", "d2_entropy", "d2_ac"]


@query(f", {SHAPE} SELECT id, " + ", ".join(f"round({c}, 5) AS {c}" for c in SHAPE_COLS) + " FROM sf")
def ag12_surprisal_features(t: Tables) -> DataFrame:
    f = style.surprisal_features(style.surprisal(t.tx.select("id", "text")))
    return f.select("id", *[F.round(c, 5).alias(c) for c in SHAPE_COLS])


@query(f", {SHAPE} SELECT id, round(d2_ac, 6) AS d2_ac FROM sf")
def wn3_autocorrelation(t: Tables) -> DataFrame:
    """Autocorrelation at lag one of the second differences of each text's surprisal."""
    return style.surprisal_features(style.surprisal(t.tx.select("id", "text"))).select("id", F.round("d2_ac", 6).alias("d2_ac"))


GENERATED = f"{SHAPE}, lf AS (" + " UNION ALL ".join(f"SELECT run_id, cluster, '{c}' AS f, {c} AS x FROM sf JOIN lab USING (id)" for c in SHAPE_COLS) + "), bs AS (SELECT run_id, f, stddev_pop(x) + 1e-6 AS b FROM lf GROUP BY 1, 2), cf AS (SELECT run_id, cluster, f, count(*) AS n, avg(x) AS mean, stddev_pop(x) + 1e-9 AS sd FROM lf WHERE cluster <> -1 GROUP BY 1, 2, 3 HAVING count(*) >= 3), ai AS (SELECT run_id, cluster, any_value(n) AS n, round(max(CASE WHEN f = 's_mean' THEN mean END), 3) AS mean_surprisal, round(least(1.0, any_value(n) / 15.0) * greatest(0.0, least(0.95, 1 - exp(avg(ln(sd / b + 0.01))))), 4) AS ai_score FROM cf JOIN bs USING (run_id, f) GROUP BY 1, 2)"


@query(f", {GENERATED} SELECT run_id, cluster, n, mean_surprisal, ai_score, CASE WHEN ai_score > 0.6 THEN 'ai_likely' WHEN ai_score > 0.3 THEN 'uncertain' ELSE 'human_likely' END AS label FROM ai")
def ag13_generated_score(t: Tables) -> DataFrame:
    """How much less each cluster's nine surprisal features vary than its run's, with label; all members and the whole run count, not samples."""
    f = cut(style.surprisal_shapes(t.tx.select("id", "text")), "shapes").join(t.lab, "id")
    s = style.generated_score(f, SHAPE_COLS)
    return s.select("*", F.when(F.col("ai_score") > 0.6, "ai_likely").when(F.col("ai_score") > 0.3, "uncertain").otherwise("human_likely").alias("label"))
