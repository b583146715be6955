"""A labelled synthetic corpus: organic texts over two months and campaigns in bursts, all by hash, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster.functions.fixed import CAMPAIGNS

START = "2025-06-01 00:00:00"
_SEEDS = {
    "industry_template_a": "Heavy rules on networks raise prices and slow new service for every family in our town so please keep them light",
    "lead_gen_firm_b": "My credit was harmed by a mistake and no one at the company answered my letters about the charge for months",
    "bot_network_c": "The proposed rule takes away our freedom to choose and must be stopped before it does more damage to people",
    "student_script_d": "As a student with loans I ask you to keep the protections that help young people start their working lives",
}
_SWAP = (("rules", "regulations"), ("prices", "costs"), ("family", "household"), ("mistake", "error"), ("answered", "replied to"), ("rule", "regulation"), ("stopped", "halted"), ("people", "citizens"), ("protections", "safeguards"), ("help", "let"))
_OPEN = ("I am writing because", "Please note that", "As a resident I find that", "It seems to me that", "For years now")
_MID = ("the office is slow", "my street has changed", "the bus comes late", "the school needs repair", "our river is low", "the clinic closed early", "the library opened again", "the market moved away")
_END = ("and something should be done.", "and I hope you read this.", "which worries my neighbours.", "as anyone here will tell you.", "and that is all I have to say.")


def _pick(options: tuple, *seed: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(*[s if isinstance(s, Column) else F.lit(s) for s in seed]), F.lit(len(options))) + 1).cast("int"))


def corpus(spark: SparkSession, n_organic: int = 400, seed: int = 42, docket: str = "SYNTHETIC") -> DataFrame:
    """(id, docket_id, text, organization, state_prov, posted_date, label)."""
    i = F.col("id").cast("string")
    at = F.lit(START).cast("timestamp")
    share = lambda s: F.pmod(F.xxhash64(i, F.lit(s), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    states = ("CA", "NY", "TX", "OH", "WA", "MA", "VA", "IL")
    sentence = lambda k: F.concat_ws(" ", _pick(_OPEN, i, f"o{k}{seed}"), _pick(_MID, i, f"m{k}{seed}"), F.lit("in"), F.concat(F.lit("year "), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(900)).cast("string")), _pick(_END, i, f"e{k}{seed}"))
    organic = spark.range(n_organic).select(
        F.concat(F.lit(f"{docket}-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cid"), F.concat_ws(" ", *[sentence(k) for k in range(4)]).alias("text"), F.lit(None).cast("string").alias("organization"), _pick(states, i, "s").alias("state_prov"),
        F.timestamp_micros(F.unix_micros(at) + (share("t") * 60 * 86_400_000_000).cast("long")).alias("posted_date"), F.lit("organic").alias("label"),
    )
    parts, start = organic, n_organic
    for label, size, day, hour, minutes, state, org in CAMPAIGNS:
        text = F.lit(_SEEDS[label])
        for k, (a, b) in enumerate(_SWAP):
            text = F.replace(text, F.lit(a), F.when(share(f"w{k}{label}") < 0.3, b).otherwise(a))
        when = F.unix_micros(at) + ((day * 24 + hour) * 3_600_000_000) + (share(f"t{label}") * minutes * 60_000_000).cast("long")
        forced = F.when(share(f"f{label}") < 0.8, F.lit(state)).otherwise(_pick(states, i, label)) if state else _pick(states, i, label)
        one = spark.range(start, start + size).select(F.concat(F.lit(f"{docket}-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cid"), text.alias("text"), F.lit(org).cast("string").alias("organization"), forced.alias("state_prov"), F.timestamp_micros(when).alias("posted_date"), F.lit(label).alias("label"))
        parts, start = parts.unionByName(one), start + size
    return parts.select(F.col("cid").alias("id"), F.lit(docket).alias("docket_id"), "text", "organization", "state_prov", "posted_date", "label")


def ground_truth(df: DataFrame) -> DataFrame:
    return df.select("id", "label")


def variants(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: id, cluster; texts: cluster, k (from 0), text. Each member with one of its cluster's variants, by hash."""
    n = texts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    m = members.join(n, "cluster").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")))
    return m.join(texts, ["cluster", "k"]).select("id", "cluster", "text")
