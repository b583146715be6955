"""The registry of queries, and the views most of them start from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from muster.functions.text import strip
from muster.plans.lineage import cut
from muster.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The SQL of each query after the common table expressions of BASE.
BODY: dict[str, str] = {}


def nested(key: str) -> str:
    """The SQL of a query for use as a table expression of another."""
    body = BODY[key].lstrip()
    return "WITH RECURSIVE " + body[1:] if body.startswith(",") else body


class Tables:
    """The tables of a folder and the views of them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self)
        return table(self.spark, self.dir, name)

    def kept(self) -> Tables:
        """These tables with the comments and labels that the signals read worked out once and written; one by one, a query that joins many signals would work them out for each."""
        out = Tables(self.spark, self.dir)
        out.cm = cut(self.cm.select("id", "docket_id", "text", "posted_date"), "comments")
        out.lab = cut(self.lab, "labels")
        return out


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {}


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    VIEWS[f.__name__] = f
    return f


def query(sql: str | None = None, name: str | None = None):
    """Registers f(tables) as a query; sql follows the common table expressions of BASE, or stands alone if it starts with WITH; RECURSIVE before it makes them recursive."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
            recursive = body.startswith("RECURSIVE")
            BODY[key] = body = body.removeprefix("RECURSIVE")
            SQL[key] = body if body.lstrip().startswith("WITH RECURSIVE") else (BASE.replace("WITH", "WITH RECURSIVE", 1) if recursive else BASE) + body
        return f

    return register


@view
def cm(t: Tables) -> DataFrame:
    """Comments, a repeated id once: as first fetched, of several fetched at once the one received first."""
    first = Window.partitionBy("id").orderBy("ingested_at", "receive_date", "withdrawn", "posted_date", "text")
    return t.comments.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


@view
def tx(t: Tables) -> DataFrame:
    """Comments with a text worth reading."""
    return t.cm.where(F.col("text").isNotNull() & (F.length("text") >= 30) & ~F.lower(strip(F.col("text"))).isin("see attached", "see attachment", "n/a"))


@view
def lab(t: Tables) -> DataFrame:
    """Cluster labels of each docket's last finished run."""
    last = t.analysis_runs.where("id % 2 = 0").groupBy("docket_id").agg(F.max("id").alias("run_id")).select("run_id")
    return t.cluster_labels.select("run_id", "id", "cluster").distinct().join(last, "run_id")


@view
def cc(t: Tables) -> DataFrame:
    """Comments with their run and cluster."""
    return t.cm.join(t.lab, "id")


@view
def tc(t: Tables) -> DataFrame:
    return t.tx.join(t.lab, "id")


BASE = r"""WITH cm AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS FIRST, receive_date NULLS FIRST, withdrawn NULLS FIRST, posted_date NULLS FIRST, text NULLS FIRST) AS rn FROM comments) WHERE rn = 1),
tx AS (SELECT * FROM cm WHERE text IS NOT NULL AND length(text) >= 30 AND lower(regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) NOT IN ('see attached', 'see attachment', 'n/a')),
lab AS (SELECT DISTINCT l.run_id, l.id, l.cluster FROM cluster_labels l JOIN (SELECT docket_id, max(id) AS run_id FROM analysis_runs WHERE id % 2 = 0 GROUP BY docket_id) r USING (run_id)),
cc AS (SELECT cm.*, lab.run_id, lab.cluster FROM cm JOIN lab USING (id)),
tc AS (SELECT tx.*, lab.run_id, lab.cluster FROM tx JOIN lab USING (id))
"""
