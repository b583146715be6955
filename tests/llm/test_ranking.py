import math
from math import comb

import pytest
from pyspark.sql import functions as F

from muster.llm.ranking import robust_ranking


def brute(rows, m):
    scores = [{i: r[k] for i, r in rows.items() if r[k] is not None and math.isfinite(r[k])} for k in range(m)]
    rank = [{i: (sum(v > x for v in s.values()) + (sum(v == x for v in s.values()) + 1) / 2) / len(s) for i, x in s.items()} for s in scores]
    out = {}
    for i in rows:
        r = sorted(x[i] for x in rank if i in x)
        n = len(r)
        p = [sum(comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(k, n + 1)) for k, x in enumerate(r, 1)]
        out[i] = min(1.0, min(p) * n) if p else 1.0
    return out


def test_equals_brute_force(spark):
    rows = {k: [float(k % 7), float((k * 37) % 101) ** 3, None if k % 5 == 0 else float(-k), float("nan") if k % 4 == 0 else float(k)] for k in range(60)}
    rows[60] = [None, float("inf"), None, float("nan")]
    data = [(k, *r, "x") for k, r in rows.items()] + [(3, *rows[3], "x")]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, rank string")
    got = robust_ranking(df, ["id"], {n: F.col(n) for n in "abcd"}).collect()
    want = brute(rows, 4)
    assert len(got) == 61
    assert all(abs(r.significance - want[r.id]) < 1e-9 for r in got)
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in sorted((round(math.log(p), 9), i) for i, p in want.items())]
    assert robust_ranking(df.where("id > 99"), ["id"], {n: F.col(n) for n in "abcd"}).count() == 0


def test_scale_does_not_matter(spark):
    df = spark.range(50).selectExpr("id", "id * 1.0 AS a", "(50 - id) * 1.0 AS b")
    one = {r.id: r["rank"] for r in robust_ranking(df, ["id"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    two = {r.id: r["rank"] for r in robust_ranking(df, ["id"], {"a": F.exp("a"), "b": F.col("b") / 1e9}).collect()}
    assert one == two


def test_strongest_of_many_stay_apart(spark):
    """Significances that all round to 0 are still ranked by size, and a value shared by a third of the rows is joined."""
    n = 30_000
    df = spark.range(n).selectExpr("id", "id * 1.0 AS a", "id * 2.0 AS b", "id * 3.0 AS c", "IF(id % 3 = 0, 0.0, id) AS d", "id * 1.5 AS e")
    got = robust_ranking(df, ["id"], {x: F.col(x) for x in "abcde"})
    best = {r.id: r for r in got.where("rank <= 2").collect()}
    assert got.count() == n and best[n - 1]["rank"] == 1 and best[n - 1].significance == best[n - 2].significance == 0.0
    assert best[n - 1].log_significance < best[n - 2].log_significance


def test_sql_of_ranking(spark):
    duckdb = pytest.importorskip("duckdb")
    from muster.llm import queries, sql

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clusters AS SELECT * FROM '{data}/clusters.parquet'")
    want = con.execute(sql.p4_ranking_sql()).fetchall()
    got = [(r.run_id, r.cluster_id, r.n_scores, r.significance, r.log_significance, r["rank"]) for r in queries.p4_ranking(spark, data).collect()]
    assert sorted(tuple(f"{x:.9g}" for x in r) for r in got) == sorted(tuple(f"{x:.9g}" for x in r) for r in want)
