import random

import pytest

from muster.llm.components import connected_components, match_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent if True}


def groups(df):
    rows = [(r.id, r.group_id) for r in df.collect()]
    assert len(rows) == len({i for i, _ in rows})
    return dict(rows)


@pytest.mark.parametrize("root,held", [(40, 10**6), (1, 10**6), (5, 20)])
def test_equals_union_find(spark, root, held):
    rng = random.Random(1)
    pairs = [(f"v{rng.randrange(300):03d}", f"v{rng.randrange(300):03d}") for _ in range(260)]
    pairs += [(f"chain{k:03d}", f"chain{k + 1:03d}") for k in range(120)]
    pairs += [("hub", f"leaf{k:03d}") for k in range(200)] + [("x", "x"), (None, "y"), ("y", None)]
    pairs += pairs[:50] + [(b, a) for a, b in pairs[50:90]]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in pairs], "l string, r string, id int, group_id string")
    assert groups(connected_components(df, "l", "r", root, held)) == brute(pairs)


def test_integers_and_empty(spark):
    df = spark.createDataFrame([(3, 2), (2, 9), (7, 7)], "a long, b long")
    assert groups(connected_components(df, "a", "b")) == {2: 2, 3: 2, 9: 2}
    assert connected_components(df.where("a > 100"), "a", "b").count() == 0


def test_typed_ids(spark):
    df = spark.createDataFrame([(" a-1", "B-2 "), ("b-2", "c-3"), ("", "d"), ("e", " E ")], "left_id string, right_id string")
    assert groups(match_groups(df)) == {"A-1": "A-1", "B-2": "A-1", "C-3": "A-1"}


def test_rounds_run_over_several_cells(spark, monkeypatch):
    df = spark.range(4_000).selectExpr("id AS a", "id + 1 AS b")
    cells, plain = [], type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, c: cells.append(n) or plain(self, n, c))
    assert set(groups(connected_components(df, "a", "b")).values()) == {0}
    assert len(cells) > 1 and cells[0] >= 4


def test_sql_of_groups(spark):
    """p2_found and its SQL in DuckDB give the same rows."""
    duckdb = pytest.importorskip("duckdb")
    from muster.llm import queries, sql

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW comment_matches AS SELECT * FROM '{data}/comment_matches.parquet'")
    assert sorted(map(tuple, queries.p2_found(spark, data).collect())) == sorted(con.execute(sql.P2_FOUND).fetchall())
