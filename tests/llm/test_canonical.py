import random

import numpy as np
import pytest

from muster.llm.canonical import BKTree, levenshtein_many, map_places, nearest_entries, plain, slips

PLACES = [(1, "Fort Arden", "AA", "North Aland", None, 10), (2, "Lakewick", "AA", "North Aland", "Old Harbour", 5), (3, "Lakewick", "BB", "Bostonia", None, 50), (4, "Saint Umber", "BB", "Bostonia", None, 7)]
STATES = [("AA", "North Aland"), ("BB", "Bostonia")]


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
        d = new
    return d[-1]


def test_tree_finds_all_within_radius():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    tree = BKTree(words)
    values = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    for v, found in zip(values, tree.within(values, np.full(len(values), 2))):
        assert sorted(found) == sorted({w for w in words if lev(v, w) <= 2})
    codes, lengths = BKTree._pad(values)
    assert levenshtein_many(np.array([ord(c) for c in "abcab"]), codes, lengths).tolist() == [lev("abcab", v) for v in values]


def test_slips_and_plain():
    assert slips("abcd", "abdc") == 1 and slips("", "ab") == 2 and slips("kitten", "sitting") == 3
    assert plain("  Ft. Árden 12345") == "fort arden" and plain("City of Lakewick") == "lakewick" and plain("N.R.") == "nr"


@pytest.mark.parametrize("shard", [5_000, 2])
def test_map_places(spark, shard):
    rows = [
        ("a", "Ft Arden", "aa"), ("b", "lakewick", "B.B."), ("c", "Lakewick, AA", None), ("d", "Saint Umbre", "State of Bostonia"), ("e", "-", "XX"), ("f", None, ""), ("g", "Lakewick", None),
        ("h", "Old harbour", "North Alnad"), ("i", "St. Umber (rural)", "  "), ("j", "x" * 5000, None), ("a", "Ft Arden", "aa"), (None, "Lakewick", "AA"), ("k", "Fort  Ardenville", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id string, city string, state_prov string, place string, field int")
    places = spark.createDataFrame(PLACES, "place_id int, city string, state_code string, state_name string, former_name string, population int")
    states = spark.createDataFrame(STATES, "state_code string, state_name string")
    got = {(r.id, r.field): r.ref_key for r in map_places(df, places, states, shard=shard).collect()}
    assert got == {
        ("a", "city"): "1", ("a", "state_prov"): "AA", ("b", "city"): "3", ("b", "state_prov"): "BB", ("c", "city"): "2", ("d", "city"): "4", ("d", "state_prov"): "BB", ("e", "city"): "", ("e", "state_prov"): "",
        ("g", "city"): "3", ("h", "city"): "2", ("h", "state_prov"): "AA", ("i", "city"): "4", ("j", "city"): "", ("k", "city"): "",
    }
    assert map_places(df.where("1 = 0"), places, states).count() == 0
    assert {r.ref_key for r in map_places(df, places.where("1 = 0"), states.where("1 = 0")).collect()} == {""}


def test_radius_is_a_parameter(spark):
    names = spark.createDataFrame([("abcd", 1), ("wxyz", 2)], "name string, entry int").selectExpr("*", "false AS exact")
    values = spark.createDataFrame([("abcx",), ("wxyz",)], "value string")
    near = lambda **k: {r.value: [tuple(x) for x in r.near] for r in nearest_entries(values, names, **k).collect()}
    assert near() == {"wxyz": [(0, 2)]}
    assert near(allowed_by_length=((3, 1),), shard=1, part=1) == {"abcx": [(1, 1)], "wxyz": [(0, 2)]}


def test_many_names(spark):
    """Over several shards, every name within the slips is found."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcde") for _ in range(9)) for _ in range(900)})
    typed = sorted({w[:k] + rng.choice("abcde") + w[k + 1 :] for w in words[::9] for k in (2, 5)} - set(words))
    names = spark.createDataFrame([(w, w) for w in words], "name string, entry string").selectExpr("*", "false AS exact")
    got = {r.value: {x.entry for x in r.near} for r in nearest_entries(spark.createDataFrame([(t,) for t in typed], "value string"), names, shard=100, part=40).collect()}
    assert got == {t: {w for w in words if slips(t, w) <= 2} for t in typed}
