import random
import re

import pytest

from muster.llm.near_duplicates import least_shared, measured_recall, near_duplicate_groups, runs_needed


def brute(rows, threshold=0.5):
    sets = {}
    for i, t in rows:
        if i is None or t is None or len(t.strip()) < 30:
            continue
        w = re.findall(r"[^\W_]+", t.lower())
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if s:
            sets[i] = s
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = {i: find(i) for i in ids}
    size = {}
    for g in out.values():
        size[g] = size.get(g, 0) + 1
    return {i: g for i, g in out.items() if size[g] > 1}


def corpus(seed, groups=14, copies=9):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(70)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"d{n:04d}", " ".join(t)))
            n += 1
    return rows


@pytest.mark.parametrize("bucket", [128, 3])
def test_equals_brute_force(spark, bucket):
    rows = corpus(5)
    rows += [("n1", None), ("n2", "   "), ("n3", "too short"), (None, rows[0][1]), rows[0], ("long", rows[3][1] + " tail" * 3000)]
    rows += [(f"copy{k:03d}", rows[9][1].upper() + "!") for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "id string, text string, cid int, draws string, g string")
    want = brute(dict((i, t) for i, t in rows if i).items())
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "id", "text", bucket=bucket).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want)
    assert all(want[i] == g for i, g in got.items())


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert near_duplicate_groups(df, "id", "text").count() == 0


def test_runs_follow_from_threshold_and_recall():
    assert [runs_needed(0.5, 0.99, d) for d in (1, 2, 3)] == [7, 17, 35]
    assert runs_needed(0.8, 0.99, 1) == 3 and runs_needed(0.5, 0.9, 1) == 4
    assert 18 <= least_shared(0.5, 0.995) <= 24 < least_shared(0.8, 0.995)


def test_lone_pairs_in_a_hot_bucket(spark):
    """Texts that share boilerplate without being copies, with lone pairs near the threshold among them."""
    rng = random.Random(2)
    boiler = " ".join(f"b{k}" for k in range(30))
    rows = []
    for k in range(150):
        own = [f"t{k}x{j}" for j in range(60)]
        rows.append((f"d{k:03d}a", boiler + " " + " ".join(own)))
        if k % 3 == 0:
            cut = own[:44] + [f"u{k}x{j}" for j in range(16)]
            rows.append((f"d{k:03d}b", boiler + " " + " ".join(cut)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, text string")
    want = brute(rows)
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "id", "text", bucket=16).collect()}
    assert len(want) == 100 and len(got) >= 97 and all(want[i] == g for i, g in got.items())


def test_recall(spark):
    df = spark.createDataFrame(corpus(7), "id string, text string")
    r = measured_recall(df, df.where("id < 'd0050'"), "id", "text", block=20).first()
    assert r.n_queries == 50 and r.n_true > 100 and r.recall >= 0.98
    assert measured_recall(df.where("1 = 0"), df.where("1 = 0"), "id", "text").first().n_true == 0
