import numpy as np
import pytest

from muster.llm.vectors import _rank, exact_neighbours, footrule, measured_recall, most_similar, similar_pairs


def corpus(n=600, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 2, 3):  # near copies of some
        x[k + 1] = x[k] + rng.normal(size=dim) * 0.2
    return x


@pytest.mark.parametrize("posting,reranked", [(1024, 64), (12, 64), (1024, 20)])
def test_recall_against_brute_force(spark, posting, reranked):
    x = corpus()
    rows = [(f"c{k:04d}", [float(v) for v in r], k, "m") for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, cid int, q string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    truth = {(f"c{a:04d}", f"c{b:04d}") for a in range(len(x)) for b in np.argsort(-s[a])[:10] if s[a, b] >= 0.9}
    got = {(r.id, r.other) for r in most_similar(df, "id", "embedding", k=10, min_cosine=0.9, posting=posting, reranked=reranked).collect()}
    assert got <= truth and len(got) >= 0.9 * len(truth) and truth


def test_unusable_vectors_copies_and_empty(spark):
    e = [0.0] * 64
    one, two = [1.0] + e[1:], [0.0, 1.0] + e[2:]
    bad = [None, e, [float("nan")] + e[1:], [float("inf")] + e[1:], [1.0], [None] * 64, []]
    rows = [("a", one), ("b", [3.0] + e[1:]), ("c", one), ("d", two), ("a", [2.0] + e[1:]), (None, one)] + [(f"bad{k}", v) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert {tuple(r) for r in similar_pairs(df, "id", "embedding").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert similar_pairs(df.where("id = 'none'"), "id", "embedding").count() == 0


def test_many_copies_stay_linear(spark):
    one = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(f"c{k:03d}", one) for k in range(200)], "id string, embedding array<float>")
    found = most_similar(df, "id", "embedding").collect()
    assert len(found) == 200 * 10 and all(r.cosine == 1.0 for r in found)


def test_footrule_is_spearmans():
    a, b = [3, 1, 2], [1, 3, 9]
    place = lambda l, p: l.index(p) + 1 if p in l else 4
    want = sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})
    assert footrule(np.array([[a, b]], np.uint16))[0, 0, 1] == want


def test_a_list_is_ranked_by_footrule():
    """Of a list only the nearest by footrule are reranked, however short the list."""
    q = np.array([[127] + [0] * 63] * 4, np.int8).view(np.uint8)
    lists = np.array([[1, 2, 3], [1, 2, 3], [3, 2, 1], [7, 8, 9]], np.uint16).view(np.uint8).reshape(4, -1)
    cols = [np.zeros(4, np.int64), np.arange(4), q, lists]
    a, b, _ = _rank(10, -1.0, np.uint16, 1)(cols, np.arange(4)[None, :])
    assert {tuple(x) for x in np.stack([a, b], 1)[a < 3].tolist()} == {(0, 1), (1, 0), (2, 0), (2, 1)}


def test_exact_neighbours_and_recall(spark):
    x = corpus(300)
    df = spark.createDataFrame([(f"c{k:04d}", [float(v) for v in r]) for k, r in enumerate(x)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    asked = df.where("id IN ('c0000', 'c0001', 'c0100', 'c0299')")
    want = {(f"c{a:04d}", f"c{b:04d}") for a in (0, 1, 100, 299) for b in np.argsort(-s[a])[:5]}
    assert {(r.id, r.other) for r in exact_neighbours(df, asked, "id", "embedding", k=5, block=2).collect()} == want
    r = measured_recall(df, df, "id", "embedding", k=10, min_cosine=0.9).first()
    assert r.n_queries == 300 and r.n_true > 0 and r.recall >= 0.9
    assert exact_neighbours(df, df.where("1 = 0"), "id", "embedding").count() == 0
