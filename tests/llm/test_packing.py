import random
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from muster.llm.packing import pack, plan, token_counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=25))
def test_plan_places_every_item_once(counts):
    out = plan(counts, 50)
    used = defaultdict(int)
    for inside, times in out:
        assert sum(inside) <= 50 and times > 0
        for n in inside:
            used[n] += times
    assert dict(used) == counts


def test_pack(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 5, 40, 99, 100, 101, 250, 700])) for k in range(400)] + [(900, 0), (901, None), (902, -3), (5, 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, n long, piece string")
    for cell in (10**6, 60):
        out = pack(df, "id", "n", 100, cell).collect()
        assert sum(r.n_tokens for r in out) == sum(n for _, n in rows if n and n > 0)
        boxes = defaultdict(list)
        for r in out:
            boxes[r.container].append((r.offset, r.n_tokens))
        for b in boxes.values():
            b.sort()
            assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 100
        per_item = defaultdict(list)
        for r in out:
            per_item[r.id].append(r.n_tokens)
        assert all(len(per_item[k]) == 1 for k, n in rows[:400] if n <= 100 and k != 5)
    assert sum(r.n_tokens for r in out) / (100 * len(boxes)) > 0.9
    assert pack(df.where("id < 0"), "id", "n").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "hello world " * 20000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 39_000 and got[5] > 1


def test_triple_below_many_larger_lengths():
    counts = {n: 1 for n in range(300, 400) if n not in (330, 332, 338)} | {500: 1, 170: 1, 168: 1, 162: 1}
    assert plan(counts, 1000)[0] == ((500, 170, 168, 162), 1)


def test_repeats_of_one_item_are_dealt_alike_in_every_run(spark):
    df = spark.createDataFrame([(7, 250)] * 2500 + [(7, 30)] * 2500, "id long, n long")
    one, two = (sorted(map(tuple, pack(x, "id", "n", 100, 1000).collect())) for x in (df, df.repartition(3)))
    assert one == two and sum(r[2] for r in one) == 2500 * 280
    boxes = defaultdict(int)
    for r in one:
        boxes[r[3]] += r[2]
    assert max(boxes.values()) <= 100
