from muster.llm.mixing import mix, mixture_rates, mixture_shares, wanted_tokens


def test_shares_meet_targets(spark):
    rows = [(k, "big", 10 + k % 90) for k in range(4000)] + [(5000 + k, "small", 5 + k % 40) for k in range(60)] + [(6000 + k, "mid", 20) for k in range(300)]
    rows += [(7000, None, 50), (7001, "other", 50), (7002, "big", 0), (7003, "big", None)]
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, n_tokens long, copies string").select("id", "source", "n_tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.25, 2), ("absent", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rated, total = mixture_rates(sizes, targets)
    mixed = mix(sizes, targets)
    shares = {r.source: r for r in mixture_shares(sizes, targets.where("source IS NOT NULL"), mixed).collect()}
    assert shares["absent"].tokens == 0
    for s, goal in (("big", 0.5 / 0.95), ("small", 0.2 / 0.95), ("mid", 0.25 / 0.95)):
        assert abs(shares[s].share - goal) < 0.01
    assert shares["small"].most_repeats <= 3 and shares["mid"].most_repeats <= 2 and shares["big"].most_repeats == 1
    assert abs(sum(r.tokens for r in shares.values()) - total) / total < 0.01
    # the lengths of a source's documents keep their mean
    mean = sum(n for _, s, n in rows if s == "big" and n) / 4000
    got = mixed.where("source = 'big'").groupBy().agg({"n_tokens": "avg"}).first()[0]
    assert abs(got - mean) / mean < 0.15


def test_nothing_to_mix(spark):
    sizes = spark.createDataFrame([(1, "a", 5)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("b", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(sizes, targets).count() == 0
    assert [r.share for r in mixture_shares(sizes, targets, mix(sizes, targets)).collect()] == [0.0]


def test_a_stated_total_is_reached_as_near_the_targets_as_can_be(spark):
    goal = [("a", 0.5, 1000.0), ("b", 0.3, 90.0), ("c", 0.2, 10.0)]
    assert wanted_tokens(goal, None) == {"a": 25.0, "b": 15.0, "c": 10.0}
    assert wanted_tokens(goal, 400) == {"c": 10.0, "b": 90.0, "a": 300.0}
    assert wanted_tokens(goal, 5000) == {"a": 1000.0, "b": 90.0, "c": 10.0}
    sizes = spark.createDataFrame([(k, "a", 10 + k % 7) for k in range(900)] + [(1000 + k, "b", 12) for k in range(20)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixture_shares(sizes, targets, mix(sizes, targets, total=3000)).collect()}
    assert shares["b"].tokens == 480 and abs(shares["a"].tokens - 2520) < 60
