import random

import pytest

from muster.llm.subjects import addresses, document_subjects, fit_lexicon, headings, posteriors

TOPICS = {"farms": "barn crop soil tractor seed herd hay plow orchard dairy", "courts": "judge jury trial statute appeal verdict docket plea bail clerk", "sports": "goal team coach league match referee season stadium trophy sprint"}


def sentence(rng, topic):
    w = TOPICS[topic].split()
    return f"Please look at the {rng.choice(w)} and the {rng.choice(w)} because our {rng.choice(w)} matters."


def test_recovers_topics(spark):
    rng = random.Random(7)
    docs, truth = [], {}
    for k in range(400):
        topics = rng.sample(sorted(TOPICS), 2 if k % 5 == 0 else 1)
        docs.append((k, " ".join(sentence(rng, topics[j % len(topics)]) for j in range(8)), "web", "AB-1", "x"))
        truth[k] = set(topics)
    docs += [(900, None, None, None, "x"), (901, "  ", "web", None, "x"), (902, "word " * 30_000, "web", None, "x"), docs[0]]
    labels = [(k, rng.choice(sorted(TOPICS)).upper() if k % 11 == 0 else t.title()) for k in range(0, 400, 4) for t in sorted(truth[k])]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, docket_id string, subject string")
    lab = spark.createDataFrame(labels + [(5, "unknown"), (9999, "farms")], "doc_id long, subject string")
    sub = spark.createDataFrame([(t,) for t in TOPICS], "subject string")
    got = {}
    for r in document_subjects(d, lab, sub).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [k for k in truth if k % 4]
    assert sum(got.get(k) == truth[k] for k in held_out) >= 0.95 * len(held_out)
    assert not {900, 901, 902} & set(got)
    assert document_subjects(d, lab.where("1 = 0"), sub).count() == 0
    assert document_subjects(d.where("1 = 0"), lab, sub).count() == 0


def test_model_trusts_the_accurate():
    p = posteriors({("x", v): n for v, n in {"11122": 500, "00022": 900, "10022": 20, "01022": 20, "00122": 60}.items()})
    assert p["x", "11122"] > 0.95 and p["x", "00022"] < 0.05
    assert posteriors({}) == {}


def test_accuracies_are_each_subjects_own():
    """A function that is noise for one subject and right for the other is trusted for the other only."""
    noise = {("x", v): 400 for v in ("110", "111", "000", "001")}
    right = {("y", v): n for v, n in {"111": 500, "000": 500, "101": 100, "100": 5}.items()}
    p = posteriors(noise | right)
    assert p["y", "101"] > p["y", "100"] + 0.3 > p["x", "110"] - p["x", "111"] + 0.3


def test_sources_of_votes():
    assert headings("Farm Rules", "Soil and crops\nWe plow the field every year, and then we rest.\nHay:").split("\n") == ["Farm Rules", "Soil and crops", "Hay:"]
    assert addresses("AB-1", "write to ann@barn.farms.example or x@y") == {"AB", "@barn.farms"}
    texts, labels = ["plow the field now. plow the field now."] * 3 + ["file the plea now. file the plea now."] * 3, [[0]] * 3 + [[1]] * 3
    odds = fit_lexicon(texts, labels, 2, pairs=True)
    assert odds and all(abs(int(o.argmax()) - 0.5) == 0.5 for o in odds.values())


def test_too_many_subjects_raise(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, source string, docket_id string")
    labels = spark.createDataFrame([(1, "s1")], "doc_id long, subject string")
    with pytest.raises(ValueError):
        document_subjects(docs, labels, spark.range(1001).selectExpr("concat('s', id) AS subject"))
