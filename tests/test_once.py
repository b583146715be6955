"""Work that is done once for each text, and gives what the operators of single features give."""

import datetime as dt
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from muster.operators import scan, style
from muster.suite import base, signals, style as suite
from muster.suite.base import Tables

TEXTS = [
    "However, we delve into THE rule — and it's (very) robust; \"indeed\" it is. We thank you, truly!",
    "Día único: naïve Straße ²³ x² Ⅷ and µm, the λόγος of the ΣΟΦΟΣ.   Ok? Yes.   . No",
    "12345 67890 !!! ??? ... 1234567890 $$$",
    "one word only repeated " + "word " * 60 + ". " + "the of and to " * 20,
    "A sentence without an end but long enough to count as a text of its own",
    "Short. " * 12 + "Then, a longer one; with [many] (brackets), and commas, too.",
]


@pytest.fixture
def tables(spark, monkeypatch):
    rows = [(f"c{k}", None if k == 5 else f"d{k % 2}", x) for k, x in enumerate(TEXTS * 3)]
    rows = [(f"{i}-{n}", d, x) for n, (i, d, x) in enumerate(rows)]
    texts = spark.createDataFrame(rows, "id string, docket_id string, text string").cache()
    labels = texts.select(F.lit(2).cast("long").alias("run_id"), "id", (F.length("text") % 2).cast("int").alias("cluster"))
    calls = []
    monkeypatch.setitem(base.VIEWS, "tx", lambda t: calls.append("tx") or texts)
    monkeypatch.setitem(base.VIEWS, "lab", lambda t: labels)
    return Tables(spark, "-"), calls


def test_style_matrix_reads_texts_once(tables):
    t, calls = tables
    assert len(suite.ag9_full_style(t).collect()) == 2
    assert calls == ["tx"]


def test_style_matrix_equals_single_features(tables):
    t, _ = tables
    got = {r.id: r for r in t.full_matrix.collect()}
    feats = {r.id: r for r in t.feats.collect()}
    assert set(got) == set(feats) and len(got) == 15
    works = {"yule_k": (suite.st4_yule_k, "yule_k"), "hapax_ratio": (suite.st5_hapax, "hapax_ratio"), "char_entropy": (suite.st8_trigram_entropy, "entropy"), "fw_chi2": (suite.st11_function_word_chi2, "chi2"), "clause_depth": (suite.st15_clause_depth, "depth"), "pos_entropy": (suite.st16_pos_entropy, "pos_entropy"), "mtld": (suite.st3_mtld, "mtld"), "zlib_ratio": (suite.st19_zlib_ratio, "zlib_ratio")}
    single = {c: {r.id: r[name] for r in q(t).collect()} for c, (q, name) in works.items()}
    for i, r in got.items():
        for c in suite.ALL_COLS:
            want = single[c].get(i, 0.0) if c in single else feats[i][c]
            assert math.isclose(r[c], want or 0.0, rel_tol=1e-9, abs_tol=1e-9), (i, c, r[c], want)


def test_impute_of_columns_that_lack_values(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 2.0), (3, 3.0, 3.0), (4, float("nan"), 4.0)], "id long, a double, b double")
    assert sorted(map(tuple, style.impute(df, ["a", "b"]).collect())) == [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, 2.0, 4.0)]


def test_surprisal_by_chunks_equals_that_by_words(tables, monkeypatch):
    t, calls = tables
    got = {r.id: r for r in style.surprisal_shapes(t.tx).collect()}
    want = {r.id: r for r in style.surprisal_features(style.surprisal(t.tx)).collect()}
    assert set(got) == set(want) and len(got) == 15
    for i, r in got.items():
        for c in style.SHAPES:
            assert math.isclose(r[c], want[i][c], rel_tol=1e-6, abs_tol=1e-6), (i, c, r[c], want[i][c])
    calls.clear()
    assert len(suite.ag13_generated_score(t).collect()) == 2
    assert calls == ["tx"]


def test_scan_of_blocks_gives_the_first_best_window(monkeypatch):
    rng = np.random.default_rng(7)
    for n in (1, 3, 12, 40):
        docket = np.sort(np.concatenate((rng.integers(0, 60, 3 * n), rng.integers(20, 25, n))))
        t = np.sort(rng.choice(docket, n, replace=False))
        lo, hi = np.searchsorted(docket, t, "left"), np.searchsorted(docket, t, "right")
        best, longest = (0.0, 0, 0), 0.5 * (docket[-1] - docket[0])
        for i in range(n):
            for j in range(i, n):
                k, mu = j - i + 1.0, n * (hi[j] - lo[i]) / len(docket)
                if t[j] <= t[i] + longest and k > mu and k < n and 0 < mu < n:
                    lam = k * np.log(k / mu) + (n - k) * np.log((n - k) / (n - mu))
                    best = max(best, (lam, i, j), key=lambda x: x[0])
        for windows in (1, 50, 1_000_000):
            monkeypatch.setattr(scan, "WINDOWS", windows)
            assert scan.scan(t, lo, hi, len(docket), longest) == best


def test_score_works_out_comments_once(spark, monkeypatch, tmp_path):
    rows = [(f"c{k}", "d", x + f" {k}", dt.datetime(2031, 1, 1, k), None, None, None) for k, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "id string, docket_id string, text string, posted_date timestamp_ntz, ingested_at timestamp_ntz, receive_date timestamp_ntz, withdrawn boolean").write.parquet(f"{tmp_path}/comments.parquet")
    spark.createDataFrame([(2, "d")], "id long, docket_id string").write.parquet(f"{tmp_path}/analysis_runs.parquet")
    spark.createDataFrame([(2, f"c{k}", k % 2 - (k == 5)) for k in range(6)], "run_id long, id string, cluster int").write.parquet(f"{tmp_path}/cluster_labels.parquet")
    spark.createDataFrame([(f"c{k}", [float(k + i) for i in range(64)], dt.datetime(2031, 1, 1)) for k in range(6)], "comment_id string, embedding array<float>, embedded_at timestamp_ntz").write.parquet(f"{tmp_path}/comment_vectors.parquet")
    calls, cm = [], base.VIEWS["cm"]
    monkeypatch.setitem(base.VIEWS, "cm", lambda t: calls.append("cm") or cm(t))
    for q in (signals.sc2_score, signals.sc3_verdict, signals.sc4_clusters):
        calls.clear()
        assert len(q(Tables(spark, str(tmp_path))).collect()) == (1 if q is signals.sc4_clusters else 2)
        assert calls == ["cm"]
