import pytest
import datetime as dt
import difflib
import json
import subprocess
import sys
import urllib.error
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F

from muster.functions import text as T
from muster.functions.stats import chi2_sf_odd
from muster.operators import clusters, graph, style
from muster.operators.joins import band_pairs, similar_sets
from muster.operators.scan import cluster_scan
from muster.sources import rest, store
from muster.suite import relational, signals  # noqa: F401
from muster.suite.base import QUERIES, Tables


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.clean_html(F.lit("&lt;b&gt;Hi&lt;/b&gt;&nbsp; there"))) == "Hi there"
    assert sorted(one(spark, T.shingles(F.lit("A b c d e f")))) == ["a b c d e", "b c d e f"]
    assert one(spark, T.shingles(F.lit("only three words"))) == ["only three words"]
    assert one(spark, T.shingles(F.lit("  "))) == []
    assert one(spark, T.normal_org(F.lit("The Sierra Club, Inc."))) == "sierra club"
    assert one(spark, T.premise_hash(F.array(F.lit("Costs rise"), F.lit("  jobs lost ")))) == "c84b92fcb51e2f78"
    assert abs(one(spark, T.entropy(F.array(F.lit(3), F.lit(1)))) - 0.8112781) < 1e-6
    assert one(spark, T.dollars(F.lit("$ 2.5M"))) == 2.5e6 and one(spark, T.dollars(F.lit("none"))) is None
    assert one(spark, T.acronym(F.lit("Chamber of Commerce of the United States"))) == "CCUS"


def test_chi2():
    assert abs(chi2_sf_odd(30.144, 19) - 0.0499942) < 1e-6
    assert chi2_sf_odd(0, 19) == 1.0


def test_scan_statistic(spark):
    rows = [(1, 0 if t in (40, 50, 90) else -1, t * 1_000_000) for t in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "run_id long, cluster int, us long")
    r = cluster_scan(df).first()
    assert abs(r.lambda_star - 1.5324769) < 1e-6 and r.peak_count == 2 and abs(r.tcs - 0.4) < 1e-4 and abs(r.p - 0.04) < 1e-3
    assert (r.start_us, r.end_us) == (40_000_000, 50_000_000)


def test_timeline(spark):
    start = dt.datetime(2031, 1, 1)
    rows = [(start,)] + [(start + dt.timedelta(hours=23, minutes=k),) for k in range(24)]
    got = clusters.timeline(spark.createDataFrame(rows, "at timestamp_ntz"), "at").collect()
    assert len(got) == 24 and [r.n for r in got if r.is_burst] == [24]
    assert clusters.timeline(spark.createDataFrame([], "at timestamp_ntz"), "at").count() == 0


def test_band_join_includes_the_edge(spark):
    df = spark.createDataFrame([("b", 0), ("a", 30_000_000), ("c", 90_000_000), ("d", 151_000_001)], "id string, us long")
    assert sorted((r.id_a, r.id_b) for r in band_pairs(df, "id", "us", 60).collect()) == [("a", "b"), ("a", "c")]


def test_similar_sets_is_exact(spark):
    import random

    rng = random.Random(1)
    sets = {k: set(rng.sample(range(14), rng.randrange(1, 9))) for k in range(60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id int, g array<int>")
    for t in (0.4, 0.7, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        assert {(r.id_a, r.id_b) for r in similar_sets(df, "id", "g", t).collect()} == want


def test_components_and_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("d", "c"), ("z", "z")], "s string, t string")
    assert {r.id: r.group_id for r in graph.components(e, "s", "t").collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    org = lambda n: [(f"{n}-{k:02d}", f"org {n}", None, None) for k in range(n)]
    c = spark.createDataFrame(org(2) + org(3) + org(51), "id string, organization string, submitter_first string, state_prov string")
    kept = graph.combine_edges(graph.metadata_edges(c).withColumn("kind", F.lit("metadata"))).collect()
    assert [(r.src, r.dst, r.weight) for r in kept] == [("2-00", "2-01", 0.2)]


def test_communities(spark):
    clique = lambda p: [(f"{p}{a}", f"{p}{b}", 1.0) for a in range(5) for b in range(a + 1, 5)]
    e = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 0.1)], "src string, dst string, weight double")
    got = {r.id: r.community for r in graph.communities(e).collect()}
    assert len({got[f"a{k}"] for k in range(5)}) == 1 and got["a1"] != got["b1"]


def test_tightness_equals_recomputed_variances(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(1, c, rng.gauss(0, 1 + c)) for c in (-1, 0, 1) for _ in range(12)]
    got = {r.cluster: r.style_score for r in style.tightness(spark.createDataFrame(rows, "run_id long, cluster int, x double"), ["x"]).collect()}

    def var(v):
        m = sum(v) / len(v)
        return sum((x - m) ** 2 for x in v) / len(v)

    for c in (0, 1):
        ratio = var([x for _, k, x in rows if k == c]) / var([x for _, k, x in rows if k != c])
        want = min(1, 12 / 20) * max(0, min(0.95, 1 - math.exp(math.log(math.sqrt(ratio) + 0.01))))
        assert abs(got[c] - want) < 1e-3


def test_store_rules(spark):
    old = spark.createDataFrame([("a", 1)], "id string, at int")
    new = spark.createDataFrame([("a", 2), ("b", 5), ("b", 3)], "id string, at int")
    assert sorted(map(tuple, store.insert_or_ignore(old, new, "id", "at").collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, store.insert_or_replace(old, new, "id", "at").collect())) == [("a", 2), ("b", 5)]


def test_rest_source(spark, tmp_path):
    slept = []

    def flaky(url, left=[429, 503]):  # noqa: B006
        if left:
            raise urllib.error.HTTPError(url, left.pop(0), "", {}, None)
        return b'{"data": []}'

    assert rest.fetch("http://x", flaky, slept.append) == {"data": []} and slept == [2.0, 2.0]

    def gone(url):
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    assert rest.fetch("http://x", gone, slept.append) is None

    def down(url):
        raise urllib.error.HTTPError(url, 503, "", {}, None)

    with pytest.raises(ConnectionError):
        rest.fetch("http://x", down, slept.append)
    now = [0.0]
    t = rest.Throttle(2, 10.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        t.wait()
    assert now[0] == 10.0
    row = rest.flatten({"id": "c1", "attributes": {"comment": "x", "address": None, "withdrawn": 1}})
    assert row[0] == "c1" and row[8] is None and row[-1] is True

    import http.server
    import threading

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"data": [{"id": "c1", "attributes": {"docketId": "D", "comment": "hi"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.CommentsSource)
    df = spark.read.format("comments_api").option("url", f"http://127.0.0.1:{server.server_port}").option("docket", "D").option("windows", "2031-01-01,2031-02-01,2031-03-01").load()
    assert df.count() == 2 and df.dropDuplicates(["id"]).count() == 1
    server.shutdown()


def test_rest_listing_goes_on_after_its_limit(monkeypatch):
    """A listing gives LISTED rows at most; the reader opens new ones from the last date on, gives each row once and stops at maxcomments."""
    rows = [{"id": f"c{k:03d}", "attributes": {"postedDate": f"2031-01-{1 + k // 7:02d}"}} for k in range(100)]

    def served(url):
        q = dict(x.split("=") for x in url.split("?")[1].split("&"))
        listed = [r for r in rows if r["attributes"]["postedDate"] >= q["from"]][:30]
        return {"data": listed[(int(q["page"]) - 1) * 10 : int(q["page"]) * 10]}

    monkeypatch.setattr(rest, "PAGE", 10)
    monkeypatch.setattr(rest, "LISTED", 30)
    monkeypatch.setattr(rest, "fetch", served)
    reader = rest.CommentsReader({"url": "http://x", "docket": "D"})
    assert [r[0] for r in reader.read(reader.partitions()[0])] == [r["id"] for r in rows]
    few = rest.CommentsReader({"url": "http://x", "docket": "D", "maxcomments": "42"})
    assert len(list(few.read(few.partitions()[0]))) == 42
    for r in rows:
        r["attributes"]["postedDate"] = "2031-01-01"
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))
    monkeypatch.setattr(rest, "fetch", lambda url: {"data": {"id": "D", "attributes": {"title": "t"}}})
    assert list(rest.DocketReader({"url": "http://x", "docket": "D"}).read(None)) == [("D", "t", None, None)]


def test_store_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "D1", 1.0), ("b", "D2", None)], "id string, docket_id string, x double")
    store.write_corpus(df, f"{tmp_path}/c")
    store.write_corpus(df.where("docket_id = 'D1'").withColumn("id", F.lit("z")), f"{tmp_path}/c", "overwrite")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/c").collect()) == ["b", "z"]
    store.write_json(df, f"{tmp_path}/j", ("docket_id",))
    assert {r.id for r in spark.read.json(f"{tmp_path}/j").collect()} == {"a", "b"}
    (tmp_path / "r.csv").write_text("pos,name,sector,type,lobby_intensity\n0,acme,energy,firm,high\n")
    assert tuple(store.read_registry(spark, f"{tmp_path}/r.csv").first())[:3] == (0, "acme", "energy")
    store.append_fingerprints(df, f"{tmp_path}/f")
    store.append_fingerprints(df, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 4
    for n in (2, 9):
        assert store.cached_json(spark, f"{tmp_path}/k", lambda: spark.range(n)).count() == 2  # noqa: B023


def test_core_does_not_import_llm():
    code = "import sys; sys.path.insert(0, '.'); import muster.catalog; assert not any(m.startswith('muster.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_density_clusters(spark):
    import numpy as np

    from muster.operators import density

    rng = np.random.default_rng(1)
    centres = np.eye(16)[:3] * 4
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.2 for c in centres] + [rng.normal(size=(6, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, f"v{k:03d}", [float(a) for a in r]) for k, r in enumerate(x)], "run_id long, id string, v array<double>")
    got = {r.id: r.cluster for r in density.density_clusters(df, least=15).collect()}
    assert len(got) == 126
    for g in range(3):
        labels = [got[f"v{k:03d}"] for k in range(40 * g, 40 * g + 40)]
        assert max(labels.count(c) for c in set(labels) if c >= 0) >= 36


def test_synthetic_campaigns_are_found(spark):
    from muster.operators import synthetic

    df = synthetic.corpus(spark)
    assert df.count() == 400 + sum(c[1] for c in synthetic.CAMPAIGNS) and df.select("id").distinct().count() == df.count()
    groups = similar_sets(df.select("id", T.shingles(F.col("text")).alias("g")).dropDuplicates(["g"]), "id", "g", 0.3)
    assert groups.count() > 0
    us = F.unix_micros("posted_date")
    labels = {c[0]: k for k, c in enumerate(synthetic.CAMPAIGNS)}
    ev = df.select(F.lit(1).cast("long").alias("run_id"), F.coalesce(*[F.when(F.col("label") == n, k) for n, k in labels.items()], F.lit(-1)).alias("cluster"), us.alias("us"))
    found = {r.cluster: r for r in cluster_scan(ev).collect()}
    for name, size, day, hour, minutes, *_ in synthetic.CAMPAIGNS:
        r = found[labels[name]]
        assert r.lambda_star > 50 and (r.end_us - r.start_us) <= minutes * 60_000_000


def test_near_groups_hold_edited_copies(spark):
    base = "we ask the board to keep the rule as it stands because the rivers of this county need it and so do all of the farms along them".split()
    edited = [*base[:-1], "today"]  # 22 of 24 shingles shared
    texts = {"b": " ".join(base), "a": " ".join(base).upper(), "c": " ".join(edited), "d": "  " + "  ".join(edited), "e": " ".join(reversed(base)), "f": " "}
    sets = spark.createDataFrame(list(texts.items()), "id string, text string").select("id", T.shingles(F.col("text")).alias("s"))
    got = {(r.id, r.group_id) for r in graph.near_groups(sets, "id", "s", 0.7).collect()}
    assert got == {(x, "a") for x in "abcd"}
    assert graph.near_groups(sets.where("1 = 0"), "id", "s", 0.7).count() == 0


def test_edited_copies_count_as_duplicates(spark):
    """ag1, ag3, ag16, j14 and ml12 against groups by brute force over the smallest tables."""
    t = Tables(spark, "/root/testdata/sf0.001")
    sets = {r.id: set(r.s) for r in t.tx.select("id", T.shingles(F.col("text")).alias("s")).collect()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(both := sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and both and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    sizes = Counter(map(find, ids))
    want = {i: find(i) for i in ids if sizes[find(i)] > 1}
    assert {r.id: r.g for r in t.dg.collect()} == want
    labels = [(r.run_id, r.cluster, r.id) for r in t.lab.where("cluster <> -1").collect() if r.id in want]
    n = Counter((r, c) for r, c, _ in labels)
    assert {(r.run_id, r.cluster): r.n_duplicates for r in QUERIES["ag1_duplicates"](spark, t.dir).where("n_duplicates > 0").collect()} == n
    assert {(r.run_id, r.cluster): (r.n_near, r.n_groups) for r in QUERIES["ag3_near_groups"](spark, t.dir).collect()} == {k: (v, len({want[i] for r, c, i in labels if (r, c) == k})) for k, v in n.items()}
    e = {(r.src, r.dst) for r in QUERIES["ag16_edges"](spark, t.dir).where("kinds LIKE '%template%'").collect()}
    assert e == {(g, i) for i, g in want.items() if i != g}
    assert {i for i, g in want.items()} <= {r.id for r in QUERIES["ml12_communities"](spark, t.dir).collect()}


def test_mistyped_organisations_resolve(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    name, other = (r.name for r in relational.registry(t).where("length(name) >= 15").orderBy("pos").limit(2).collect())
    slip = name[:6] + name[7:]
    orgs = [(name,), (slip,), ("x" + name + " office",), ("zzzz qqqq",), ("",), (None,)]
    rows = spark.createDataFrame([(f"c{k}", o) for k, (o,) in enumerate(orgs)], "id string, organization string")
    reg = spark.createDataFrame([(3, other, "s", "t", "high"), (5, name, "s", "t", "high"), (9, name, "s", "t", "low")], "pos int, name string, sector string, type string, intensity string")
    monkeypatch.setattr(relational, "registry", lambda t: reg)
    small = SimpleNamespace(cm=rows)
    got = {r.organization: (r.pos, round(r.score, 6)) for r in relational.fuzzy_resolved(small).collect()}
    ratio = difflib.SequenceMatcher(None, normal_org(spark, slip), name).ratio()
    assert got == {name: (5, 1.0), slip: (5, round(ratio, 6)), "x" + name + " office": (5, 0.95)} and ratio >= 0.85
    assert {r.id for r in relational.attributes(small, relational.fuzzy_resolved(small)).collect()} == {"c0", "c1", "c2"}


def normal_org(spark, name):
    return one(spark, T.normal_org(F.lit(name)))
