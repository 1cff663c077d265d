"""Golden vectors and properties that SQL twins do not show."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netweir.functions.traffic import clamp, erfc, ip_number, ip_text, wilson
from netweir.operators import detectors, evaluation, filters, lookups, paired, recursions, sketches, synthesis
from netweir.plans.detectors import FEATURES
from netweir.plans.detectors import matrix as windows
from netweir.sources import tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_feature_filter_golden(spark):
    t = spark.createDataFrame([(1.0, 0.0, None, 5.0, 1e-12, 0.0), (2.0, 0.0, 3.0, 5.0, 1e-12, 0.5), (3.0, 0.0, 4.0, 5.0, 2e-12, 0.0)], "a double, b double, c double, d double, e double, f double")
    names = ["a", "b", "c", "d", "e", "f", "missing"]
    assert filters.active_features(t, names) == ["a", "c", "f"]
    assert filters.active_features(t, names, nonzero=0.8) == ["a"]
    assert filters.active_features(t.limit(0), names) == []


@pytest.mark.parametrize(("score", "p"), [(3.5, 3 / 6), (0.0, 1.0), (99.0, 1 / 6)])
def test_conformal_golden(spark, score, p):
    rows = spark.createDataFrame([(1, float(x), True) for x in range(1, 6)] + [(1, score, False)], "k int, s double, calib boolean")
    got = detectors.conformal(rows, "s", "calib", ["k"]).filter("NOT calib").first()["p"]
    assert got == pytest.approx(p, abs=1e-9)


def test_step_up_golden(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.01), (1, "c", 0.03)], "i int, ch string, p double")
    r = detectors.step_up(rows, ["i"], "p", "ch", 0.05).first()
    assert (r["channel"], r["rejected"]) == ("b", True)
    assert r["alpha_star"] == pytest.approx(min(3 * 0.01, 3 * 0.03 / 2, 0.2))


def test_acat_extremes(spark):
    assert one(spark, detectors.acat([F.lit(1e-15), F.lit(0.5)])) < 1e-6
    assert one(spark, detectors.acat([F.lit(0.5), F.lit(0.5)])) == pytest.approx(0.5)


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 2.5, 5.0])
def test_erfc(spark, x):
    assert one(spark, erfc(F.lit(x))) == pytest.approx(math.erfc(x), abs=2e-7)


def test_wilson_without_trials(spark):
    low, high = wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)


@pytest.mark.parametrize("text", ["1.2.3", "1.2.3.256", "a.b.c.d", "", None])
def test_no_address(spark, text):
    assert one(spark, ip_number(F.lit(text).cast("string"))) is None


def test_address_round_trip(spark):
    assert one(spark, ip_number(ip_text(F.lit(3232235777)))) == 3232235777
    assert one(spark, ip_text(F.lit(3232235777))) == "192.168.1.1"


def test_wilcoxon(spark):
    from itertools import product

    def brute(d):
        d = [x for x in d if x]
        ranks = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
        up = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))]
        return min(1.0, 2 * min(sum(s <= up for s in sums), sum(s >= up for s in sums)) / len(sums))

    tests = {"a": [1, 2, 3, 4, 5, 6], "b": [0, 0], "c": [1, -1, 2, 2, -3, 0, 5, 5, 5], "d": [0.5], "e": [-1, -1, -1, 2, 2, 4, -8, 1, 3, 3]}
    rows = spark.createDataFrame([(k, float(x)) for k, d in tests.items() for x in d] + [("c", None)], "k string, d double")
    got = {r["k"]: (r["n"], r["p"]) for r in paired.wilcoxon(rows, ["k"], "d").collect()}
    assert got == {k: (sum(map(bool, d)), pytest.approx(brute(d))) for k, d in tests.items()}
    many = spark.createDataFrame([("x", float(i if i % 3 else -i)) for i in range(1, 151)] + [("y", float(i if i % 3 else -i)) for i in range(1, 401)], "k string, d double")
    p = {r["k"]: r["p"] for r in paired.wilcoxon(many, ["k"], "d").collect()}
    assert 0 < p["y"] < p["x"] < 0.01


def test_mcnemar(spark):
    rows = spark.createDataFrame([(True, False)] * 15 + [(False, True)] * 5 + [(True, True)] * 3, "a boolean, b boolean")
    r = evaluation.mcnemar(rows, F.col("a"), F.col("b")).first()
    assert (r["b"], r["c"]) == (15, 5)
    assert r["p"] == pytest.approx(math.erfc(math.sqrt(81 / 20 / 2)), abs=1e-6)


def test_bootstrap_covers_the_rate(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(h), 50) for i, h in enumerate(rng.binomial(50, 0.2, 60))], "c int, hits int, n int")
    r = evaluation.cluster_bootstrap(rows, "c", "hits", "n").first()
    assert r["low"] < r["rate"] < r["high"] and 2 < r["high"] - r["low"] < 8
    assert evaluation.cluster_bootstrap(rows, "c", "hits", "n").first() == r


def test_matched_once(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, paired.matched_once(a, b, ["k"]).collect())) == [(1, "x"), (2, "y")]
    for bad in (b.filter("k = 1"), b.unionByName(b)):
        out = paired.matched_once(a, bad, ["k"])
        with pytest.raises(Exception, match="not exactly one match"):
            out.collect()


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    recorded = paired.ledger({"t": rows})
    assert paired.proven(rows, {"t": rows.orderBy("v").repartition(3)}, recorded).count() == 2
    for changed in (rows.withColumn("v", F.coalesce("v", F.lit("~"))), rows.filter("k = 1"), rows.unionByName(rows.limit(1))):
        with pytest.raises(Exception, match="inputs differ from the ledger: t"):
            paired.proven(rows, {"t": changed}, recorded).collect()


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(a), int(rng.binomial(a, 0.6)), 50) for i, a in enumerate(rng.binomial(50, 0.3, 40))]
    r = paired.paired_bootstrap(spark.createDataFrame(rows, "c int, a int, b int, n int"), "c", "a", "b", "n", 300).first()
    assert r["low"] < r["reduction"] < r["high"] and 30 < r["reduction"] < 50 and r["p"] == pytest.approx(1 / 300)
    same = paired.paired_bootstrap(spark.createDataFrame([(i, 5, 5, 9) for i in range(9)], "c int, a int, b int, n int"), "c", "a", "b", "n", 50).first()
    assert (same["low"], same["high"], same["p"]) == (0.0, 0.0, 1.0), "arms that share draws and hits do not differ in any replicate"


def test_draws_are_not_broadcast(spark):
    """The draws, of which there are many for each unit, are dealt by unit, and no task numbers all units."""
    out = paired.paired_bootstrap(spark.range(20_000).selectExpr("id", "id % 7 AS a", "id % 3 AS b", "9 AS n"), "id", "a", "b", "n", 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [_i" in plan and "BroadcastHashJoin [_i" not in plan
    # what SQL's draws give over the same units
    con = duckdb.connect()
    sums = con.sql("SELECT sum(i % 7), sum(i % 3) FROM (SELECT unnest(range(3)) AS rep), LATERAL (SELECT CAST('0x' || md5('7:' || rep || ':' || j)[1:8] AS BIGINT) % 20000 AS i FROM range(20000) t(j)) GROUP BY rep").fetchall()
    reds = sorted(100.0 * float(a - b) / float(a) for a, b in sums)
    assert (out.first()["low"], out.first()["high"]) == pytest.approx((reds[0], reds[2]))


def test_synthesized(spark):
    row = spark.createDataFrame([("v", *[2.0] * 9)], "k string, " + ", ".join(f"{f} double" for f in synthesis.FEATURES))
    out = {r["kind"]: r for r in synthesis.synthesized(row).collect()}
    assert len(out) == 8 and out["syn_flood"]["tcp_ratio"] == 0.94 and out["slowloris"]["flow_duration_avg"] == 36.0
    assert out["carpet_bomb"]["dst_port_density"] == pytest.approx(2 * 80 * 1000 / 2.4)


def test_policy_conditions_on_missing_fields(spark):
    rows = spark.createDataFrame([("tcp", 5), (None, 7)], "proto string, port int")
    keep = lambda rules: rows.filter(filters.all_conditions(rows, rules)).count()
    assert keep([("proto", "eq", "tcp"), ("port", "le", 5)]) == 1
    assert keep([("nothing", "eq", 1)]) == 0
    assert keep([]) == 0
    assert keep([("proto", "not_in", ["udp"])]) == 1
    assert keep([("proto", "strange", 1)]) == 0


def test_fold_matches_a_loop(spark):
    x = [3.0, 60.0, 70.0, 65.0, 10.0, 90.0] * 4
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    got = {r["i"]: r for r in recursions.ewma_baseline(rows, ["k"], "i", "v", 0.1).collect()}
    m, v = x[0], 0.0
    for i in range(1, len(x)):
        assert got[i]["mean"] == pytest.approx(m) and got[i]["var"] == pytest.approx(v)
        floor = 0.02 * m if m > 50 else 1.0
        assert got[i]["z"] == pytest.approx(0.0 if i < 10 else max(-100, min(100, (x[i] - m) / max(math.sqrt(v), floor))))
        d = x[i] - m
        m, v = m + 0.1 * d, 0.9 * (v + 0.1 * d * d)


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    rows = windows(spark, sf_dir).orderBy("idx").toPandas()
    return rows[rows.train], rows[~rows.train]


def scores(df):
    return df.orderBy("idx").toPandas()["score"].to_numpy()


def test_dspot_matches_a_loop(spark, sf_dir, matrix):
    train, test = matrix
    want = np.zeros(len(test))
    for f in FEATURES:
        parts = {k: v[f].to_numpy() for k, v in train.groupby("victim")}
        res = np.concatenate([[v[i] - (v[max(0, i - 64) : i].mean() if i else v[i]) for i in range(len(v))] for v in parts.values()])
        cut = np.percentile(res, 98)
        over = res[res > cut] - cut
        scale = max(0.5 * over.mean() * (over.mean() ** 2 / (over.var() + 1e-8) + 1), 0.01) if len(over) > 2 else max(res.std(), 0.1)
        held, out = {k: list(v[-64:]) for k, v in parts.items()}, []
        for victim, x in zip(test["victim"], test[f], strict=True):
            e = x - np.mean(held[victim]) - cut
            out.append(max(0.0, e / scale))
            if e <= 0:
                held[victim] = [*held[victim], x][-64:]
        want = np.maximum(want, out)
    got = scores(detectors.drifting_peaks(detectors.long_form(windows(spark, sf_dir), FEATURES, ("idx", "victim", "train"))))
    assert np.allclose(got, want, atol=1e-9)


def test_a_million_windows_of_one_entity(spark):
    """Folds take linear time and keep only their state."""
    began = time.time()
    rows = spark.range(1_000_000).select(F.lit("one").alias("k"), "id", (F.col("id") % 100).alias("v"))
    r = recursions.ewma_baseline(rows, ["k"], "id", "v", 0.1).agg(F.count("*").alias("n"), F.max("n").alias("last")).first()
    assert (r["n"], r["last"]) == (1_000_000, 999_999)
    packets = rows.select("k", F.col("id").alias("event_id"), (F.col("id") / 10).alias("t"), F.lit(1.0).alias("cost"))
    admitted = recursions.token_bucket(packets, ["k"], 5.0, 10.0).filter("admitted").count()
    assert abs(admitted - 500_000) < 20
    assert time.time() - began < 60


def test_loda_matches_numpy(spark, sf_dir, matrix):
    train, test = (m[FEATURES].to_numpy() for m in matrix)
    want = []
    for w in detectors.projections(len(FEATURES), 20):
        a, b = train @ w, test @ w
        lo, hi = a.min(), a.max()
        place = lambda x: np.where(x == hi, 9, np.floor((x - lo) / (hi - lo) * 10)).astype(int)
        counts = np.bincount(place(a), minlength=10)
        at = place(b)
        inside = (at >= 0) & (at < 10)
        want.append(-np.log(np.where(inside, counts[np.clip(at, 0, 9)], 0) / len(a) + 1e-12))
    assert np.allclose(scores(detectors.loda_scores(windows(spark, sf_dir), FEATURES)), np.mean(want, axis=0), atol=1e-6)


def test_subspace_matches_numpy(spark, sf_dir, matrix):
    train, test = (m[FEATURES].to_numpy() for m in matrix)
    mu, sd = train.mean(axis=0), train.std(axis=0)
    a, b = (train - mu) / sd, (test - mu) / sd
    v = np.linalg.svd(a, full_matrices=False)[2][:4]
    qa, qb = ((x**2).sum(axis=1) - ((x @ v.T) ** 2).sum(axis=1) for x in (a, b))
    surprise = [-np.log(((qa >= q - 1e-9).sum() + 1) / (len(a) + 1)) for q in qb]
    want, cur = [], dict.fromkeys(range(13), 0.0)
    for s, victim in zip(surprise, matrix[1]["victim"], strict=True):
        cur[victim] = 0.5 * s + 0.5 * cur[victim]
        want.append(cur[victim])
    assert np.allclose(scores(detectors.subspace_scores(windows(spark, sf_dir), FEATURES, k=4)), want, atol=1e-6)


def test_isolation_trees():
    """Depths and distances of grown trees equal a walk of one row at a time; constant data is one leaf."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 3)), 1)
    for tree in detectors.grown(x, 4, 64, rng):
        depth, far, cuts = detectors.walked(tree, x)
        for i, row in enumerate(x):
            node, steps = tree, []
            while isinstance(node, tuple):
                f, cut, low, high = node
                steps.append(abs(row[f] - cut))
                node = low if row[f] < cut else high
            assert depth[i] == node and cuts[i] == len(steps) and far[i] == pytest.approx(sum(steps))
    assert detectors.grown(np.ones((5, 2)), 1, 64, rng) == [detectors.harmonic(5)]
    assert detectors.grown(np.empty((0, 2)), 3, 64, rng) == []


def test_deep_forest_rows_stand_alone(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i < 200, *map(float, v)) for i, v in enumerate(rng.normal(size=(260, 4)))]
    kind = "idx long, train boolean, a double, b double, c double, d double"
    scores = lambda r: {q["idx"]: q["score"] for q in detectors.deep_isolation_forest(spark.createDataFrame(r, kind), list("abcd")).collect()}
    every, some = scores(rows), scores(rows[:220])
    assert len(every) == 60 and all(some[i] == pytest.approx(every[i]) for i in range(200, 220))
    assert set(scores([r for r in rows if not r[1]]).values()) == {0.5}


@pytest.mark.parametrize("detector", [detectors.isolation_forest, detectors.deep_isolation_forest, detectors.nearest_hyperspheres])
def test_trees_and_spheres_find_outliers(spark, detector):
    rng = np.random.default_rng(3)
    inner, outer = rng.normal(size=(400, 4)), rng.normal(size=(20, 4)) + 6
    rows = [(i, i < 300, *map(float, x)) for i, x in enumerate(np.vstack([inner, outer]))]
    df = spark.createDataFrame(rows, "idx long, train boolean, a double, b double, c double, d double")
    got = {r["idx"]: r["score"] for r in detector(df, ["a", "b", "c", "d"]).collect()}
    assert min(got[i] for i in range(400, 420)) > np.percentile([got[i] for i in range(300, 400)], 95)
    assert all(0 <= s <= 1 for s in got.values())


def test_sketches_are_close(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    exact = {r["label"]: r["n"] for r in p.groupBy("label").agg(F.count_distinct("src").alias("n")).collect()}
    est = {r["label"]: r["distinct"] for r in sketches.merged_distinct(sketches.distinct_sketches(p.withColumn("d", F.to_date("ts")), ["label", "d"], "src"), ["label"]).collect()}
    assert all(abs(est[k] - n) <= max(2, 5 * sketches.standard_error() * n) for k, n in exact.items())
    counts = {(r["label"], r["src"]): r["count"] for r in p.groupBy("label", "src").count().collect()}
    cells = sketches.count_min(p, ["label"], "src")
    for r in sketches.estimated(cells, p.select("label", "src").distinct(), ["label"], "src").collect():
        assert counts[r["label"], r["src"]] <= r["estimate"] <= counts[r["label"], r["src"]] + 5


def test_clamp(spark):
    assert [one(spark, clamp(F.lit(x), 0.0, 1.0)) for x in (-1.0, 0.5, 7.0)] == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("parts", [2, 3, 64])
def test_running_sums_in_parts(spark, parts):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 40, 300), np.full(200, 7), rng.integers(0, 10_000, 300)])
    rows = spark.createDataFrame([(int(k % 2), float(v)) for k, v in enumerate(x)], "k int, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in recursions.running(rows, ["k"], "v", ["n"], parts).collect():
        assert r["upto_n"] == sum(1 for i, v in enumerate(x) if i % 2 == r["k"] and v <= r["v"])
    every = recursions.running(rows.groupBy("v").agg(F.sum("n").alias("n")), [], "v", ["n"], parts)
    assert max(r["upto_n"] for r in every.collect()) == len(x)


def test_quantiles(spark):
    """Exact, whatever the ranges: ties, one value, nulls and a long tail; and no key's values are one buffer."""
    import numpy as np

    from netweir.operators import traffic

    rng = np.random.default_rng(7)
    own = {"a": rng.lognormal(0, 4, 5001), "b": rng.integers(0, 3, 800).astype(float), "c": np.array([4.5]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [("a", None)], "k string, x double")
    shares = {"least": 0.0, "half": 0.5, "high": 0.95, "most": 1.0}
    out = traffic.quantiles(df, ["k"], "x", shares)
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == set(own)
    for k, v in own.items():
        for name, share in shares.items():
            assert abs(got[k][name] - np.quantile(v, share)) <= 1e-9 * max(1, abs(np.quantile(v, share)))
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
