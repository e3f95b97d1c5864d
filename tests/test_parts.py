"""Operators without SQL, and edges of those that have it, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import changes, cluster, features, models, more, pairs, resample, spatial, splits, validation
from quadrille.operators.quantiles import quantiles
from quadrille.plans.components import Registry, analyzer, fresh
from quadrille.sources import io, stores
from quadrille.streaming import events


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [None if rng.random() < 0.15 else float(max(0, rng.normal(c, 0.6))) for c in ((2, 9, 2, 9), (9, 2, 9, 2), (5, 5, 0, 0))[k % 3]]) for k in range(240)]
    return spark.createDataFrame(rows, "id long, x array<double>"), rows


def distance(a, b, least=2):
    both = [(u, v) for u, v in zip(a, b, strict=True) if u is not None and v is not None]
    if len(both) < least:
        return math.inf
    den = sum(u + v for u, v in both)
    return sum(abs(u - v) for u, v in both) / den if den else 0.0


def test_distances_of_all_pairs(samples):
    df, rows = samples
    all_pairs = {(i, j): distance(a, b) for i, a in rows for j, b in rows if i != j}
    got = pairs.met(df, lambda a, b: {"i": a["id"], "n": np.full(len(a["id"]), len(b["id"]))}, "i long, n long", block_rows=50)
    assert {r.i: r.s for r in got.groupBy("i").agg(F.sum("n").alias("s")).collect()} == dict.fromkeys(range(240), 240)
    near = {(r.i, r.j): r.distance for r in pairs.pairwise(df, 0.2).collect()}
    assert near.keys() == {(i, j) for (i, j), d in all_pairs.items() if i < j and d <= 0.2}
    assert all(near[p] == pytest.approx(all_pairs[p]) for p in near)
    for r in pairs.distance_summary(df, 0.2).collect():
        own = [d for (i, _), d in all_pairs.items() if i == r.id and d <= 0.2]
        assert r.pairs == len(own) and (not own or (r.least, r["mean"], r.greatest) == (pytest.approx(min(own)), pytest.approx(sum(own) / len(own)), pytest.approx(max(own))))
    labels = {i: i % 4 for i, _ in rows}
    scores = []
    for i, _ in rows:
        means = {c: np.mean([min(d, 1.0) if d < math.inf else 1.0 for (a, b), d in all_pairs.items() if a == i and labels[b] == c]) for c in range(4)}
        a, b = means.pop(labels[i]), min(means.values())
        scores.append((b - a) / max(a, b))
    assert pairs.silhouette(df.withColumn("label", F.col("id") % 4)).first()[0] == pytest.approx(np.mean(scores))
    assert pairs.silhouette(df.limit(1).withColumn("label", F.lit(0))).first()[0] in (None, 0.0)


def test_kmeans_plus_plus_draws_by_squared_distance(spark, samples):
    df, rows = samples
    centres = cluster.initial_centres(df, 4, seed=7)
    complete = [(i, x) for i, x in rows if None not in x]
    places = {step: {r.id: r.u for r in df.select("id", cluster._place(step, 7).alias("u")).collect()} for step in range(4)}
    want = [min(complete, key=lambda r: (places[0][r[0]], r[0]))[1]]
    for step in range(1, 4):
        rate = {i: min(distance(x, c) for c in want) ** 2 for i, x in complete}
        able = [(i, x) for i, x in complete if rate[i] > 0]
        want.append(min(able, key=lambda r: (-math.log(places[step][r[0]]) / rate[r[0]], r[0]))[1])
    assert np.allclose(centres, want)
    # Chances are in proportion to the squares: over many seeds, a far sample is drawn more often than a near one.
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.2]), (2, [1.0, 9.0])], "id long, x array<double>")
    second = [tuple(cluster.initial_centres(few, 2, seed=s)[1]) for s in range(8)]
    assert second.count((1.0, 9.0)) + second.count((1.0, 1.0)) + second.count((1.0, 1.2)) == 8 and second.count((1.0, 9.0)) >= 3
    same = spark.createDataFrame([(k, [2.0, 3.0]) for k in range(5)], "id long, x array<double>")
    assert cluster.initial_centres(same, 3).tolist() == [[2.0, 3.0]] * 3


def test_best_number_of_clusters(samples):
    df, _ = samples
    assert cluster.best_k({2: 0.1, 3: 0.7, 4: 0.7}, "silhouette") == 3 and cluster.best_k({2: 0, 3: 0, 4: 0}, "middle") == 3
    best, scores = cluster.choose_k(df, [2, 3, 4], "silhouette", iterations=6)
    assert best == 3 and scores[3] > 0.5
    assert cluster.choose_k(df, [2, 3, 4, 5], "elbow", iterations=6)[0] == 3


def test_starts_of_a_map(spark, samples):
    df, rows = samples
    x = np.array([[np.nan if v is None else v for v in r] for _, r in rows])
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    dev = filled - filled.mean(axis=0)
    _, _, axes = np.linalg.svd(dev, full_matrices=False)
    axes = axes[:2] * np.sign(axes[np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
    s = dev @ axes.T
    want = [np.maximum(filled.mean(axis=0) + a * axes[0] + b * axes[1], 0) for b in np.linspace(s[:, 1].min(), s[:, 1].max(), 3) for a in np.linspace(s[:, 0].min(), s[:, 0].max(), 4)]
    assert np.allclose(cluster.som_start(df, (3, 4), "pca"), want, atol=1e-8)
    assert cluster.som_start(df, (2, 2), "stratified").shape == (4, 4)
    trials = [cluster.unit_sums(df, cluster.initial_centres(df, 4, 42 + t, method="random"))[3] for t in range(5)]
    assert cluster.unit_sums(df, cluster.som_start(df, (2, 2), "best_of"))[3] == pytest.approx(min(trials))
    p = spark.createDataFrame([(0.0, 10.0), (8.0, 20.0), (2.0, 12.0)], "lon double, lat double")
    assert cluster.neuron_places(p, (2, 3)).tolist() == [[0, 10], [4, 10], [8, 10], [0, 20], [4, 20], [8, 20]]


def test_learning_rate_and_convergence():
    assert cluster.next_rate(0.6, 0.3, math.inf) == pytest.approx(0.57)  # no best yet: not an improvement
    assert cluster.next_rate(0.4, 0.30, 0.40) == pytest.approx(0.42)
    assert cluster.next_rate(0.4, 0.39, 0.40) == 0.4 and cluster.next_rate(0.4, 0.4, 0.4) == pytest.approx(0.392)
    assert cluster.next_rate(0.4, 0.5, 0.4) == pytest.approx(0.38) and cluster.next_rate(0.79, 0.3, 0.4) == 0.8
    assert cluster.next_rate(0.4, 0.6, 0.7) == 0.5 and cluster.next_rate(0.4, 0.05, 0.06) == 0.1
    assert cluster.converged([0.5] * 11, 0.0, 0) == "stable rate" and cluster.converged([0.5] * 10, 0.0, 0) is None
    assert cluster.converged([0.1], 0.71, 0) == "coherence" and cluster.converged([0.1], 0.0, 50) == "patience"


def test_variable_rate_training(samples):
    df, rows = samples
    neurons, history, ended = cluster.train_geo_som(df, (2, 2), epochs=30)
    assert [h["epoch"] for h in history] == list(range(len(history))) and len(history) in (11, 21, 30)
    assert (ended is None) == (len(history) == 30)
    rate, best = 0.5, math.inf
    for h in history:
        rate = cluster.next_rate(rate, h["error"], best)
        best = min(best, h["error"])
        assert h["rate"] == rate and h["radius"] == pytest.approx(2 / 3 * (1 - h["epoch"] / 30) + h["epoch"] / 30)
    # The first epoch, plainly.
    start = cluster.som_start(df, (2, 2), "pca")
    at = [(n // 2, n % 2) for n in range(4)]
    num, den = np.zeros((4, 4)), np.zeros((4, 4))
    for _, x in rows:
        d = [distance(x, c) for c in start]
        if min(d) < math.inf:
            best_unit = int(np.argmin(d))
            for n in range(4):
                h = math.exp(-((at[n][0] - at[best_unit][0]) ** 2 + (at[n][1] - at[best_unit][1]) ** 2) / (2 * (2 / 3) ** 2))
                for c, v in enumerate(x):
                    if v is not None:
                        num[n, c], den[n, c] = num[n, c] + h * v, den[n, c] + h
    one = cluster.train_geo_som(df, (2, 2), epochs=1)[0]
    assert np.allclose(one, start + 0.25 * (num / den - start))
    assert cluster.train_geo_som(df, (2, 2), epochs=30, coherence=lambda n: 0.9)[2] == "coherence"
    assert cluster.importance(neurons).sum() == pytest.approx(1)
    # Maps have no distance between a sample and a unit that are both 0; clusters have one of 0.
    nothing = df.limit(1).select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("x"))
    zeros = np.zeros((2, 2))
    assert cluster.unit_sums(nothing, zeros)[2].sum() == 0 and cluster.assign(nothing, zeros).first().distance == 0.0


def test_legacy_maps(samples):
    df, _ = samples
    hat = cluster.neighbourhood((1, 3), 1.0, "mexican_hat")
    assert hat[0, 0] == 1.0 and hat[0, 2] == pytest.approx(2 * math.exp(-2) - math.exp(-0.5))
    assert cluster.neighbourhood((1, 3), 1.0, "bubble").tolist() == [[1, 1, 0], [1, 1, 1], [0, 1, 1]]
    for kind in ("gaussian", "bubble", "mexican_hat"):
        _, history = cluster.train_legacy_som(df, (2, 2), epochs=5, kind=kind)
        assert history[0]["rate"] == 0.5 and history[-1]["rate"] == pytest.approx(0.5 * (0.01 / 0.5) ** 0.8)
        assert history[-1]["error"] <= history[0]["error"] + 0.05


def test_lattice_folds_and_buffer(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(-50, 50, size=(400, 2))
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, lon double, lat double")
    low, high = xy.min(axis=0), xy.max(axis=0)
    edges = [np.linspace(low[a], high[a], 4) for a in range(2)]
    want = {k: next((i * 3 + j for i in range(3) for j in range(3) if edges[0][i] <= x < edges[0][i + 1] and edges[1][j] <= y < edges[1][j + 1]), 0) for k, (x, y) in enumerate(xy)}
    folds = splits.lattice_folds(p, 5).persist()
    got = {r.id: (r.block, r.fold) for r in folds.collect()}
    assert {k: b for k, (b, _) in got.items()} == want
    by_fold = {f: {b for b, g in got.values() if g == f} for f in range(5)}
    assert sorted(b for s in by_fold.values() for b in s) == sorted(set(want.values()))
    assert [len(by_fold[f]) for f in range(5)] == [1, 1, 1, 1, 5]
    for f in (0, 4):
        train, test = splits.fold_split(folds, f, 6.0)
        tests = [k for k, (_, g) in got.items() if g == f]
        assert {r.id for r in test.collect()} == set(tests)
        far = {k for k in got if k not in tests and min(np.hypot(*(xy[k] - xy[q])) for q in tests) > 6.0}
        assert {r.id for r in train.collect()} == far
    assert {r.fold for r in splits.lattice_folds(p.where("id < 3"), 9).collect()} == {8}


def test_planar_moran(spark):
    rng = np.random.default_rng(8)
    xy, v = rng.uniform(0, 10, size=(60, 2)), rng.normal(size=60)
    v += xy[:, 0]
    p = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(xy, v, strict=True))], "id long, lon double, lat double, value double")
    d = np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1))
    for threshold in (None, 2.0):
        w = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0) if threshold is None else ((d <= threshold) & ~np.eye(60, dtype=bool)).astype(float)
        rows = w.sum(axis=1, keepdims=True)
        w = w / np.where(rows == 0, 1, rows)
        z = v - v.mean()
        want = 60 * (w * np.outer(z, z)).sum() / (w.sum() * (z**2).sum())
        got = pairs.planar_moran(p, threshold).first()
        assert got.moran_i == pytest.approx(want) and got.expected == pytest.approx(-1 / 59)
        assert 0 <= got.p_value <= 1 and (got.z_score is None) == (got.p_value == 1.0 and got.z_score is None)
        if got.z_score is not None:
            assert got.p_value == pytest.approx(math.erfc(abs(got.z_score) / math.sqrt(2)))
    assert pairs.planar_moran(p.limit(0)).first().n == 0 and pairs.planar_moran(p.withColumn("value", F.lit(1.0))).first().p_value == 1.0


def test_quantiles_of_skewed_values(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(3000, 7.0), rng.normal(size=5000), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.625, 0.75, 0.99, 1.0]
    assert quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles(df.where("v > 1e10"), "v", [0.5]) is None and quantiles(df.where("v = 1e9"), "v", [0.1, 1.0]) == [1e9, 1e9]


def test_exact_split_sizes(spark):
    for n, train, validation in ((1, 0.7, 0.1), (999, 0.7, 0.1), (5000, 0.5, 0.5), (5000, 0.0, 0.3)):
        got = {r.split: r["count"] for r in splits.exact_split(spark.range(n), "id", train, validation).groupBy("split").count().collect()}
        a, b = int(n * train), int(n * validation)
        assert got == {k: v for k, v in (("train", a), ("validation", b), ("test", n - a - b)) if v}
    ranked = splits.exact_split(spark.range(5000), "id", 0.6, 0.2).select("split", splits.hash_order("id").alias("h")).orderBy("h").collect()
    assert [r.split for r in ranked] == ["train"] * 3000 + ["validation"] * 1000 + ["test"] * 1000


def test_as_of(spark):
    rng = np.random.default_rng(3)
    marks, asks = sorted(set(rng.integers(0, 5000, 40).tolist())), rng.integers(0, 6000, 300).tolist()
    e = spark.createDataFrame([(a, n) for n, a in enumerate(asks)], "at long, n long")
    m = spark.createDataFrame([(x, x * 10) for x in marks], "at long, mark long")
    got = {r.n: r.mark for r in more.as_of(e, m, width=16).collect()}
    assert got == {n: max((x * 10 for x in marks if x <= a), default=None) for n, a in enumerate(asks)}


def test_nearest_keeps_few_of_a_dense_place(spark):
    rows = [(1, j, float(j % 50)) for j in range(2, 2000)] + [(2, 1, 5.0)]
    got = sorted((r.i, r.j) for r in spatial.nearest(spark.createDataFrame(rows, "i long, j long, km double"), 8).collect())
    want = sorted(((1, j) for _, j in sorted((float(j % 50), j) for j in range(2, 2000))[:8]))
    assert got == [*want, (2, 1)]


def test_nearest_reference_meets_all_references(spark):
    s = spark.createDataFrame([(k, float(k)) for k in range(20)], "id long, x double")
    refs = spark.createDataFrame([(k, k / 500) for k in range(9000)], "ref int, y double")
    got = spatial.nearest_reference(s, refs, lambda a, b: F.abs(F.col(a) - F.col(b))).collect()
    assert {(r.id, r.ref) for r in got} == {(k, min(k * 500, 8999)) for k in range(20)}


def test_resample_in_bands(spark):
    p = spark.createDataFrame([(a, b, float(a * b % 7)) for a in range(24) for b in range(20)], "row_idx int, col_idx int, value double")
    cells = lambda df: {(r.target_row, r.target_col): r.value for r in df.collect()}
    for method in ("mean", "sum", "max"):
        assert cells(resample.resample_chunks(p, method, 4, (24, 20), 8)) == pytest.approx(cells(resample.resample(p, method, 4.0, (24, 20))))
    with pytest.raises(ValueError):
        resample.resample_chunks(p, "mean", 4, (24, 20), 6)


def test_completed_units(spark):
    rows = [("p", None, "phase", 3, 0), ("a", "p", "step", 10, 0), ("b", "p", "step", 7, 0), ("c", "p", "step", 5, 5), ("a1", "a", "task", 4, 4), ("a2", "a", "task", 8, 8), ("b1", "b", "task", 4, 1), ("b2", "b", "task", 0, 0), ("x", None, "step", 9, 2)]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, level string, total_units long, completed_units long")
    got = {r.node_id: (r.completed_units, r.percent) for r in changes.completed_units(df).collect()}
    assert got["a"] == (10, 100.0) and got["b"] == (0, 0.0) and got["p"] == (2, pytest.approx(200 / 3)) and got["x"] == (2, pytest.approx(200 / 9))


def test_nested_models(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = 2 * x[:, 0] + 0.8 * x[:, 1] + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    out = models.nested_workflow(df, [["a"], ["a", "b"]], "y")
    lls = []
    for names, r in zip((["a"], ["a", "b"]), out, strict=True):
        design = np.column_stack([x[:, : len(names)], np.ones(300)])
        rss = ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()
        lls.append(-150 * (math.log(2 * math.pi * rss / 300) + 1))
        assert r["aic"] == pytest.approx(2 * (len(names) + 2) - 2 * lls[-1]) and r["r2"] == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    assert out[1]["statistic"] == pytest.approx(2 * (lls[1] - lls[0])) and out[1]["supported"] and out[0]["p"] is None
    assert out[1]["p"] == pytest.approx(math.erfc(math.sqrt(out[1]["statistic"] / 2)), abs=1e-12)


def test_validators(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id long, v double")
    positive = validation.Check("positive", F.col("v") >= 0)
    out = validation.validated(df, validation.Composite("all", [positive, validation.Composite("inner", [validation.Check("small", F.col("v") < 3, "warning"), positive.conditional(F.count("v") > 5)])]))
    got = {r.validator: (r.failed, r.skipped, r.valid) for r in out.collect()}
    assert got == {"all.positive": (2, False, False), "all.inner.small": (2, False, True), "all.inner.conditional(positive)": (0, True, True)}
    assert validation.is_valid(out).first().asDict() == {"valid": False, "info": 0, "warning": 1, "error": 1, "critical": 0}
    empty = validation.validated(df.limit(0), positive).first()
    assert (empty.failed, empty.skipped, empty.valid) == (0, True, True) or empty.failed == 0
    with pytest.raises(ValueError):
        validation.Check("x", F.lit(True), "fatal")
    found = validation.value_ranges(spark.createDataFrame([(5000.5,), (-2.0,)], "value double"), "vertebrates").first()
    assert (found.issues, found.warnings, found.valid) == ("negative,far above", "fractional", False)
    assert validation.value_ranges(df.limit(0).select(F.col("v").alias("value")), "plants").first().issues == "no data"


def test_stores(spark, tmp_path):
    store = stores.ResultStore(spark, f"{tmp_path}/results")
    assert store.list().count() == 0
    for n, name in enumerate("abc"):
        store.save(name, spark.range(n + 1), {"n": n}, at=n)
    store.save("a", spark.range(7), {"n": 9}, at=5)
    assert [r.experiment for r in store.list().collect()] == ["a", "c", "b"] and store.load("a").count() == 7
    assert store.delete("c", at=6) and not store.delete("c", at=7) and [r.experiment for r in store.list(1).collect()] == ["a"]
    with pytest.raises(KeyError):
        store.load("c")
    cache = stores.ResultCache(spark, f"{tmp_path}/cache", ttl=10)
    assert cache.get("k", 0) is None
    for n, name in enumerate(("k", "l", "m")):
        cache.put(name, spark.range(10), at=n + 1)
    assert cache.get("k", 9).count() == 10 and cache.evict(20, at=9.5) == ["l"] and cache.get("l", 9.6) is None
    assert cache.get("m", 20) is None and cache.get("m", 20.5) is None  # too old, then gone
    damaged = cache._state().where("key = 'k'").first().path
    spark.range(3).write.mode("overwrite").parquet(damaged)
    assert cache.get("k", 10) is None and cache.stats().first().asDict() == {"entries": 0, "rows": 0, "hits": 1, "misses": 5, "hit_rate": pytest.approx(1 / 6)}


def test_exports_go_whole_or_not_at_all(spark, tmp_path):
    good, bad = spark.range(5), spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    assert io.export_chunks([good, good], f"{tmp_path}/a.csv") == 2 and spark.read.csv(f"{tmp_path}/a.csv", header=True).count() == 10
    with pytest.raises(Exception, match="no"):
        io.export_chunks([good, bad], f"{tmp_path}/b.csv")
    assert not (tmp_path / "b.csv").exists()
    assert io.export_chunks([], f"{tmp_path}/c.csv") == 0
    with pytest.raises(ValueError):
        io.write_climate(spark.createDataFrame([(200.0, 1.0)], "x double, y double"), f"{tmp_path}/d")
    with pytest.raises(ValueError):
        io.climate_table(spark.range(1))
    assert not (tmp_path / "d").exists()


def test_log_sink_falls_back(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    (tmp_path / "out").write_text("a file, not a folder")
    stream = events.event_stream(spark, f"{tmp_path}/in", rows.schema)
    (tmp_path / "out.dropped").mkdir()
    events.log_sink(stream, f"{tmp_path}/out", f"{tmp_path}/check", capacity=20, fallback=f"{tmp_path}/fallback")
    assert sorted(r.event_id for r in spark.read.json(f"{tmp_path}/fallback").collect()) == list(range(20))
    assert spark.read.parquet(f"{tmp_path}/out.dropped").select("kept", "dropped").first()[:] == (20, 30)


def test_feature_builders(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, None)], "a double, b double")
    b = features.FeatureBuilder("share", {"total": F.sum("a")}, lambda s: {"a_share": F.col("a") / s["total"]}, ("a",))
    with pytest.raises(ValueError):
        b.transform(df)
    with pytest.raises(ValueError):
        b.fit(df.drop("a"))
    assert [r.a_share for r in b.fit(df).transform(df.withColumn("a", F.col("a") * 2)).collect()] == [0.5, 1.5] and b.names == ["a_share"]
    plain = features.ecological_features(spark.createDataFrame([(30.0,)], "latitude double")).first()
    assert plain.ecological_placeholder_1 == pytest.approx(0.05) and plain.ndvi_placeholder == 0.0
    veg = features.ecological_features(spark.createDataFrame([(1.0, 3.0, None), (None, 2.0, None)], "ndvi double, evi double, lai double")).collect()
    assert veg[0].vegetation_seasonality == pytest.approx(math.sqrt(2) / 2) and veg[1].vegetation_seasonality is None


def test_components(spark, tmp_path):
    registry = Registry()
    model = registry.decorator("model")
    model("line", formats=["csv"])(lambda: 1)
    assert registry.get("model", "none", "line")() == 1 and registry.listed() == [("model", "line", "csv", 0.0, math.inf)]
    with pytest.raises(ValueError):
        model("line")
    with pytest.raises(ValueError):
        analyzer("none")
    assert analyzer("geo_som") is cluster.train_geo_som and not fresh(spark, f"{tmp_path}/nothing", 0.0)


def test_stages_are_tried_again_or_fail(spark, tmp_path):
    from quadrille.plans.stages import Stages

    seen, tries = [], []
    stages = Stages(spark, f"{tmp_path}/s", retries=2, progress=lambda *x: seen.append(x[:2]))

    def broken(text):
        tries.append(text)
        raise OSError(text)

    for text, times in (("timeout", 3), ("wrong column", 1)):
        tries.clear()
        with pytest.raises(OSError, match=text):
            stages.run("a", lambda text=text: broken(text))
        assert len(tries) == times
    assert seen == [("a", "again"), ("a", "again"), ("a", "failed"), ("a", "failed")]
    assert stages.run("a", lambda: spark.range(3)).count() == 3 and stages.run("a", lambda: broken("not asked")).count() == 3
    stages.clear("a")
    assert stages.run("a", lambda: spark.range(4)).count() == 4


def test_tiles_fit_together_at_their_edges(spark):
    from quadrille.plans.stages import tiled

    rng = np.random.default_rng(1)
    grid = rng.normal(size=(23, 17))
    p = spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(23) for c in range(17)], "row_idx int, col_idx int, value double")

    def shifted(x):  # each pixel's right neighbour: wrong at a tile's edge without a halo
        return np.concatenate([x[:, 1:], np.full((len(x), 1), np.nan)], axis=1)

    got = {(r.row_idx, r.col_idx): r.value for r in tiled(p, 5, 1, shifted, (23, 17)).collect()}
    assert got == {(r, c): grid[r, c + 1] for r in range(23) for c in range(16)}
    assert tiled(p.limit(0), 5, 1, shifted, (23, 17)).count() == 0
