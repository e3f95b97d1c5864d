"""Literal results, and rules that random draws must keep."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import distance as d
from quadrille.functions import geo as g
from quadrille.functions.basic import clip_cast, round6
from quadrille.operators import changes, clean, cluster, features, merge, models, resample, spatial, splits
from quadrille.plans.components import Registry, default_registry
from quadrille.sources import grids
from quadrille.streaming import events as ev


def pixels(spark, rows):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "row_idx int, col_idx int, value double")


def cells(df):
    return {(r.target_row, r.target_col): r.value for r in df.collect()}


def test_outer_merge(spark):
    a = spark.createDataFrame([(-180.0, 90.0, 1.0), (-179.0, 90.0, 2.0), (-178.0, 90.0, 3.0)], "x double, y double, value double")
    b = spark.createDataFrame([(-180.0, 90.0, 10.0), (-179.0, 90.0, 20.0), (-177.0, 90.0, 30.0)], "x double, y double, value double")
    got = {r.x: (r.a, r.b) for r in merge.coordinate_merge({"a": a, "b": b}).collect()}
    assert got == {-180.0: (1.0, 10.0), -179.0: (2.0, 20.0), -178.0: (3.0, None), -177.0: (None, 30.0)}


def mapped(spark, values, weights):
    rows = [(0, k, float(v), 0, 0, w) for k, (v, w) in enumerate(zip(values, weights, strict=True))]
    return spark.createDataFrame(rows, "row_idx int, col_idx int, value double, target_row int, target_col int, weight double")


def test_weighted_means(spark):
    assert cells(resample.weighted_mean(mapped(spark, [1, 2, 3, 4], [0.25] * 4))) == {(0, 0): 2.5}
    assert cells(resample.weighted_mean(mapped(spark, [1, -999, 3, 4], [0.25] * 4), -999.0))[0, 0] == pytest.approx(8 / 3)
    assert cells(resample.weighted_mean(mapped(spark, [10, 20, 30, 40], [0.4, 0.2, 0.3, 0.1])))[0, 0] == pytest.approx(21)
    assert cells(resample.weighted_mean(mapped(spark, [-999] * 4, [0.25] * 4), -999.0)) == {(0, 0): -999.0}
    assert cells(resample.weighted_mean(mapped(spark, [-999] * 4, [0.25] * 4), -999.0, 0.0)) == {(0, 0): 0.0}


def test_majority(spark):
    assert cells(resample.majority(mapped(spark, [1, 1, 2, 1], [0.25] * 4))) == {(0, 0): 1.0}
    assert cells(resample.majority(mapped(spark, [1, 2, 2, 3], [0.1, 0.3, 0.4, 0.2]))) == {(0, 0): 2.0}
    assert cells(resample.majority(mapped(spark, [2, 1, 1, 2], [0.25] * 4))) == {(0, 0): 2.0}
    assert cells(resample.majority(mapped(spark, [-1, -1, -1, 5], [0.25] * 4), -1.0)) == {(0, 0): 5.0}
    assert cells(resample.majority(mapped(spark, [-1] * 4, [0.25] * 4), -1.0)) == {(0, 0): -1.0}


def test_blocks(spark):
    square = np.arange(16).reshape(4, 4)
    assert cells(resample.block_aggregate(pixels(spark, square), 2, 4, 4)) == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}
    assert cells(resample.block_sum(pixels(spark, [[1, 2], [3, 4]]), (2, 2), (1, 1))) == {(0, 0): 10.0}
    assert cells(resample.block_aggregate(pixels(spark, np.ones((5, 5))), 2, 5, 5, "sum")) == {(a, b): 4.0 for a in (0, 1) for b in (0, 1)}
    quarter = resample.redistributed(resample.area_mapping(pixels(spark, [[100]]), 0.5))
    assert cells(quarter) == {(a, b): 25.0 for a in (0, 1) for b in (0, 1)}
    assert cells(resample.block_sum(pixels(spark, np.full((4, 4), -9.0)), (4, 4), (2, 2), -9.0)) == {(a, b): 0.0 for a in (0, 1) for b in (0, 1)}
    assert cells(resample.block_sum(pixels(spark, np.full((6, 6), -9.0)), (6, 6), (2, 2), -9.0))[0, 0] == -9.0


def test_partial_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0], [2.0, 3.0, 5.0, None]), ([1.0, None, None, None], [1.0, 2.0, 3.0, 4.0]), ([0.0, 0.0, None, None], [0.0, 0.0, 1.0, 1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(d.partial_bray_curtis("x", "y")).collect()] == [0.25, None, 0.0]
    assert [r[0] for r in df.select(d.weighted_bray_curtis("x", "y", F.array(*map(F.lit, [1.0] * 4)))).collect()][1] == math.inf


def test_geometry(spark):
    one = spark.range(1)
    assert 340 < one.select(g.haversine_km(F.lit(-0.1278), F.lit(51.5074), F.lit(2.3522), F.lit(48.8566))).first()[0] < 350
    grid = grids.cubic_grid(spark, (0.0, 0.0, 3.0, 3.0), 1.0, 111000).collect()
    assert len(grid) == 9 and all(r.cell_id.startswith("C111000_") and r.area_km2 > 0 for r in grid)
    cell = lambda x, y: one.select(g.cell_of(F.lit(x), F.lit(y), minx=0.0, miny=0.0, size=0.1, resolution=10000)).first()[0]
    assert cell(0.0, 0.0) == "C10000_00000_00000" and cell(-1.0, 5.0) is None
    assert one.select(round6(F.lit(0.0000005)), round6(F.lit(0.0000015)), clip_cast(F.lit(1e12), "int")).first()[:] == (0.0, 2e-06, 2**31 - 1)


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for k in range(150)] + [(200, 179.9, 10.0), (201, -179.9, 10.0), (202, 0.0, 89.9), (203, 180.0, 89.9), (204, -180.0, -90.0)]
    p = spark.createDataFrame(rows, "id long, lon double, lat double")
    b = p.toDF("j", "lon2", "lat2")
    want = {(r.id, r.j) for r in p.crossJoin(b).where("id <> j").withColumn("km", g.haversine_km("lon", "lat", "lon2", "lat2")).where("km <= 1500").collect()}
    got = [(r.i, r.j) for r in spatial.near_pairs(p, 1500.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cleaning_order(spark):
    df = pixels(spark, [[-5, 10, 10, 10] * 4] * 16).withColumn("value", F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 1), 1e5).otherwise(F.col("value")))
    out = clean.clean_tiles(df, "all")
    assert out.agg(F.min("clean"), F.sum(F.col("was_negative").cast("int")), F.sum(F.col("was_outlier").cast("int"))).first()[:] == (0.0, 64, 1)


def test_normalisation_round_trip(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,), (9.0,)], "a double")
    for method in ("standard", "minmax", "robust"):
        params = clean.normalisation(df, ["a"], method)
        back = clean.denormalised(clean.normalised(df, params, None), params)
        assert [r.a for r in back.collect()] == [pytest.approx(1.0), pytest.approx(5.0), None, pytest.approx(9.0)]
        assert clean.normalised(df, params).collect()[2].a == 0.0


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert sorted((r.k, r.v) for r in changes.upserted(old, new, ["k"], "o").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_kmeans_and_som_improve(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [None if rng.random() < 0.15 else float(max(0, rng.normal(c, 0.5))) for c in ((2, 9, 2, 9), (9, 2, 9, 2), (5, 5, 0, 0))[k % 3]]) for k in range(150)]
    samples = spark.createDataFrame(rows, "id long, x array<double>")
    _, labelled, inertia = cluster.kmeans(samples, 3, iterations=8)
    start = cluster.assign(samples, cluster.initial_centres(samples, 3)).agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    assert inertia <= start + 1e-9
    neurons, errors = cluster.train_som(samples, (2, 2), epochs=6)
    assert errors[-1] <= errors[0] + 1e-9 and neurons.shape == (4, 4)
    assert cluster.grid_size(10**6) == 31 and cluster.best_k({2: 100.0, 3: 20.0, 4: 18.0, 5: 17.0}) == 3


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - x[:, 1] + 5 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w, b = models.ridge(df, ["a", "b"], "y", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)) and b == pytest.approx(y.mean() - w @ x.mean(0))
    assert models.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and models.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert models.stars(0.0005) == "***"


def test_formula():
    assert features.parse_formula("y ~ a + b:c + d*e + log(f + 1)") == ("y", [("a",), ("b", "c"), ("d",), ("e",), ("d", "e"), ("log(f + 1)",)])
    with pytest.raises(ValueError):
        features.parse_formula("y a")


def test_splits(spark):
    p = spark.range(100).selectExpr("id", "cast(id * 3.6 - 180 AS double) AS lon", "cast((id * 7) % 180 - 90 AS double) AS lat")
    sizes = {r.split: r["count"] for r in splits.exact_split(p, "id", 0.7, 0.15).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "validation": 15, "test": 15}
    folds = splits.block_folds(p, 1000.0, 4).select("block", "fold").distinct()
    assert folds.count() == folds.select("block").distinct().count() and {r.fold for r in folds.collect()} == {0, 1, 2, 3}
    train, test = p.where("id % 4 <> 0"), p.where("id % 4 = 0")
    left = spatial.buffer_excluded(train, test, 800.0)
    assert spatial.near_pairs(left, 800.0, test).count() == 0


def test_registry():
    r = Registry()
    r.register("model", "a", formats=["csv"], resolutions=(0, 1))(lambda: 1)
    assert r.find("model", format="csv", resolution=0.5) == ["a"] and r.get("model", "b", "a")() == 1
    with pytest.raises(KeyError):
        r.get("model", "b")
    assert "kmeans" in default_registry().kinds["analyzer"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 7) AS ts", "id % 5 AS user_id", "concat('t', id % 3) AS event_type", "cast(id % 11 AS double) AS value", "'{}' AS props")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = ev.event_stream(spark, f"{tmp_path}/in", rows.schema, 2)
    ev.run_available(ev.windowed(stream, "1 minute", delay="2 hours"), f"{tmp_path}/out", f"{tmp_path}/check", "append")
    got = {(r.start, r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.event_type, r.n) for r in ev.windowed(rows, "1 minute").collect()}
    assert got <= want
    ev.run_available(ev.rate_limited(stream, 3600), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == ev.rate_limited(rows, 3600).count()


def test_empty_inputs(spark):
    p = spark.createDataFrame([], "row_idx int, col_idx int, value double")
    at = merge.with_coordinates(p, minx=0.0, maxy=1.0, resolution=1.0)
    assert merge.coordinate_merge({"a": at, "b": at}).count() == 0
    assert resample.resample(p, "mean", 2.0, (4, 4)).count() == 0
    points = spark.createDataFrame([], "id long, lon double, lat double, value double")
    assert spatial.near_pairs(points, 100.0).count() == 0
    assert spatial.moran(points, spatial.inverse_distance(spatial.near_pairs(points, 100.0))).count() == 1
