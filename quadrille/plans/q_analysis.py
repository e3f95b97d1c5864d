"""Queries of spatial statistics, clustering, splits, features and models."""

import numpy as np
from pyspark.sql import functions as F

from quadrille.functions.basic import round6
from quadrille.functions.distance import partial_bray_curtis
from quadrille.operators import cluster as k
from quadrille.operators import features as fe
from quadrille.operators import models as mr
from quadrille.operators import spatial as sa
from quadrille.operators import splits as sp
from quadrille.plans import inputs as i
from quadrille.plans.registry import query

HAV = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
NEAR = f"SELECT a.id AS i, b.id AS j, {HAV} AS km FROM p a JOIN p b ON a.id <> b.id WHERE {HAV} <= 1000"
Z = "SELECT id, value - (SELECT avg(value) FROM p) AS z FROM p"


def _r(df, *columns):
    return df.withColumns({c: round6(c) for c in columns})


@query("jn18_near_pairs", f"SELECT i, j, round_even(km, 6) AS km FROM ({NEAR})", p=i.SUPPLIERPOINT)
def _(t):
    return _r(sa.near_pairs(t.view(i.SUPPLIERPOINT), 1000.0), "km")


_MORAN = f"SELECT round_even((SELECT count(*) FROM p) / sum(w) * sum(w * zi * zj) / ((SELECT var_pop(value) FROM p) * (SELECT count(*) FROM p)), 6) AS moran_i, round_even(-1.0 / ((SELECT count(*) FROM p) - 1), 6) AS expected, (SELECT count(*) FROM p) AS n FROM (SELECT 1 / km / sum(1 / km) OVER (PARTITION BY i) AS w, a.z AS zi, b.z AS zj FROM ({NEAR}) JOIN ({Z}) a ON a.id = i JOIN ({Z}) b ON b.id = j WHERE km > 0)"


@query("sa02_haversine_moran", _MORAN, p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    return _r(sa.moran(p, sa.inverse_distance(sa.near_pairs(p, 1000.0))), "moran_i", "expected")


@query("sa02_knn_weights", f"SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY km, j) AS n FROM ({NEAR})) WHERE n <= 8", p=i.SUPPLIERPOINT)
def _(t):
    return sa.nearest(sa.near_pairs(t.view(i.SUPPLIERPOINT), 1000.0), 8).select("i", "j")


@query("sa04_local_moran", f"SELECT z.id, round_even(coalesce(z / (SELECT var_pop(value) FROM p) * lag, 0), 6) AS local_i FROM ({Z}) z LEFT JOIN (SELECT i AS id, sum(zb.z / km) / sum(1 / km) AS lag FROM ({NEAR}) JOIN ({Z}) zb ON zb.id = j WHERE km > 0 GROUP BY 1) USING (id)", p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    return _r(sa.local_moran(p, sa.inverse_distance(sa.near_pairs(p, 1000.0))), "local_i")


@query("sa05_correlogram", f"SELECT CAST(floor(km / 200) AS INT) AS bin, count(*) AS pairs, round_even(avg(a.z * b.z), 2) AS covariance FROM (SELECT * FROM ({NEAR}) WHERE km < 1000 UNION ALL SELECT id, id, 0.0 FROM p) JOIN ({Z}) a ON a.id = i JOIN ({Z}) b ON b.id = j GROUP BY 1", p=i.SUPPLIERPOINT)
def _(t):
    return sa.correlogram(t.view(i.SUPPLIERPOINT), 1000.0, 5).withColumn("covariance", F.rint(F.col("covariance") * 100) / 100)


@query("sa07_cluster_quality", "SELECT label, round_even(avg(sqrt(pow(lon - cx, 2) + pow(lat - cy, 2))), 6) AS spread, count(*) AS size FROM (SELECT *, CAST(id % 6 AS INT) AS label, avg(lon) OVER (PARTITION BY id % 6) AS cx, avg(lat) OVER (PARTITION BY id % 6) AS cy FROM p) GROUP BY 1", p=i.POINT)
def _(t):
    return _r(sa.cluster_quality(t.view(i.POINT).withColumn("label", (F.col("id") % 6).cast("int"))), "spread")


@query("sp04_buffer_exclusion", f"SELECT id FROM p WHERE id % 5 <> 0 AND id NOT IN (SELECT a.id FROM p a JOIN p b ON a.id % 5 <> 0 AND b.id % 5 = 0 WHERE {HAV} <= 500)", p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    return sa.buffer_excluded(p.where("id % 5 <> 0"), p.where("id % 5 = 0"), 500.0).select("id")


PRESENCE = "SELECT CAST(o_custkey % 100 AS BIGINT) AS site, CAST(l_partkey % 40 AS BIGINT) AS species FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity > 40"


@query("mt01_cooccurrence", "SELECT a.species AS a, b.species AS b, count(*) AS sites FROM (SELECT DISTINCT * FROM p) a JOIN (SELECT DISTINCT * FROM p) b ON a.site = b.site AND a.species < b.species GROUP BY 1, 2", p=PRESENCE)
def _(t):
    return sa.cooccurrence(t.view(PRESENCE))


@query("mt04_rare_species", "SELECT species, count(DISTINCT site) AS sites, round_even(count(DISTINCT site) / (SELECT count(DISTINCT site) FROM p), 6) AS prevalence FROM p GROUP BY 1 HAVING count(DISTINCT site) / (SELECT count(DISTINCT site) FROM p) < 0.9", p=PRESENCE)
def _(t):
    return _r(sa.rare_species(t.view(PRESENCE), 0.9), "prevalence")


def _samples(t):
    return t.view(i.SAMPLE).select("id", F.array("f0", "f1", "f2", "f3").alias("x"))


CENTRES = np.array([[2.0, 2.0, 1.0, 5.0], [10.0, 5.0, 3.0, 12.0], [15.0, 9.0, 5.0, 20.0]])
_C = "(VALUES (0, 2.0, 2.0, 1.0, 5.0), (1, 10.0, 5.0, 3.0, 12.0), (2, 15.0, 9.0, 5.0, 20.0)) c(k, c0, c1, c2, c3)"
_NUM = " + ".join(f"coalesce(abs(f{n} - c{n}), 0)" for n in range(4))
_DEN = " + ".join(f"CASE WHEN f{n} IS NULL THEN 0 ELSE f{n} + c{n} END" for n in range(4))
_NV = " + ".join(f"CASE WHEN f{n} IS NULL THEN 0 ELSE 1 END" for n in range(4))
_ASSIGN = f"SELECT id, f0, f1, f2, f3, CASE WHEN v >= 2 THEN k ELSE -1 END AS label, CASE WHEN v >= 2 THEN d END AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), k) AS n FROM (SELECT id, f0, f1, f2, f3, k, ({_NUM}) / ({_DEN}) AS d, {_NV} AS v FROM s, {_C})) WHERE n = 1"


@query("km01_prefilter_strata", f"SELECT id, CASE WHEN v >= 3 THEN 'high' ELSE 'medium' END AS stratum FROM (SELECT id, {_NV} AS v FROM s) WHERE v >= 2", s=i.SAMPLE)
def _(t):
    return k.prefiltered(_samples(t)).select("id", "stratum")


@query("km03_feature_weights", " UNION ALL ".join(f"SELECT 'f{n}' AS feature, round_even(count(f{n}) / (count(f0) + count(f1) + count(f2) + count(f3)) * 4, 6) AS weight FROM s" for n in range(4)), s=i.SAMPLE)
def _(t):
    weights = k.feature_weights(t.view(i.SAMPLE), ["f0", "f1", "f2", "f3"], "completeness")
    return t.spark.createDataFrame([(c, round(w, 6)) for c, w in weights.items()], "feature string, weight double")


@query("km08_assign", f"SELECT id, CAST(label AS INT) AS label, round_even(distance, 6) AS distance FROM ({_ASSIGN})", s=i.SAMPLE)
def _(t):
    return _r(k.assign(_samples(t), CENTRES).select("id", "label", "distance"), "distance")


@query("jn17_nearest_reference", f"SELECT id, CAST(label AS INT) AS ref, round_even(distance, 6) AS distance FROM ({_ASSIGN})", s=i.SAMPLE)
def _(t):
    refs = t.spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(CENTRES)], "ref int, y array<double>")
    out = sa.nearest_reference(_samples(t), refs, lambda a, b: F.round(partial_bray_curtis(a, b), 12))
    return _r(out, "distance")


@query("km06_lloyd_step", f"SELECT CAST(label AS INT) AS label, " + ", ".join(f"round_even(avg(f{n}), 6) AS m{n}" for n in range(4)) + f" FROM ({_ASSIGN}) WHERE label >= 0 GROUP BY 1", s=i.SAMPLE)
def _(t):
    moved = k.kmeans_step(_samples(t), CENTRES)
    rows = [(n, *(float(np.rint(v * 1e6) / 1e6) for v in row)) for n, row in enumerate(moved)]
    return t.spark.createDataFrame(rows, "label int, m0 double, m1 double, m2 double, m3 double")


@query("km09_inertia", f"SELECT round_even(sum(distance * distance), 6) AS inertia FROM ({_ASSIGN})", s=i.SAMPLE)
def _(t):
    return k.assign(_samples(t), CENTRES).agg(round6(F.sum(F.col("distance") * F.col("distance"))).alias("inertia"))


@query("sm05_quantisation_error", f"SELECT round_even(avg(distance), 6) AS quantisation_error FROM ({_ASSIGN})", s=i.SAMPLE)
def _(t):
    return k.assign(_samples(t), CENTRES).agg(round6(F.avg("distance")).alias("quantisation_error"))


@query("km06_kmeans")
def _(t):
    _, labelled, _ = k.kmeans(_samples(t), 4, iterations=5)
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"), round6(F.avg("distance")).alias("mean_distance"))


@query("km10_dense_kmeans")
def _(t):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=4, seed=42, maxIter=5).fit(rows).transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))


@query("sm03_train_som")
def _(t):
    neurons, errors = k.train_som(_samples(t), (3, 3), epochs=3)
    u = k.u_matrix(neurons, (3, 3)).ravel()
    return t.spark.createDataFrame([(n, float(v), float(s), errors[-1]) for n, (v, s) in enumerate(zip(u, np.resize(k.importance(neurons), 9), strict=True))], "neuron int, u double, share double, error double")


@query("sm08_topographic_error")
def _(t):
    return k.topographic_error(k.assign(_samples(t), np.arange(36, dtype=float).reshape(9, 4) % 17), 3)


@query("sm10_hits_per_neuron", f"SELECT CAST(label AS INT) AS label, count(*) AS hits FROM ({_ASSIGN}) GROUP BY 1", s=i.SAMPLE)
def _(t):
    return k.assign(_samples(t), CENTRES).groupBy("label").agg(F.count(F.lit(1)).alias("hits"))


_SIZE = "(750 / 111.0)"


@query("sp01_km_blocks", f"SELECT id, CAST(floor((lat + 90) / {_SIZE}) * 54 + floor((lon + 180) / {_SIZE}) AS BIGINT) AS block FROM p", p=i.POINT)
def _(t):
    return sp.km_blocks(t.view(i.POINT), 750.0).select("id", "block")


@query("sp01_block_folds")
def _(t):
    return sp.block_folds(t.view(i.POINT), 750.0, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("block").alias("blocks"))


@query("sp02_checkerboard", "SELECT id, CAST((2 * least(greatest(floor((lat + 90) / 30), 0), 5) + least(greatest(floor((lon + 180) / 60), 0), 5)) % 5 AS INT) AS fold FROM p", p=i.POINT)
def _(t):
    return sp.checkerboard(t.view(i.POINT), (-180.0, -90.0, 180.0, 90.0), 6, 5).select("id", "fold")


@query("sp03_fold_statistics", "SELECT CAST(id % 5 AS INT) AS fold, count(*) AS samples, round_even(count(*) * 100.0 / (SELECT count(*) FROM p), 6) AS percent FROM p GROUP BY 1", p=i.POINT)
def _(t):
    return _r(sp.fold_statistics(t.view(i.POINT).withColumn("fold", (F.col("id") % 5).cast("int"))), "percent")


@query("sp05_environmental_bands", "SELECT id, CAST((value >= q[1])::INT + (value >= q[2])::INT + (value >= q[3])::INT AS INT) AS fold FROM p, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM p)", p=i.POINT)
@query("wn09_quantile_bands", "SELECT id, CAST((value >= q[1])::INT + (value >= q[2])::INT + (value >= q[3])::INT AS INT) AS fold FROM p, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM p)", p=i.POINT)
def _(t):
    return sp.quantile_bands(t.view(i.POINT), "value", 4).select("id", "fold")


@query("sp07_latitudinal_split", "SELECT id, CASE WHEN n < trunc(c * 0.6) THEN 'train' WHEN n < trunc(c * 0.6) + trunc(c * 0.2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY lat, id) - 1 AS n, count(*) OVER () AS c FROM p)", p=i.POINT)
@query("wn08_rank_split", "SELECT id, CASE WHEN n < trunc(c * 0.6) THEN 'train' WHEN n < trunc(c * 0.6) + trunc(c * 0.2) THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY lat, id) - 1 AS n, count(*) OVER () AS c FROM p)", p=i.POINT)
def _(t):
    return sp.latitudinal_split(t.view(i.POINT), 0.6, 0.2).select("id", "split")


@query("sp07_systematic_blocks", "SELECT id, CAST(floor((lon + 180) / 10) * 1000 + floor((lat + 90) / 10) AS BIGINT) AS block, CASE CAST(floor((lon + 180) / 10) * 1000 + floor((lat + 90) / 10) AS BIGINT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM p", p=i.POINT)
def _(t):
    return sp.systematic_blocks(t.view(i.POINT), 10.0).select("id", "block", "split")


@query("sp08_exact_split", "SELECT 'train' AS split, CAST(trunc(count(*) * 0.7) AS BIGINT) AS n FROM p UNION ALL SELECT 'validation', CAST(trunc(count(*) * 0.1) AS BIGINT) FROM p UNION ALL SELECT 'test', CAST(count(*) - trunc(count(*) * 0.7) - trunc(count(*) * 0.1) AS BIGINT) FROM p", p=i.POINT)
def _(t):
    return sp.exact_split(t.view(i.POINT), "id", 0.7, 0.1).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


RICH = ["plants_richness", "terrestrial_richness", "marine_richness"]


@query("fe01_richness_features", "SELECT id, t AS total_richness, round_even(ln(1 + t), 6) AS log_total_richness, round_even(a / (t + 1e-8), 6) AS plants_richness_proportion, round_even(least(greatest(a / (b + 1e-8), 0), 100), 6) AS plants_richness_terrestrial_richness_ratio, round_even(CASE WHEN t > 0 THEN 1 - (a * a + b * b + c * c) / (t * t) ELSE 0 END, 9) AS simpson FROM (SELECT id, coalesce(plants_richness, 0) AS a, terrestrial_richness AS b, marine_richness AS c, coalesce(plants_richness, 0) + terrestrial_richness + marine_richness AS t FROM r)", r=i.RICHNESS)
def _(t):
    out = fe.richness_features(t.view(i.RICHNESS), RICH)
    keep = ["log_total_richness", "plants_richness_proportion", "plants_richness_terrestrial_richness_ratio"]
    return _r(out, *keep).withColumn("simpson", F.rint(F.col("simpson") * 1e9) / 1e9).select("id", "total_richness", *keep, "simpson")


@query("fe02_spatial_features", "SELECT id, abs(latitude) AS abs_latitude, round_even(least(abs(latitude - 23.43645), abs(latitude + 23.43645)), 6) AS distance_from_tropic, CAST(abs(latitude) <= 23.43645 AS INT) AS is_tropical, CASE WHEN latitude < 0 THEN -1 ELSE 1 END AS hemisphere, round_even(cos(radians(latitude)), 6) AS cos_latitude, latitude * longitude AS lat_lon FROM r", r=i.RICHNESS)
def _(t):
    return _r(fe.spatial_features(t.view(i.RICHNESS)), "distance_from_tropic", "cos_latitude").select("id", "abs_latitude", "distance_from_tropic", "is_tropical", "hemisphere", "cos_latitude", "lat_lon")


@query("fe03_latitude_bins", "SELECT id, CAST(CASE WHEN latitude <= q[2] THEN 0 WHEN latitude <= q[3] THEN 1 WHEN latitude <= q[4] THEN 2 ELSE 3 END AS INT) AS bin FROM r, (SELECT quantile_cont(latitude, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM r)", r=i.RICHNESS)
def _(t):
    r = t.view(i.RICHNESS)
    return r.select("id", fe.binned("latitude", fe.bin_edges(r, "latitude", 4)).alias("bin"))


@query("fe06_formula_columns", "SELECT id, latitude AS latitude, longitude AS longitude, latitude * longitude AS interaction FROM r", r=i.RICHNESS)
def _(t):
    _, terms = fe.parse_formula("plants_richness ~ latitude * longitude")
    r = t.view(i.RICHNESS).select("id", *(c.alias(n.replace(":", "_")) for n, c in fe.formula_columns(terms).items()))
    return r.withColumnRenamed("latitude_longitude", "interaction")


@query("fe07_climate_proxies", "SELECT id, 30 - 0.5 * abs(latitude) AS avg_temp, CASE WHEN abs(latitude) < 23.5 THEN 5.0 WHEN abs(latitude) < 45 THEN 15.0 WHEN abs(latitude) < 66.5 THEN 25.0 ELSE 35.0 END AS seasonal_temp FROM r", r=i.RICHNESS)
def _(t):
    return t.view(i.RICHNESS).withColumns(fe.climate_proxies()).select("id", "avg_temp", "seasonal_temp")


@query("fe08_knn_imputation")
def _(t):
    p = t.view(i.RICHNESS).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), *RICH)
    return _r(fe.knn_impute(p, RICH), *RICH)


@query("fe09_cell_minmax", "SELECT grid_id, cell_id, feature_name, feature_value, round_even(coalesce((feature_value - min(feature_value) OVER w) / nullif(max(feature_value) OVER w - min(feature_value) OVER w, 0), 0), 6) AS normalised FROM f WINDOW w AS (PARTITION BY grid_id, cell_id)", f=i.FEATURE)
def _(t):
    return _r(fe.cell_minmax(t.view(i.FEATURE)), "normalised").drop("feature_type")


XY = "SELECT c_custkey AS id, CAST(c_custkey % 17 AS DOUBLE) AS a, c_acctbal / 1000 AS y, CAST(c_nationkey AS DOUBLE) AS b FROM {customer}"


def _model(t):
    rows = t.view(XY)
    return rows, mr.ridge(rows, ["a"], "y", 1.0)


@query("mr01_ridge", "SELECT round_even(w, 6) AS coefficient, round_even(my - w * ma, 6) AS intercept FROM (SELECT covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1.0) AS w, avg(y) AS my, avg(a) AS ma FROM p)", p=XY)
def _(t):
    w, b = _model(t)[1]
    return t.spark.createDataFrame([(float(np.rint(w[0] * 1e6) / 1e6), float(np.rint(b * 1e6) / 1e6))], "coefficient double, intercept double")


_PRED = "SELECT *, greatest(w * a + my - w * ma, 0) AS q FROM p, (SELECT covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1.0) AS w, avg(y) AS my, avg(a) AS ma FROM p)"


@query("mr03_metrics", f"SELECT round_even(1 - sum(pow(y - q, 2)) / (var_pop(y) * count(*)), 6) AS r2, round_even(sqrt(avg(pow(y - q, 2))), 6) AS rmse, round_even(avg(abs(y - q)), 6) AS mae, round_even(avg(CASE WHEN y <> 0 THEN abs((y - q) / y) END) * 100, 4) AS mape, round_even(avg(y - q), 6) AS residual_mean, round_even(stddev_pop(y - q), 6) AS residual_std FROM ({_PRED})", p=XY)
def _(t):
    rows, model = _model(t)
    out = _r(mr.metrics(rows.withColumn("q", mr.predicted(["a"], model)), "y", "q"), "r2", "rmse", "mae", "residual_mean", "residual_std")
    return out.withColumn("mape", F.rint(F.col("mape") * 1e4) / 1e4)


@query("sp10_cross_validation")
@query("ag37_fold_mean_std")
def _(t):
    rows = t.view(XY).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)))
    out = None
    for f in range(3):
        model = mr.ridge(rows.where(F.col("fold") != f), ["a", "b"], "y")
        one = mr.metrics(rows.where(F.col("fold") == f).withColumn("q", mr.predicted(["a", "b"], model)), "y", "q").select(F.lit(f).alias("fold"), "r2", "rmse")
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.avg("rmse").alias("rmse_mean"))


@query("mr04_likelihood_ratio")
def _(t):
    rows = t.view(XY)
    made = []
    for names in (["a"], ["a", "b"]):
        model = mr.ridge(rows, names, "y", 0.0)
        line = sum((F.col(c) * float(w) for c, w in zip(names, model[0], strict=True)), F.lit(float(model[1])))
        r = rows.agg(F.sum((F.col("y") - line) ** 2).alias("rss"), F.count(F.lit(1)).alias("n")).first()
        made.append((mr.log_likelihood(r.rss, r.n), len(names) + 2, r.n))
    stat, p = mr.likelihood_ratio(made[0][:2], made[1][:2])
    aic, bic = mr.information_criteria(*made[1])
    return t.spark.createDataFrame([(stat, p, mr.stars(p), aic, bic)], "statistic double, p double, stars string, aic double, bic double")


@query("mr06_permutation_importance")
def _(t):
    rows = t.view(XY)
    return mr.permutation_importance(rows, ["a", "b"], "y", mr.ridge(rows, ["a", "b"], "y"), repeats=1)


@query("mr07_partial_dependence", "SELECT round_even(g, 6) AS a, round_even(greatest(w * g + my - w * ma, 0), 6) AS prediction FROM (SELECT l + (h - l) * k / 4 AS g, w, my, ma FROM (SELECT quantile_cont(a, 0.05) AS l, quantile_cont(a, 0.95) AS h, covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1.0) AS w, avg(y) AS my, avg(a) AS ma FROM p), range(5) r(k))", p=XY)
def _(t):
    rows, model = _model(t)
    return _r(mr.partial_dependence(rows, "a", ["a"], model, 5), "a", "prediction")


@query("mr02_gradient_boosting")
def _(t):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(t.view(XY))
    fitted = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=42).fit(rows).transform(rows)
    return mr.metrics(fitted.withColumn("q", F.greatest("prediction", F.lit(0.0))), "y", "q").select("r2", "rmse")


RESULT = "SELECT concat('m', CAST(s_suppkey % 4 AS STRING)) AS model, s_acctbal / 10000 AS r2, CAST(s_suppkey % 13 AS DOUBLE) AS rmse FROM {supplier}"


@query("ag40_best_models", "SELECT (SELECT model FROM m ORDER BY a DESC, model LIMIT 1) AS best_r2, (SELECT model FROM m ORDER BY b, model LIMIT 1) AS best_rmse, (SELECT count(*) FROM m WHERE d > 0.1) AS unstable".replace("FROM m", "FROM (SELECT model, avg(r2) AS a, avg(rmse) AS b, stddev_pop(r2) AS d FROM r GROUP BY 1)"), r=RESULT)
def _(t):
    return mr.best_models(t.view(RESULT))


