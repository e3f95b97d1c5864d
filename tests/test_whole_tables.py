"""Queries over whole tables against brute force, where SQL is missing or reads the first rows only."""

import numpy as np
import pytest

from quadrille.operators.features import knn_impute
from quadrille.plans.queries import QUERIES


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1, 501).selectExpr("id AS s_suppkey", "'s' AS s_name", "CAST(id % 25 AS INT) AS s_nationkey", "CAST(id * 13 % 997 AS DOUBLE) AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_point_queries_read_all_suppliers(spark, suppliers):
    ids = np.arange(1, 501)
    lon, lat = np.radians(ids * 37 % 360 - 180.0), np.radians(ids * 7 % 180 - 90.0)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))
    near = (km <= 1000) & ~np.eye(500, dtype=bool)
    got = QUERIES["jn18_near_pairs"](spark, suppliers).collect()
    assert {(r.i, r.j) for r in got} == {(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)} and len(got) == near.sum()
    test = ids % 5 == 0
    away = ids[~test & ~(km[:, test] <= 500).any(axis=1)]
    assert sorted(r.id for r in QUERIES["sp04_buffer_exclusion"](spark, suppliers).collect()) == away.tolist()
    assert QUERIES["sa01_global_moran"](spark, suppliers).first().n == 500


def test_imputation_searches_all_donors(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.uniform(-90, 90, 3000), rng.uniform(-180, 180, 3000), rng.normal(size=(3000, 2))])
    x[::40, 2], x[::100, 3] = np.nan, np.nan
    x[1500:1510] = x[1501]
    rows = [(k, *(None if np.isnan(v) else float(v) for v in r)) for k, r in enumerate(x)]
    df = spark.createDataFrame([*rows, (3000, None, None, None, None)], "id long, lat double, lon double, a double, b double")
    got = {r.id: [r.lat, r.lon, r.a, r.b] for r in knn_impute(df, ["a", "b"], block=256).collect()}
    mean, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = (x - mean) / scale
    assert len(got) == 3001 and np.allclose(got[3000], mean)
    for i in range(3000):
        want = x[i].copy()
        for c in np.flatnonzero(np.isnan(z[i])):
            both = ~np.isnan(z) & ~np.isnan(z[i])
            d = np.where(both, z - z[i], 0) ** 2 @ np.full(4, 0.25) / np.maximum(both.sum(axis=1) * 0.25, 1e-9)
            d[np.isnan(z[:, c])] = np.inf
            want[c] = x[np.argsort(d, kind="stable")[:5], c].mean()
        assert np.allclose(got[i], want), i
