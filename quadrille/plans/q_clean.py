"""Queries of cleaning, validation and changes."""

from pyspark.sql import functions as F

from quadrille.functions.basic import round6
from quadrille.operators import changes as ch
from quadrille.operators import clean as c
from quadrille.plans import inputs as i
from quadrille.plans.q_views import CACHE, EXPORT
from quadrille.plans.registry import query

FEATURES = ["f0", "f1", "f2", "f3"]
SIGNED = "SELECT row_idx, col_idx, CASE WHEN (row_idx + col_idx) % 11 = 0 THEN -value WHEN (row_idx * col_idx) % 50 = 1 THEN value * 100 ELSE value END AS value FROM ({})"
RAW = SIGNED.format(i.PIXEL)


def _r(df, *columns):
    return df.withColumns({c: round6(c) for c in columns})


_TILE = "SELECT *, row_idx // 16 AS ty, col_idx // 16 AS tx, greatest(value, 0) AS v FROM p"


@query("cl01_clean_tiles", f"SELECT row_idx, col_idx, round_even(least(greatest(least(v, m + 4 * s), 0), 2000), 6) AS clean FROM ({_TILE}) JOIN (SELECT ty, tx, avg(v) AS m, stddev_pop(v) AS s FROM ({_TILE}) GROUP BY 1, 2) USING (ty, tx)", p=RAW)
@query("wn04_tile_statistics", f"SELECT row_idx, col_idx, round_even(least(greatest(least(v, m + 4 * s), 0), 2000), 6) AS clean FROM ({_TILE}) JOIN (SELECT ty, tx, avg(v) AS m, stddev_pop(v) AS s FROM ({_TILE}) GROUP BY 1, 2) USING (ty, tx)", p=RAW)
def _(t):
    return _r(c.clean_tiles(t.view(RAW), "vertebrates"), "clean").select("row_idx", "col_idx", "clean")


def _norm(name, method, a, b):
    @query(name, "SELECT id, " + ", ".join(f"round_even(coalesce((f{k} - {a.format(k)}) / {b.format(k)}, 0), 6) AS f{k}" for k in range(4)) + " FROM s, (SELECT " + ", ".join(f"avg(f{k}) AS m{k}, stddev_pop(f{k}) AS d{k}, min(f{k}) AS a{k}, max(f{k}) AS b{k}, median(f{k}) AS q{k}, quantile_cont(f{k}, 0.25) AS l{k}, quantile_cont(f{k}, 0.75) AS h{k}" for k in range(4)) + " FROM s)", s=i.SAMPLE)
    def _(t):
        s = t.view(i.SAMPLE)
        return _r(c.normalised(s, c.normalisation(s, FEATURES, method)), *FEATURES)


_norm("cl03_standard", "standard", "m{0}", "d{0}")
_norm("cl03_minmax", "minmax", "a{0}", "(b{0} - a{0})")
_norm("cl03_robust", "robust", "q{0}", "(h{0} - l{0})")


@query("cl04_denormalise", "SELECT id, " + ", ".join(f"round_even(f{k}, 6) AS f{k}" for k in range(4)) + " FROM s", s=i.SAMPLE)
def _(t):
    s = t.view(i.SAMPLE)
    params = c.normalisation(s, FEATURES, "minmax")
    return _r(c.denormalised(c.normalised(s, params, None), params), *FEATURES)


@query("cl05_mean_imputation", "SELECT id, " + ", ".join(f"round_even(coalesce(f{k}, avg(f{k}) OVER ()), 6) AS f{k}" for k in range(4)) + " FROM s", s=i.SAMPLE)
def _(t):
    return _r(c.handled_missing(t.view(i.SAMPLE), FEATURES, "mean"), *FEATURES)


@query("cl05_drop_samples", "SELECT * FROM s WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL", s=i.SAMPLE)
def _(t):
    return c.handled_missing(t.view(i.SAMPLE), FEATURES, "drop_samples")


@query("cl06_varying_features", "SELECT id, f0, f1, f2, f3 FROM s", s=i.SAMPLE)
def _(t):
    s = t.view(i.SAMPLE).withColumn("same", F.lit(1.0))
    return s.select("id", *c.varying(s, [*FEATURES, "same"]))


@query("cl07_scale_on_zeros", "SELECT id, " + ", ".join(f"round_even((f{k} - m{k}) / d{k}, 6) AS f{k}" for k in range(4)) + " FROM s, (SELECT " + ", ".join(f"avg(coalesce(f{k}, 0)) AS m{k}, stddev_pop(coalesce(f{k}, 0)) AS d{k}" for k in range(4)) + " FROM s)", s=i.SAMPLE)
def _(t):
    return _r(c.scaled_on_zeros(t.view(i.SAMPLE), FEATURES), *FEATURES)


@query("cl08_som_preprocessing", "SELECT id, " + ", ".join(f"round_even((ln(1 + abs(f{k})) - m{k}) / d{k}, 6) AS f{k}" for k in range(4)) + " FROM s, (SELECT " + ", ".join(f"avg(coalesce(ln(1 + abs(f{k})), 0)) AS m{k}, stddev_pop(coalesce(ln(1 + abs(f{k})), 0)) AS d{k}" for k in range(4)) + " FROM s)", s=i.SAMPLE)
def _(t):
    return _r(c.scaled_on_zeros(t.view(i.SAMPLE), FEATURES, lambda x: F.log1p(F.abs(x))), *FEATURES)


@query("cl09_global_zscore", "SELECT id, " + ", ".join(f"round_even((f{k} - m) / d, 5) AS f{k}" for k in range(4)) + " FROM s, (SELECT avg(v) AS m, stddev_pop(v) AS d FROM (" + " UNION ALL ".join(f"SELECT f{k} AS v FROM s" for k in range(4)) + "))", s=i.SAMPLE)
def _(t):
    out = c.global_zscore(t.view(i.SAMPLE), FEATURES)
    return out.withColumns({f: F.rint(F.col(f) * 1e5) / 1e5 for f in FEATURES})


def _issue(k):
    return f"SELECT 'f{k}' AS feature, (SELECT count(*) FROM s) AS rows, (SELECT count(*) FROM s WHERE f{k} IS NULL) AS nulls, (SELECT count(*) FROM s, (SELECT avg(f{k}) AS m, stddev_samp(f{k}) AS d FROM s) WHERE abs((f{k} - m) / d) > 3) AS outliers, (SELECT count(*) FROM s WHERE f{k} < 0 OR f{k} > 12) AS outside"


@query("va03_table_issues", "SELECT feature, rows, nulls, round_even(nulls * 100.0 / rows, 6) AS null_percent, outliers, outside, concat_ws(',', CASE WHEN nulls * 100.0 / rows > 10 THEN 'nulls' END, CASE WHEN outliers * 100.0 / rows > 1 THEN 'outliers' END, CASE WHEN outside > 0 THEN 'range' END) AS issues FROM (" + " UNION ALL ".join(map(_issue, range(4))) + ")", s=i.SAMPLE)
@query("wn05_zscore_outliers", "SELECT feature, rows, nulls, round_even(nulls * 100.0 / rows, 6) AS null_percent, outliers, outside, concat_ws(',', CASE WHEN nulls * 100.0 / rows > 10 THEN 'nulls' END, CASE WHEN outliers * 100.0 / rows > 1 THEN 'outliers' END, CASE WHEN outside > 0 THEN 'range' END) AS issues FROM (" + " UNION ALL ".join(map(_issue, range(4))) + ")", s=i.SAMPLE)
def _(t):
    return c.table_issues(t.view(i.SAMPLE), FEATURES, {f: (0.0, 12.0) for f in FEATURES})


@query("va01_bounds_issues", "SELECT grid_id, concat_ws(',', CASE WHEN minx * 8 < -180.000001 OR maxx * 8 > 180.000001 THEN 'longitude' END, CASE WHEN maxy * 3 > 90.000001 THEN 'latitude' END) AS issues FROM g", g=i.GRID)
def _(t):
    return t.view(i.GRID).select("grid_id", c.bounds_issues(F.col("minx") * 8, F.col("miny") * 3, F.col("maxx") * 8, F.col("maxy") * 3).alias("issues"))


@query("va05_anomalies", "SELECT count(value) AS count, (SELECT count(*) FROM p, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM p) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS tukey_outliers, count(DISTINCT value) <= 1 AS uniform, max(abs(value - round_even(value, 0))) = 0 AS discrete, stddev_pop(value) > 2 * avg(value) AS spread FROM p", p=RAW)
def _(t):
    return c.anomalies(t.view(RAW))


@query("va06_coverage", "SELECT grid_id, round_even(w * h / 400.0, 6) AS share, w * h / 400.0 >= 0.99 AS covers FROM (SELECT grid_id, greatest(least(maxx, 0) - greatest(minx, -20), 0) AS w, greatest(least(maxy, 25) - greatest(miny, 5), 0) AS h FROM g)", g=i.GRID)
def _(t):
    return c.coverage_check(t.view(i.GRID), -20.0, 5.0, 0.0, 25.0).select("grid_id", "share", "covers")


@query("va08_missing_profile", " UNION ALL ".join(f"SELECT 'f{k}' AS feature, count(*) FILTER (f{k} IS NULL) AS missing, count(*) AS rows, round_even(count(*) FILTER (f{k} IS NULL) * 1.0 / count(*), 6) AS share, count(*) FILTER (f{k} IS NULL) * 1.0 / count(*) > 0.7 AS problematic FROM s" for k in range(4)), s=i.SAMPLE)
def _(t):
    return c.missing_profile(t.view(i.SAMPLE), FEATURES)


@query("va09_quality_checks", "SELECT 'rows' AS \"check\", CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS passed FROM s UNION ALL SELECT 'missing', round_even((4 * count(*) - count(f0) - count(f1) - count(f2) - count(f3)) / (4.0 * count(*)), 6), (4 * count(*) - count(f0) - count(f1) - count(f2) - count(f3)) / (4.0 * count(*)) <= 0.1 FROM s", s=i.SAMPLE)
def _(t):
    return c.quality_checks(t.view(i.SAMPLE), FEATURES)


@query("va11_validation_rollup", "SELECT stage, count(*) AS checks, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'view') AS warnings FROM m GROUP BY 1", m=i.METRIC)
def _(t):
    return c.rollup(t.view(i.METRIC).withColumnRenamed("level", "severity"))


@query("va13_profile", "SELECT count(*) AS rows, count(*) FILTER (value IS NULL) AS value_nulls, min(value) AS value_min, max(value) AS value_max, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p GROUP BY lon, lat HAVING count(*) > 1)) AS duplicate_rows FROM p", p=i.POINT)
def _(t):
    return c.profile(t.view(i.POINT), ["value"], ("lon", "lat"))


@query("va14_migration_complete", "SELECT count(*) AS rows, count(*) FILTER (row_idx % 3 <> 0) AS with_x, count(*) AS with_y, false AS complete FROM p WHERE value <> 0", p=i.PIXEL)
def _(t):
    return c.migration_complete(t.view(i.PIXEL).withColumns({"x_coord": F.when(F.col("row_idx") % 3 != 0, 1.0), "y_coord": F.lit(1.0)}))


@query("wn07_second_differences", "SELECT *, d1 - lag(d1) OVER (PARTITION BY experiment_id ORDER BY event_id) AS d2 FROM (SELECT experiment_id, event_id, event_id * event_id AS v, event_id * event_id - lag(event_id * event_id) OVER (PARTITION BY experiment_id ORDER BY event_id) AS d1 FROM m)", m=i.METRIC)
def _(t):
    return c.by_row_window(t.view(i.METRIC).select("experiment_id", "event_id", (F.col("event_id") * F.col("event_id")).alias("v")), "experiment_id", "event_id", "v")


@query("mu01_insert_or_ignore", "SELECT * FROM a UNION ALL SELECT * FROM r WHERE (row_idx, col_idx) NOT IN (SELECT (row_idx, col_idx) FROM a)", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    return ch.inserted(t.view(i.PIXEL_A), t.view(i.PIXEL_R), ["row_idx", "col_idx"])


@query("mu02_upsert", "SELECT row_idx, col_idx, coalesce(r.value, a.value) AS value FROM a FULL JOIN r USING (row_idx, col_idx)", a=i.PIXEL_A, r=i.PIXEL_R)
@query("snk01_pixel_upsert", "SELECT row_idx, col_idx, coalesce(r.value, a.value) AS value FROM a FULL JOIN r USING (row_idx, col_idx)", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    return ch.upserted(t.view(i.PIXEL_A), t.view(i.PIXEL_R), ["row_idx", "col_idx"])


@query("mu04_expired_exports", "SELECT format, rows FROM e WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1997-01-01'", e=EXPORT)
def _(t):
    return ch.unexpired(t.view(EXPORT), F.lit("1997-01-01").cast("timestamp")).select("format", "rows")


@query("mu05_cache_cleanup", "SELECT method, resolution, access_count FROM c WHERE NOT (created_at < TIMESTAMP '2024-02-01' AND access_count <= 3)", c=CACHE)
def _(t):
    return ch.kept_cache(t.view(CACHE), F.lit("2024-02-01").cast("timestamp"), 3).select("method", "resolution", "access_count")


@query("mu06_log_cleanup", "SELECT event_id FROM m WHERE ts >= TIMESTAMP '2024-01-15'", m=i.METRIC)
def _(t):
    return ch.recent(t.view(i.METRIC), F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("mu07_cell_counts", "SELECT grid_id, count(*) AS cells FROM c GROUP BY 1", c=i.CELL)
def _(t):
    return t.view(i.CELL).groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"))


@query("mu08_transitions", "SELECT job_id, status IN ('running') AS allowed, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status FROM j", j=i.JOB)
def _(t):
    return ch.transitioned(t.view(i.JOB).select("job_id", "status"), F.lit("completed")).select("job_id", "allowed", "status")


@query("mu09_parent_progress", "SELECT node_id, round_even(CASE substr(node_id, 1, 1) WHEN 'c' THEN progress WHEN 'n' THEN coalesce((SELECT avg(progress) FROM n c WHERE c.parent_id = n.node_id), progress) ELSE (SELECT avg(coalesce((SELECT avg(progress) FROM n c WHERE c.parent_id = m.node_id), m.progress)) FROM n m WHERE m.parent_id = n.node_id) END, 6) AS progress FROM n", n=i.NODE)
def _(t):
    return _r(ch.propagated(t.view(i.NODE)), "progress").select("node_id", "progress")


@query("mu11_task_completion", "SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CAST(retry_count + CASE WHEN job_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS retry_count FROM j", j=i.JOB)
def _(t):
    return ch.finished(t.view(i.JOB), F.col("job_id") % 3 != 0).select("job_id", "status", "retry_count")


@query("mu12_resumable", "SELECT job_id FROM j WHERE status IN ('running', 'failed') AND retry_count > 0", j=i.JOB)
def _(t):
    return t.view(i.JOB).where("status IN ('running', 'failed') AND retry_count > 0").select("job_id")


@query("mu13_json_merge", "SELECT p_partkey, p_brand AS a, p_type AS b, CAST(p_size AS VARCHAR) AS c FROM part")
def _(t):
    left = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("p_type"))
    right = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("c"), F.col("p_size").cast("string"))
    out = t.part.select("p_partkey", left.alias("l"), right.alias("r")).select("p_partkey", ch.merged_json("l", "r").alias("m"))
    return out.select("p_partkey", *(F.col("m")[k].alias(k) for k in "abc"))


@query("mu16_progress_update", "SELECT job_id, round_even(priority * 100.0 / nullif(retry_count, 0), 6) AS percent FROM j", j=i.JOB)
def _(t):
    return _r(ch.with_progress(t.view(i.JOB).select("job_id", F.col("priority").alias("completed"), F.col("retry_count").alias("total"))), "percent").select("job_id", "percent")
