"""Queries of the remaining operators."""

from pyspark.sql import functions as F

from quadrille.functions import distance as d
from quadrille.functions import geo as g
from quadrille.functions.basic import round6
from quadrille.operators import cluster as k
from quadrille.operators import merge as m
from quadrille.operators import more
from quadrille.operators import resample as r
from quadrille.operators import spatial as sa
from quadrille.operators import views as v
from quadrille.plans import inputs as i
from quadrille.plans import q_analysis as qa
from quadrille.plans.q_grid import BOX, TARGET, sample_pairs
from quadrille.plans.q_merge import AT
from quadrille.plans.registry import query
from quadrille.sources import grids, io
from quadrille.sources.scratch import scratch


def _r(df, *columns):
    return df.withColumns({c: round6(c) for c in columns})


@query("ag19_grid_statistics", "SELECT count(*) AS cells, round_even(sum(area_km2), 4) AS total, min(area_km2) AS least, max(area_km2) AS most FROM c", c="SELECT s_suppkey AS cell_id, s_acctbal AS area_km2 FROM {supplier}")
def _(t):
    return t.supplier.agg(F.count(F.lit(1)).alias("cells"), (F.rint(F.sum("s_acctbal") * 1e4) / 1e4).alias("total"), F.min("s_acctbal").alias("least"), F.max("s_acctbal").alias("most"))


@query("ag33_neighbourhood_means", "SELECT CAST(floor(lon / 5) AS BIGINT) AS bx, CAST(floor(lat / 5) AS BIGINT) AS by, count(*) AS n, round_even(avg(value), 6) AS mean FROM p GROUP BY 1, 2 HAVING count(*) >= 2", p=i.POINT)
def _(t):
    return _r(more.neighbourhood_means(t.view(i.POINT), 5.0, 2), "mean")


@query("fe05_composite_builder", "SELECT id, abs(latitude) AS abs_latitude, round_even(30 - 0.5 * abs(latitude), 6) AS avg_temp, coalesce(plants_richness, 0) + terrestrial_richness + marine_richness AS total_richness FROM r", r=i.RICHNESS)
def _(t):
    from quadrille.operators import features as fe

    builders = (lambda x: fe.richness_features(x, qa.RICH), fe.spatial_features, lambda x: x.withColumns(fe.climate_proxies()))
    df = t.view(i.RICHNESS)
    for build in builders:
        df = build(df)
    return _r(df.select("id", "abs_latitude", "avg_temp", "total_richness"), "avg_temp")


@query("fn12_clip_cells", "SELECT 'g' || grid_id || CASE WHEN minx < -25 OR miny < 3 OR maxx > 8 OR maxy > 30 THEN '_clipped' ELSE '' END AS cell_id, greatest(minx, -25) AS minx, greatest(miny, 3) AS miny, least(maxx, 8) AS maxx, least(maxy, 30) AS maxy FROM g WHERE greatest(minx, -25) < least(maxx, 8) AND greatest(miny, 3) < least(maxy, 30)", g=i.GRID)
def _(t):
    cells = t.view(i.GRID).select(F.concat(F.lit("g"), F.col("grid_id").cast("string")).alias("cell_id"), "minx", "miny", "maxx", "maxy")
    return more.clipped_cells(cells, (-25.0, 3.0, 8.0, 30.0))


RASTERS = "SELECT name, CASE WHEN grid_id = 4 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs, CASE WHEN grid_id = 3 THEN 0.5e0 ELSE 0.25e0 END AS resolution, grid_id * 0.3e0 AS minx, miny FROM ({})".format(i.GRID)


@query("fn15_alignment_issues", "SELECT a.name AS a, b.name AS b, CASE WHEN a.crs <> b.crs THEN 'crs' WHEN abs(a.resolution - b.resolution) > 0.001 THEN 'resolution' WHEN abs(a.minx - b.minx) > 1 THEN 'bounds' WHEN abs((a.minx - b.minx) / a.resolution - round_even((a.minx - b.minx) / a.resolution, 0)) > 0.1 THEN 'origin' ELSE 'none' END AS issue FROM r a JOIN r b ON a.name < b.name", r=RASTERS)
def _(t):
    return more.alignment_issues(t.view(RASTERS))


@query("fn16_target_shape", "SELECT CAST(trunc((min(maxx) - max(minx)) / 0.3) AS INT) AS width, CAST(trunc((min(maxy) - max(miny)) / 0.3) AS INT) AS height FROM g WHERE grid_id < 3", g=i.GRID)
def _(t):
    return more.target_shape(t.view(i.GRID).where("grid_id < 3"), 0.3)


@query("fn20_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS body FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("fn21_dates", "SELECT event_id, round_even((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 3) AS seconds, ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AS recent FROM events")
def _(t):
    from quadrille.functions.basic import seconds_between

    cutoff = more.relative_cutoff("7d", F.lit("2024-01-20").cast("timestamp"))
    return t.events.select("event_id", (F.rint(seconds_between(F.lit("2024-01-01").cast("timestamp"), "ts") * 1e3) / 1e3).alias("seconds"), (F.col("ts") >= cutoff).alias("recent"))


@query("prj14_relative_time", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 36 HOUR")
def _(t):
    return t.events.where(F.col("ts") >= more.relative_cutoff("36h", F.lit("2024-01-20").cast("timestamp"))).select("event_id")


_V4 = "[[x[k], y[k], w[k]] for k in range(1, 5) if x[k] IS NOT NULL AND y[k] IS NOT NULL]"


@query("fn26_weighted_bray_curtis", f"SELECT id, CASE WHEN len(v) >= 2 THEN round_even(list_sum([p[3] * abs(p[1] - p[2]) for p in v]) / (list_sum([p[3] * (p[1] + p[2]) for p in v]) + 1e-10), 6) END AS distance FROM (SELECT id, {_V4} AS v FROM (SELECT a.id, [a.f0, a.f1, a.f2, a.f3] AS x, [b.f0, b.f1, b.f2, b.f3] AS y, [1.0, 2.0, 0.5, 0.25] AS w FROM s a JOIN s b ON a.id + 1 = b.id))", s=i.SAMPLE)
def _(t):
    value = d.weighted_bray_curtis("x", "y", F.array(*map(F.lit, (1.0, 2.0, 0.5, 0.25))))
    return sample_pairs(t).select("id", value.alias("v")).select("id", F.when(F.col("v") < float("inf"), round6("v")).alias("distance"))


@query("fn30_mercator", "SELECT id, round_even(radians(lon) * 6378137, 3) AS x, round_even(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM p WHERE abs(lat) < 85", p=i.POINT)
def _(t):
    x, y = g.mercator("lon", "lat")
    return t.view(i.POINT).where(F.abs("lat") < 85).select("id", (F.rint(x * 1e3) / 1e3).alias("x"), (F.rint(y * 1e3) / 1e3).alias("y"))


@query("jn08_left_join_counts", "SELECT experiment_id, count(job_id) AS jobs, count(*) FILTER (status = 'failed') AS failed FROM e LEFT JOIN j USING (experiment_id) GROUP BY 1", e=i.EXPERIMENT, j=i.JOB)
def _(t):
    return v.experiment_summary(t.view(i.EXPERIMENT), t.view(i.JOB), F.lit("2024-06-01").cast("timestamp")).select("experiment_id", F.col("total_jobs").alias("jobs"), F.col("failed_jobs").alias("failed"))


@query("jn11_one_row_cross_join", "SELECT (SELECT count(*) FROM m) AS rows, (SELECT max(value) FROM m WHERE level = 'error') AS worst", m=i.METRIC)
def _(t):
    x = t.view(i.METRIC)
    return x.agg(F.count(F.lit(1)).alias("rows")).crossJoin(x.where("level = 'error'").agg(F.max("value").alias("worst")))


@query("jn15_species_cells", "SELECT source AS species, target AS cell, round_even(a * 12392.1424, 6) AS area_km2, round_even(a / 16 * 100, 6) AS coverage_percent FROM (SELECT source, target, greatest(least(s_maxx, t_maxx) - greatest(s_minx, t_minx), 0) * greatest(least(s_maxy, t_maxy) - greatest(s_miny, t_miny), 0) AS a FROM b, t) WHERE a > 0", b=BOX, t=TARGET)
def _(t):
    return more.species_cells(t.view(BOX).withColumnRenamed("source", "species").drop("value"), t.view(TARGET).withColumnRenamed("target", "cell"), 4.0)


@query("jn19_outer_variables", "SELECT coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, a.value AS a, b.value AS b FROM (SELECT lat, lon, max(value) AS value FROM p WHERE id % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT lat, lon, max(value) AS value FROM p WHERE id % 3 = 0 GROUP BY 1, 2) b ON a.lat = b.lat AND a.lon = b.lon", p=i.POINT)
def _(t):
    p = t.view(i.POINT)
    return more.outer_variables({"a": p.where("id % 2 = 0"), "b": p.where("id % 3 = 0")})


@query("wn10_lead_lag_frames", "SELECT row_idx, col_idx, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (b - a) / 2 WHEN b IS NOT NULL THEN b - value WHEN a IS NOT NULL THEN value - a ELSE 0 END AS gradient FROM (SELECT *, lag(value) OVER (PARTITION BY row_idx ORDER BY col_idx) AS a, lead(value) OVER (PARTITION BY row_idx ORDER BY col_idx) AS b FROM p)", p=i.PIXEL)
def _(t):
    return more.gradient(t.view(i.PIXEL)).select("row_idx", "col_idx", "gradient")


@query("mt05_autocorrelation_preserved", "SELECT round_even(1 - abs(corr(a, b)), 6) AS preserved FROM (SELECT rank() OVER (ORDER BY lat) + (count(*) OVER (PARTITION BY lat) - 1) / 2.0 AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS b FROM p)", p=i.POINT)
def _(t):
    return _r(more.spearman(t.view(i.POINT), "lat", "value"), "preserved")


@query("km07_hierarchical_fit")
def _(t):
    rows = k.prefiltered(qa._samples(t), 1)
    centres, _, _ = k.kmeans(rows.where("stratum = 'high'").drop("stratum"), 3, iterations=3)
    return k.assign(rows, centres, least=1).groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("size"))


@query("km04_local_weights", f"SELECT i AS id, count(*) AS neighbours, round_even(var_pop(v), 6) AS variance FROM (SELECT i, p.value AS v FROM ({qa.NEAR}) JOIN p ON p.id = j) GROUP BY 1 HAVING count(*) > 5", p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    near = sa.near_pairs(p, 1000.0).join(p.select(F.col("id").alias("j"), "value"), "j")
    return _r(near.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"), F.var_pop("value").alias("variance")).where("neighbours > 5"), "variance")


@query("sa03_global_normalised_moran", f"SELECT round_even((SELECT count(*) FROM p) * sum(1 / km * a.z * b.z) / (sum(1 / km) * (SELECT sum(z * z) FROM ({qa.Z}))), 6) AS moran_i FROM ({qa.NEAR}) JOIN ({qa.Z}) a ON a.id = i JOIN ({qa.Z}) b ON b.id = j WHERE km > 0", p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    z = p.crossJoin(p.agg(F.avg("value").alias("m"))).select("id", (F.col("value") - F.col("m")).alias("z"))
    w = sa.inverse_distance(sa.near_pairs(p, 1000.0))
    sums = w.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("w"))
    return sums.crossJoin(z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count("z").alias("n"))).select(round6(F.col("n") * F.col("num") / (F.col("w") * F.col("ss"))).alias("moran_i"))


@query("sm06_grid_position", f"SELECT id, label // 3 AS row, label % 3 AS column_ FROM (SELECT id, CAST(label AS INT) AS label FROM ({qa._ASSIGN})) WHERE label >= 0", s=i.SAMPLE)
def _(t):
    return k.assign(qa._samples(t), qa.CENTRES).where("label >= 0").select("id", F.floor(F.col("label") / 3).cast("int").alias("row"), (F.col("label") % 3).alias("column_"))


@query("sm11_grid_size", "SELECT 1 AS one, CAST(least(50, greatest(5, trunc(sqrt(trunc(sqrt(count(*))))))) AS INT) AS size FROM customer")
def _(t):
    return t.spark.createDataFrame([(1, k.grid_size(t.customer.count()))], "one int, size int")


@query("sm12_som_cross_validation")
def _(t):
    folds = qa.sp.checkerboard(t.view(i.POINT).join(qa._samples(t), "id"), (-180.0, -90.0, 180.0, 90.0), 6, 2).select("id", "x", "fold")
    out = []
    for f in (0, 1):
        neurons, _ = k.train_som(folds.where(F.col("fold") != f).select("id", "x"), (2, 2), epochs=2)
        out.append((f, k.quantisation_error(k.assign(folds.where(F.col("fold") == f).select("id", "x"), neurons))))
    return t.spark.createDataFrame(out, "fold int, error double")


@query("sp09_environmental_clusters")
def _(t):
    _, labelled, _ = k.kmeans(qa._samples(t), 5, iterations=2)
    return labelled.withColumn("split", F.when(F.col("label") % 5 == 0, "test").when(F.col("label") % 5 == 1, "validation").otherwise("train")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("mu03_cache_reads", "SELECT p_partkey AS key, CAST(p_partkey % 9 + coalesce(n, 0) AS BIGINT) AS access_count FROM part LEFT JOIN (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1) l ON l.key = p_partkey")
def _(t):
    cache = t.part.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 9).alias("access_count"))
    return more.touched(cache, t.events.select(F.col("user_id").alias("key"), "ts")).select("key", "access_count")


@query("prj05_disjoint_prune", "SELECT grid_id FROM g WHERE NOT (maxx < -5 OR minx > 3 OR maxy < 0 OR miny > 6)", g=i.GRID)
@query("prj18_cells_in_bounds", "SELECT grid_id FROM g WHERE NOT (maxx < -5 OR minx > 3 OR maxy < 0 OR miny > 6)", g=i.GRID)
def _(t):
    box = {"b_minx": -5.0, "b_miny": 0.0, "b_maxx": 3.0, "b_maxy": 6.0}
    return t.view(i.GRID).withColumns({n: F.lit(x) for n, x in box.items()}).where(g.boxes_touch("", "b_")).select("grid_id")


@query("prj09_dynamic_filters", "SELECT event_id FROM m WHERE level = 'error' AND experiment_id IN (1, 2, 3)", m=i.METRIC)
def _(t):
    return more.filtered(t.view(i.METRIC), level="error", stage=None, experiment_id=[1, 2, 3]).select("event_id")


@query("prj10_tolerance_filter", "SELECT grid_id, name FROM g WHERE abs(resolution - 2001) <= 1", g=i.GRID)
def _(t):
    return t.view(i.GRID).where(more.passthrough(F.col("resolution"), F.lit(2001), 1)).select("grid_id", "name")


@query("prj11_json_predicate", "SELECT event_id FROM events WHERE coalesce(json_extract_string(props, '$.k'), 'false') = '3'")
def _(t):
    return t.events.where(F.coalesce(F.get_json_object("props", "$.k"), F.lit("false")) == "3").select("event_id")


@query("prj15_record_filter", "SELECT event_id FROM events WHERE value > 50 ORDER BY event_id LIMIT 25")
def _(t):
    return t.events.where("value > 50").orderBy("event_id").limit(25).select("event_id")


@query("prj21_progress_elapsed", "SELECT job_id, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) / 1e6 AS elapsed FROM j WHERE status = 'running'", j=i.JOB)
def _(t):
    from quadrille.functions.basic import seconds_between

    return t.view(i.JOB).where("status = 'running'").select("job_id", seconds_between("created_at", F.lit("2024-06-01").cast("timestamp")).alias("elapsed"))


@query("snk05_parquet_round_trip", "SELECT CAST(row_idx // 4 AS INT) AS target_row, CAST(col_idx // 4 AS INT) AS target_col, round_even(avg(value), 6) AS value FROM p GROUP BY 1, 2", p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "resampled")
    io.write_parquet(_r(r.resample(t.view(i.PIXEL), "mean", 4.0, (64, 64)), "value"), path, rows_per_file=100, row_group_bytes=1 << 20)
    return io.read_table(t.spark, path)


@query("re11_raster_merge", "SELECT row_idx, col_idx, a.value AS a, r.value AS r FROM a LEFT JOIN r USING (row_idx, col_idx)", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    a = m.with_coordinates(t.view(i.PIXEL_A), **AT).select("x", "y", F.col("value").alias("a"))
    return m.snapped(a, t.view(i.PIXEL_R), **AT).select("row_idx", "col_idx", "a", F.col("value").alias("r"))


_CSV = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


@query("snk04_csv_round_trip", _CSV)
def _(t):
    path = scratch(t.spark, "rows") + ".csv"
    io.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, gzip=True)
    return io.read_table(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


_STORE = "SELECT row_idx, col_idx, -32.0 + (col_idx + 0.5) AS x, 32.0 - (row_idx + 0.5) AS y, value FROM p"


@query("snk03_pixel_store", _STORE, p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "pixels")
    io.write_parquet(m.with_coordinates(t.view(i.PIXEL), **AT), path)
    return t.spark.read.parquet(path).select("row_idx", "col_idx", "x", "y", "value")


@query("str1_bounded_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    from quadrille.streaming.events import event_stream, run_available

    folder, out = scratch(t.spark, "incoming"), scratch(t.spark, "logged")
    t.events.repartition(3).write.parquet(folder)
    run_available(event_stream(t.spark, folder, t.events.schema, 1), out, scratch(t.spark, "offsets"))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("so01_sort_yx", "SELECT row_idx, col_idx, value FROM p ORDER BY 1, 2", p=i.PIXEL)
def _(t):
    return m.sorted_yx(m.with_coordinates(t.view(i.PIXEL), **AT)).select("row_idx", "col_idx", "value")


@query("so02_sorted_listing", "SELECT job_id, priority FROM j ORDER BY created_at DESC, job_id LIMIT 30", j=i.JOB)
def _(t):
    return t.view(i.JOB).orderBy(F.desc("created_at"), "job_id").limit(30).select("job_id", "priority")


@query("so05_recent_errors", "SELECT event_id FROM m WHERE level = 'error' ORDER BY ts DESC, event_id LIMIT 10", m=i.METRIC)
def _(t):
    return t.view(i.METRIC).where("level = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id")


@query("so06_resolution_hierarchy", "SELECT name, resolution FROM g WHERE grid_type = 'cubic' ORDER BY resolution DESC", g=i.GRID)
def _(t):
    return t.view(i.GRID).where("grid_type = 'cubic'").orderBy(F.desc("resolution")).select("name", "resolution")


@query("src07_window_from_bounds", "SELECT CAST(8 AS INT) AS row_off, CAST(22 AS INT) AS col_off, count(*) AS pixels FROM p WHERE row_idx BETWEEN 8 AND 27 AND col_idx BETWEEN 22 AND 36", p=i.PIXEL)
def _(t):
    row, col, rows, cols = grids.window_of_bounds((-10.0, 4.0, 5.0, 24.0), **AT, height=64, width=64)
    return m.relative_chunk(t.view(i.PIXEL), (row, row + rows), (col, col + cols)).agg(F.lit(row).alias("row_off"), F.lit(col).alias("col_off"), F.count(F.lit(1)).alias("pixels"))


@query("src13_chunked_coordinates", "SELECT CAST((g // 40) // 4 AS INT) AS chunk, count(*) AS n FROM range(800) r(g) GROUP BY 1")
def _(t):
    return grids.coordinate_grid(t.spark, (-10.0, 5.0, 10.0, 15.0), 0.5, chunk_rows=4).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("st01_union_all", "SELECT * FROM a UNION ALL SELECT * FROM r", a=i.PIXEL_A, r=i.PIXEL_R)
@query("st02_chunk_concatenation", "SELECT * FROM a UNION ALL SELECT * FROM r", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    return t.view(i.PIXEL_A).unionByName(t.view(i.PIXEL_R))


@query("st05_distinct_cells", "SELECT DISTINCT row_idx // 4 AS r, col_idx // 4 AS c FROM p", p=i.PIXEL)
def _(t):
    return t.view(i.PIXEL).select(F.floor(F.col("row_idx") / 4).alias("r"), F.floor(F.col("col_idx") / 4).alias("c")).dropDuplicates()


@query("ex05_custom_aggregate", "SELECT row_idx // 16 AS tile, max(value) - min(value) AS span FROM p GROUP BY 1", p=i.PIXEL)
def _(t):
    import pandas as pd

    @F.pandas_udf("double")
    def span(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return t.view(i.PIXEL).groupBy(F.floor(F.col("row_idx") / 16).cast("int").alias("tile")).agg(span("value").alias("span"))


@query("ex06_tile_generator", "SELECT CAST(r AS INT) AS row_off, CAST(c AS INT) AS col_off FROM range(0, 64, 20) a(r) CROSS JOIN range(0, 64, 20) b(c)")
def _(t):
    return grids.windows(t.spark, 64, 64, 20).select("row_off", "col_off")


