"""Queries of the catalog summaries."""

from pyspark.sql import functions as F

from quadrille.functions.basic import round6
from quadrille.operators import views as v
from quadrille.plans import inputs as i
from quadrille.plans.registry import query

NOW = "2024-06-01 00:00:00"
CHECKPOINT = "SELECT o_orderkey AS id, o_orderpriority AS level, CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'invalid' ELSE 'pending' END AS status, o_orderkey * 1000000 AS size_bytes, o_orderdate AS created_at FROM {orders}"
EXPORT = "SELECT o_orderpriority AS format, o_custkey AS rows, o_orderkey * 1000 AS size_bytes, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS expires_at FROM {orders}"
RASTER = "SELECT s_suppkey AS raster_id, s_name AS name FROM {supplier}"
TILE = "SELECT l_suppkey AS raster_id, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status FROM {lineitem} WHERE l_suppkey % 7 <> 0"
CACHE = "SELECT p_brand AS method, p_size AS resolution, p_retailprice AS confidence, CAST(p_partkey % 9 AS INT) AS access_count, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {part}"


def _r(df, *columns):
    return df.withColumns({c: round6(c) for c in columns})


@query("ag01_species_richness", "SELECT grid_id, cell_id, category, range_type, count(DISTINCT species_name) AS species_count, round_even(avg(coverage_percent), 9) AS avg_coverage, sum(intersection_area_km2) AS total_area, round_even(avg(presence_score), 9) AS avg_presence FROM s GROUP BY ALL", s=i.SPECIES)
def _(t):
    # Nine places: at six, means of 64 or 128 rows are often halfway, and the order of a sum decides.
    return v.species_richness(t.view(i.SPECIES)).withColumns({c: F.rint(F.col(c) * 1e9) / 1e9 for c in ("avg_coverage", "avg_presence")})


_STATUS = """SELECT g.grid_id, g.name, coalesce(total_cells, 0) AS total_cells, coalesce(cells_with_species, 0) AS cells_with_species, coalesce(unique_species, 0) AS unique_species, coalesce(cells_with_features, 0) AS cells_with_features, coalesce(unique_features, 0) AS unique_features,
CAST(round(CAST(coalesce(cells_with_species, 0) AS DECIMAL(18,6)) / nullif(total_cells, 0) * 100, 2) AS DOUBLE) AS species_percent, CAST(round(coalesce(cells_with_features, 0) * 100.0 / nullif(total_cells, 0), 2) AS DOUBLE) AS features_percent
FROM g LEFT JOIN (SELECT grid_id, count(DISTINCT cell_id) AS total_cells FROM c GROUP BY 1) USING (grid_id)
LEFT JOIN (SELECT grid_id, count(DISTINCT cell_id) AS cells_with_species, count(DISTINCT species_name) AS unique_species FROM s GROUP BY 1) USING (grid_id)
LEFT JOIN (SELECT grid_id, count(DISTINCT cell_id) AS cells_with_features, count(DISTINCT feature_name) AS unique_features FROM f GROUP BY 1) USING (grid_id)"""


@query("ag02_grid_status", _STATUS, g=i.GRID, c=i.CELL, s=i.SPECIES, f=i.FEATURE)
@query("jn07_preaggregated_fan_out", _STATUS, g=i.GRID, c=i.CELL, s=i.SPECIES, f=i.FEATURE)
def _(t):
    return v.grid_status(t.view(i.GRID), t.view(i.CELL), t.view(i.SPECIES), t.view(i.FEATURE)).drop("grid_type", "resolution", "minx", "miny", "maxx", "maxy")


@query("ag03_experiment_summary", f"SELECT e.experiment_id, e.name, count(job_id) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs, count(*) FILTER (status = 'running') AS running_jobs, round_even(avg(progress_percent), 6) AS avg_progress, date_diff('second', e.started_at, TIMESTAMP '{NOW}') / 60 AS duration_minutes FROM e LEFT JOIN j USING (experiment_id) GROUP BY e.experiment_id, e.name, e.started_at", e=i.EXPERIMENT, j=i.JOB)
def _(t):
    out = v.experiment_summary(t.view(i.EXPERIMENT), t.view(i.JOB), F.lit(NOW).cast("timestamp"))
    return _r(out, "avg_progress").drop("started_at", "last_job")


@query("ag04_checkpoint_summary", "SELECT level, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, round_even(sum(size_bytes) / 1073741824, 6) AS total_gb, max(created_at) AS newest FROM c GROUP BY 1", c=CHECKPOINT)
def _(t):
    return _r(v.checkpoint_summary(t.view(CHECKPOINT)), "total_gb")


@query("ag05_progress_detail", f"SELECT job_id, round_even(CASE WHEN retry_count > 0 THEN priority * 100.0 / retry_count ELSE 0 END, 6) AS percent, CAST(date_diff('second', created_at, TIMESTAMP '{NOW}') AS DOUBLE) AS duration_seconds FROM j", j=i.JOB)
def _(t):
    steps = t.view(i.JOB).select("job_id", F.col("priority").alias("done"), F.col("retry_count").alias("total"), F.col("created_at").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    return _r(v.progress_detail(steps, F.lit(NOW).cast("timestamp")), "percent").select("job_id", "percent", "duration_seconds")


@query("ag06_export_summary", "SELECT format, count(*) AS exports, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, min(created_at) AS first, max(created_at) AS last, count(*) FILTER (expires_at IS NULL OR expires_at > TIMESTAMP '1997-01-01') AS active, count(*) FILTER (expires_at <= TIMESTAMP '1997-01-01') AS expired FROM e GROUP BY 1", e=EXPORT)
def _(t):
    return v.export_summary(t.view(EXPORT), F.lit("1997-01-01").cast("timestamp")).drop("size")


@query("ag07_tile_status", "SELECT raster_id, name, count(status) AS tiles, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(round(count(*) FILTER (status = 'completed') * 100.0 / nullif(count(status), 0), 2) AS DOUBLE) AS completion_percent FROM r LEFT JOIN t USING (raster_id) GROUP BY 1, 2", r=RASTER, t=TILE)
def _(t):
    return v.tile_status(t.view(RASTER), t.view(TILE))


@query("ag08_cache_efficiency", "SELECT method, resolution, count(*) AS entries, round_even(avg(confidence), 6) AS avg_confidence, round_even(avg(access_count), 6) AS avg_access, min(created_at) AS oldest, max(created_at) AS newest FROM c GROUP BY 1, 2", c=CACHE)
def _(t):
    return _r(v.cache_efficiency(t.view(CACHE)), "avg_confidence", "avg_access")


@query("ag09_queue_summary", "SELECT priority % 3 AS queue, status, count(*) AS tasks, round_even(avg(priority), 6) AS avg_priority, min(created_at) AS oldest, count(*) FILTER (retry_count > 0) AS retried, count(CASE WHEN job_id % 2 = 0 THEN 1 END) AS assigned FROM j GROUP BY 1, 2", j=i.JOB)
def _(t):
    queue = t.view(i.JOB).withColumns({"queue": F.col("priority") % 3, "worker": F.when(F.col("job_id") % 2 == 0, "w")})
    return _r(v.queue_summary(queue), "avg_priority")


@query("ag10_progress_by_level", "SELECT substr(node_id, 1, 1) AS level, count(*) AS nodes, count(*) FILTER (progress >= 100) AS completed, count(*) FILTER (progress > 0 AND progress < 100) AS running, round_even(avg(progress), 6) AS avg_progress FROM n GROUP BY 1", n=i.NODE)
def _(t):
    return _r(v.progress_by_level(t.view(i.NODE).withColumn("level", F.substring("node_id", 1, 1))), "avg_progress")


@query("ag11_error_summary", """SELECT (SELECT '{' || string_agg('"' || level || '":' || c, ',' ORDER BY level) || '}' FROM (SELECT level, count(*) AS c FROM m GROUP BY 1)) AS by_level, (SELECT '{' || string_agg('"' || stage || '":' || c, ',' ORDER BY stage) || '}' FROM (SELECT stage, count(*) AS c FROM m GROUP BY 1)) AS by_stage,
(SELECT '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id) || ']' FROM (SELECT * FROM m WHERE level = 'error' ORDER BY ts DESC, event_id LIMIT 10)) AS recent""", m=i.METRIC)
def _(t):
    return v.error_summary(t.view(i.METRIC))


@query("ag12_memory_by_stage", "SELECT experiment_id, stage, round_even(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, round_even(stddev_samp(value), 6) AS stddev, count(value) AS samples, min(ts) AS first, max(ts) AS last, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM m GROUP BY 1, 2", m=i.METRIC)
def _(t):
    return _r(v.memory_by_stage(t.view(i.METRIC)), "avg", "stddev", "seconds")


@query("ag13_memory_summary", "SELECT e.experiment_id, count(DISTINCT stage) AS stages, max(value) AS peak, round_even(avg(value), 6) AS average, round_even(coalesce(max(value), 0) / 16.0 * 100, 6) AS peak_percent FROM e LEFT JOIN m ON e.experiment_id = m.experiment_id AND level = 'view' GROUP BY 1", e=i.EXPERIMENT, m=i.METRIC)
@query("jn09_filter_in_join", "SELECT e.experiment_id, count(DISTINCT stage) AS stages, max(value) AS peak, round_even(avg(value), 6) AS average, round_even(coalesce(max(value), 0) / 16.0 * 100, 6) AS peak_percent FROM e LEFT JOIN m ON e.experiment_id = m.experiment_id AND level = 'view' GROUP BY 1", e=i.EXPERIMENT, m=i.METRIC)
def _(t):
    e = t.view(i.EXPERIMENT).select("experiment_id")
    return _r(v.memory_summary(e, t.view(i.METRIC)), "average", "peak_percent")


@query("ag14_stage_efficiency", "SELECT stage, round_even(avg(a), 6) AS avg_gb, max(x) AS peak_gb, round_even(sum(s), 6) AS seconds, round_even(avg(a) * sum(s) / 60, 4) AS gb_minutes, round_even(CASE WHEN sum(s) > 0 THEN max(x) / (sum(s) / 60) ELSE 0 END, 6) AS gb_per_minute FROM (SELECT experiment_id, stage, avg(value) AS a, max(value) AS x, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM m GROUP BY 1, 2) GROUP BY 1", m=i.METRIC)
def _(t):
    out = _r(v.stage_efficiency(t.view(i.METRIC)), "avg_gb", "seconds", "gb_per_minute")
    return out.withColumn("gb_minutes", F.rint(F.col("gb_minutes") * 1e4) / 1e4)


@query("ag15_metric_summary", "SELECT coalesce(min(k), 0) AS min, coalesce(max(k), 0) AS max, round_even(coalesce(avg(k), 0), 6) AS avg, count(k) AS count FROM (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM m)", m=i.METRIC)
@query("prj12_json_key_exists", "SELECT coalesce(min(k), 0) AS min, coalesce(max(k), 0) AS max, round_even(coalesce(avg(k), 0), 6) AS avg, count(k) AS count FROM (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM m)", m=i.METRIC)
def _(t):
    m = t.view(i.METRIC).where(F.get_json_object("props", "$.k").isNotNull())
    return _r(v.metric_summary(m, F.get_json_object("props", "$.k").cast("double")), "avg")


@query("ag16_chunk_stats", "SELECT -32.0 + min(col_idx) + 0.5 AS minx, -32.0 + max(col_idx) + 0.5 AS maxx, 32.0 - max(row_idx) - 0.5 AS miny, 32.0 - min(row_idx) - 0.5 AS maxy, count(*) AS pixels, count(DISTINCT row_idx) AS rows, count(DISTINCT col_idx) AS cols, round_even(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM p", p=i.PIXEL)
def _(t):
    from quadrille.operators.merge import with_coordinates

    return _r(v.chunk_stats(with_coordinates(t.view(i.PIXEL), minx=-32.0, maxy=32.0, resolution=1.0)), "avg")


@query("ag17_extent", "SELECT min(minx) AS all_minx, min(miny) AS all_miny, max(maxx) AS all_maxx, max(maxy) AS all_maxy, CASE WHEN max(minx) < min(maxx) AND max(miny) < min(maxy) THEN max(minx) END AS common_minx, CASE WHEN max(minx) < min(maxx) AND max(miny) < min(maxy) THEN max(miny) END AS common_miny, CASE WHEN max(minx) < min(maxx) AND max(miny) < min(maxy) THEN min(maxx) END AS common_maxx, CASE WHEN max(minx) < min(maxx) AND max(miny) < min(maxy) THEN min(maxy) END AS common_maxy FROM g WHERE grid_id < 3", g=i.GRID)
@query("ag18_common_bounds", "SELECT min(minx) AS all_minx, min(miny) AS all_miny, max(maxx) AS all_maxx, max(maxy) AS all_maxy, max(minx) AS common_minx, max(miny) AS common_miny, min(maxx) AS common_maxx, min(maxy) AS common_maxy FROM g WHERE grid_id < 3", g=i.GRID)
def _(t):
    return v.extent(t.view(i.GRID).where("grid_id < 3"))


@query("ag20_feature_statistics", "SELECT feature_name, count(*) AS count, round_even(avg(feature_value), 6) AS mean, round_even(stddev_pop(feature_value), 6) AS std, min(feature_value) AS min, max(feature_value) AS max, round_even(median(feature_value), 6) AS median FROM f GROUP BY 1", f=i.FEATURE)
def _(t):
    return _r(v.feature_statistics(t.view(i.FEATURE)), "mean", "std", "median")


@query("ag34_group_missing_share", "SELECT f3 AS label, count(*) AS size, round_even(avg(CASE WHEN f0 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM s GROUP BY 1", s=i.SAMPLE)
def _(t):
    return _r(t.view(i.SAMPLE).groupBy(F.col("f3").alias("label")).agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("f0").isNull().cast("int")).alias("missing_share")), "missing_share")


@query("ag35_catalog_report", "SELECT CASE WHEN grouping(p_type) = 1 THEN 'all' ELSE p_type END AS type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY ROLLUP (p_type)")
def _(t):
    return t.part.rollup("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), F.grouping("p_type").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("p_type")).alias("type"), "n", "size")


@query("wn01_peak", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY value DESC, event_id) AS rn FROM m) WHERE rn = 1", m=i.METRIC)
def _(t):
    return v.peak(t.view(i.METRIC))


@query("wn02_retention", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY created_at DESC, id DESC) AS rn FROM c) WHERE status <> 'valid' OR created_at >= TIMESTAMP '1998-01-01' OR rn <= 3", c=CHECKPOINT)
def _(t):
    return v.retained(t.view(CHECKPOINT), F.lit("1998-01-01").cast("timestamp"), 3)


@query("wn06_latest_metric", "SELECT experiment_id, arg_max(value, (ts, event_id)) AS latest, max(ts) AS latest_ts FROM m GROUP BY 1", m=i.METRIC)
@query("jn10_latest_as_of", "SELECT experiment_id, arg_max(value, (ts, event_id)) AS latest, max(ts) AS latest_ts FROM m GROUP BY 1", m=i.METRIC)
def _(t):
    return v.latest(t.view(i.METRIC), "experiment_id")


@query("so03_queue_pop", "SELECT job_id, priority, created_at FROM j WHERE status = 'running' AND retry_count < 3 ORDER BY priority DESC, created_at, job_id LIMIT 5", j=i.JOB)
def _(t):
    return v.next_tasks(t.view(i.JOB), 5).select("job_id", "priority", "created_at")


@query("so07_page_after", "SELECT * FROM m WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 20", m=i.METRIC)
def _(t):
    return v.page_after(t.view(i.METRIC), "2024-01-15 00:00:00", 0, 20)


@query("prj13_search", "SELECT * FROM m WHERE stage ILIKE '%GE3%' AND level = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50", m=i.METRIC)
def _(t):
    return v.searched(t.view(i.METRIC), "GE3", "error", 50)


@query("st07_progress_tree", "WITH RECURSIVE t AS (SELECT node_id, parent_id, 0 AS depth, node_id AS path FROM n WHERE node_id = 'r1' UNION ALL SELECT n.node_id, n.parent_id, t.depth + 1, t.path || '/' || n.node_id FROM n JOIN t ON n.parent_id = t.node_id) SELECT * FROM t".replace("FROM n", f"FROM ({i.NODE.format(region='region', nation='nation', customer='customer')}) n"))
@query("st06_checkpoint_hierarchy", "WITH RECURSIVE t AS (SELECT node_id, parent_id, 0 AS depth, node_id AS path FROM n WHERE node_id = 'r1' UNION ALL SELECT n.node_id, n.parent_id, t.depth + 1, t.path || '/' || n.node_id FROM n n JOIN t ON n.parent_id = t.node_id) SELECT * FROM t".replace("FROM n n", "FROM n").replace("FROM n", f"FROM ({i.NODE.format(region='region', nation='nation', customer='customer')}) n"))
def _(t):
    return v.tree(t.view(i.NODE), "r1")


@query("st03_coordinate_intersection", "SELECT row_idx, col_idx FROM a INTERSECT SELECT row_idx, col_idx FROM r", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    return t.view(i.PIXEL_A).select("row_idx", "col_idx").intersect(t.view(i.PIXEL_R).select("row_idx", "col_idx"))


@query("st04_missing_datasets", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def _species(t):
    rows = t.view(i.SPECIES).where("category = 'BUILDING'").join(t.view(i.GRID).select("grid_id", "name"), "grid_id")
    return rows.select("species_name", "cell_id", "name", "intersection_area_km2")


@query("jn05_species_export", "SELECT s.species_name, s.cell_id, g.name, s.intersection_area_km2 FROM s JOIN g USING (grid_id) WHERE s.category = 'BUILDING'", s=i.SPECIES, g=i.GRID)
def _(t):
    return _species(t)


@query("snk10_species_csv_rows", "SELECT s.species_name, s.cell_id, g.name, s.intersection_area_km2 FROM s JOIN g USING (grid_id) WHERE s.category = 'BUILDING' ORDER BY 1, 2, 3, 4 LIMIT 500", s=i.SPECIES, g=i.GRID)
def _(t):
    return _species(t).orderBy("species_name", "cell_id", "name", "intersection_area_km2").limit(500)


@query("jn06_richness_with_grids", "SELECT g.name, g.resolution, cell_id, count(DISTINCT species_name) AS species FROM s JOIN g USING (grid_id) GROUP BY ALL", s=i.SPECIES, g=i.GRID)
@query("snk11_richness_csv_rows", "SELECT g.name, g.resolution, cell_id, count(DISTINCT species_name) AS species FROM s JOIN g USING (grid_id) GROUP BY ALL", s=i.SPECIES, g=i.GRID)
def _(t):
    rich = t.view(i.SPECIES).groupBy("grid_id", "cell_id").agg(F.countDistinct("species_name").alias("species"))
    return rich.join(t.view(i.GRID), "grid_id").select("name", "resolution", "cell_id", "species")


@query("jn20_semi_join", "SELECT * FROM p WHERE row_idx IN (SELECT CAST(s_suppkey % 64 AS INT) FROM supplier WHERE s_acctbal > 5000)", p=i.PIXEL)
def _(t):
    wanted = t.supplier.where("s_acctbal > 5000").select((F.col("s_suppkey") % 64).cast("int").alias("row_idx"))
    return t.view(i.PIXEL).join(wanted, "row_idx", "left_semi")


@query("jn22_running_nodes", "SELECT job_id, name, created_at FROM j JOIN e USING (experiment_id) WHERE status = 'running' ORDER BY created_at DESC, job_id LIMIT 200", e=i.EXPERIMENT, j=i.JOB)
def _(t):
    return t.view(i.JOB).where("status = 'running'").join(t.view(i.EXPERIMENT).select("experiment_id", "name"), "experiment_id").select("job_id", "name", "created_at").orderBy(F.desc("created_at"), "job_id").limit(200)
