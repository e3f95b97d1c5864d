"""Summaries of the pipeline's catalog tables (JN05-JN11, JN22, AG01-AG20, WN01, WN02, WN06, SO, ST06, ST07)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.basic import percent, seconds_between


def species_richness(intersections: DataFrame) -> DataFrame:
    """AG01: distinct species, mean coverage, total area and mean presence by grid, cell, category and range type."""
    return intersections.groupBy("grid_id", "cell_id", "category", "range_type").agg(
        F.countDistinct("species_name").alias("species_count"), F.avg("coverage_percent").alias("avg_coverage"), F.sum("intersection_area_km2").alias("total_area"), F.avg("presence_score").alias("avg_presence")
    )


def grid_status(grids: DataFrame, cells: DataFrame, intersections: DataFrame, features: DataFrame) -> DataFrame:
    """AG02, JN07: distinct cells, species and features of each grid, with the share of cells processed.

    Each child is aggregated by grid before its join, so children don't multiply each other's rows.
    """
    a = cells.groupBy("grid_id").agg(F.countDistinct("cell_id").alias("total_cells"))
    b = intersections.groupBy("grid_id").agg(F.countDistinct("cell_id").alias("cells_with_species"), F.countDistinct("species_name").alias("unique_species"))
    c = features.groupBy("grid_id").agg(F.countDistinct("cell_id").alias("cells_with_features"), F.countDistinct("feature_name").alias("unique_features"))
    counts = ("total_cells", "cells_with_species", "unique_species", "cells_with_features", "unique_features")
    out = grids.join(a, "grid_id", "left").join(b, "grid_id", "left").join(c, "grid_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counts})
    return out.withColumns({"species_percent": percent("cells_with_species", "total_cells").cast("double"), "features_percent": percent("cells_with_features", "total_cells").cast("double")})


def experiment_summary(experiments: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """AG03, JN08: jobs by status and mean progress of each experiment, minutes since its start."""
    sums = jobs.groupBy("experiment_id").agg(F.count("job_id").alias("total_jobs"), *(F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in ("completed", "failed", "running")), F.avg("progress_percent").alias("avg_progress"), F.max("created_at").alias("last_job"))
    out = experiments.join(sums, "experiment_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("total_jobs", "completed_jobs", "failed_jobs", "running_jobs")})
    return out.withColumn("duration_minutes", seconds_between("started_at", now) / 60)


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    """AG04: counts by status, GB and the newest checkpoint of each level."""
    return checkpoints.groupBy("level").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "invalid").alias("invalid"), (F.sum("size_bytes") / 1024**3).alias("total_gb"), F.max("created_at").alias("newest"))


def progress_detail(steps: DataFrame, now: Column) -> DataFrame:
    """AG05: guarded percentage and seconds so far."""
    share = F.when(F.col("total") > 0, F.col("done") * 100.0 / F.col("total")).otherwise(0.0)
    return steps.withColumns({"percent": share, "duration_seconds": seconds_between("started_at", F.coalesce(F.col("ended_at"), now))})


def human_size(size: Column, last: str = "TB") -> Column:
    """FN22: bytes, kB, MB, GB, TB as pg_size_pretty says them; what is larger stays in the unit ``last``."""
    out = None
    for limit, divisor, unit in ((10 * 1024, 1, "bytes"), (10 * 1024**2, 1024, "kB"), (10 * 1024**3, 1024**2, "MB"), (10 * 1024**4, 1024**3, "GB"), (None, 1024**4, "TB")):
        text = F.concat(F.floor(size / divisor + (0 if divisor == 1 else 0.5)).cast("string"), F.lit(f" {unit}"))
        if unit == last:
            return text if out is None else out.otherwise(text)
        out = F.when(size < limit, text) if out is None else out.when(size < limit, text)
    raise ValueError(f"no unit {last}")


def export_summary(exports: DataFrame, now: Column) -> DataFrame:
    """AG06: exports by format: count, rows, size, first and last, active and expired."""
    active = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    out = exports.groupBy("format").agg(F.count(F.lit(1)).alias("exports"), F.sum("rows").alias("rows"), F.sum("size_bytes").alias("size_bytes"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count_if(active).alias("active"), F.count_if(~active).alias("expired"))
    return out.withColumn("size", human_size(F.col("size_bytes")))


def tile_status(rasters: DataFrame, tiles: DataFrame) -> DataFrame:
    """AG07: tiles of each raster by status, and the share completed."""
    sums = tiles.groupBy("raster_id").agg(F.count(F.lit(1)).alias("tiles"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "completed", "failed")))
    out = rasters.join(sums, "raster_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("tiles", "pending", "completed", "failed")})
    return out.withColumn("completion_percent", percent("completed", "tiles").cast("double"))


def cache_efficiency(cache: DataFrame) -> DataFrame:
    """AG08."""
    return cache.groupBy("method", "resolution").agg(F.count(F.lit(1)).alias("entries"), F.avg("confidence").alias("avg_confidence"), F.avg("access_count").alias("avg_access"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """AG09."""
    return queue.groupBy("queue", "status").agg(F.count(F.lit(1)).alias("tasks"), F.avg("priority").alias("avg_priority"), F.min("created_at").alias("oldest"), F.count_if(F.col("retry_count") > 0).alias("retried"), F.count("worker").alias("assigned"))


def progress_by_level(nodes: DataFrame) -> DataFrame:
    """AG10."""
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("progress") >= 100).alias("completed"), F.count_if((F.col("progress") > 0) & (F.col("progress") < 100)).alias("running"), F.avg("progress").alias("avg_progress"))


def error_summary(logs: DataFrame, newest: int = 10) -> DataFrame:
    """AG11, SO05, JN11: one row with JSON of counts by level and by stage and of the newest errors."""
    counts = lambda key: logs.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias("k")).count().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count"))))).alias(f"by_{key}"))
    last = logs.where("level = 'error'").orderBy(F.desc("ts"), "event_id").limit(newest).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id"))), lambda x: x["event_id"])).alias("recent"))
    return counts("level").crossJoin(counts("stage")).crossJoin(last)


def memory_by_stage(metrics: DataFrame) -> DataFrame:
    """AG12: sample standard deviation, first and last time and seconds of each stage."""
    out = metrics.groupBy("experiment_id", "stage").agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.stddev_samp("value").alias("stddev"), F.count("value").alias("samples"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.withColumn("seconds", seconds_between("first", "last"))


def memory_summary(experiments: DataFrame, metrics: DataFrame, limit_gb: float = 16.0) -> DataFrame:
    """AG13, JN09: peak of each experiment's memory against its limit; the metric filter is part of the join."""
    joined = experiments.join(metrics.withColumnRenamed("experiment_id", "metric_experiment"), (F.col("experiment_id") == F.col("metric_experiment")) & (F.col("level") == "view"), "left")
    out = joined.groupBy("experiment_id").agg(F.countDistinct("stage").alias("stages"), F.max("value").alias("peak"), F.avg("value").alias("average"))
    return out.withColumn("peak_percent", F.coalesce(F.col("peak"), F.lit(0.0)) / limit_gb * 100)


def stage_efficiency(metrics: DataFrame) -> DataFrame:
    """AG14: GB-minutes of each stage, and GB a minute where it took any time."""
    two = memory_by_stage(metrics).groupBy("stage").agg(F.avg("avg").alias("avg_gb"), F.max("max").alias("peak_gb"), F.sum("seconds").alias("seconds"))
    minutes = F.col("seconds") / 60
    return two.withColumns({"gb_minutes": F.col("avg_gb") * minutes, "gb_per_minute": F.when(minutes > 0, F.col("peak_gb") / minutes).otherwise(0.0)})


def metric_summary(metrics: DataFrame, column: Column) -> DataFrame:
    """AG15, PRJ12: minimum, maximum, mean and number of a column or a JSON field; zeros where there is none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return metrics.agg(zero(F.min(column)).alias("min"), zero(F.max(column)).alias("max"), zero(F.avg(column)).alias("avg"), F.count(column).alias("count"))


def chunk_stats(pixels: DataFrame) -> DataFrame:
    """AG16."""
    return pixels.agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"), F.count(F.lit(1)).alias("pixels"), F.countDistinct("row_idx").alias("rows"), F.countDistinct("col_idx").alias("cols"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


def extent(boxes: DataFrame) -> DataFrame:
    """AG17, AG18: union of the boxes and their intersection (NULL where empty)."""
    out = boxes.agg(*(f(c).alias(f"{n}_{c}") for n, fs in (("all", (F.min, F.min, F.max, F.max)), ("common", (F.max, F.max, F.min, F.min))) for f, c in zip(fs, ("minx", "miny", "maxx", "maxy"), strict=True)))
    real = (F.col("common_minx") < F.col("common_maxx")) & (F.col("common_miny") < F.col("common_maxy"))
    return out.withColumns({f"common_{c}": F.when(real, F.col(f"common_{c}")) for c in ("minx", "miny", "maxx", "maxy")})


def feature_statistics(features: DataFrame) -> DataFrame:
    """AG20: population standard deviation and exact median."""
    return features.groupBy("feature_name").agg(F.count("feature_value").alias("count"), F.avg("feature_value").alias("mean"), F.stddev_pop("feature_value").alias("std"), F.min("feature_value").alias("min"), F.max("feature_value").alias("max"), F.median("feature_value").alias("median"))


def peak(metrics: DataFrame, by: str = "experiment_id") -> DataFrame:
    """WN01: the row with the largest value of each group, ties to the least event."""
    order = Window.partitionBy(by).orderBy(F.desc("value"), "event_id")
    return metrics.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def retained(checkpoints: DataFrame, cutoff: Column, keep: int) -> DataFrame:
    """WN02: checkpoints that stay: not valid, or new, or among the newest ``keep`` of their level."""
    order = Window.partitionBy("level").orderBy(F.desc("created_at"), F.desc("id"))
    return checkpoints.withColumn("rn", F.row_number().over(order)).where((F.col("status") != "valid") | (F.col("created_at") >= cutoff) | (F.col("rn") <= keep)).drop("rn")


def latest(metrics: DataFrame, by: str, ts: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """WN06, JN10: the newest value of each group, by one aggregation."""
    return metrics.groupBy(by).agg(F.max_by(value, F.struct(ts, tie)).alias("latest"), F.max(ts).alias("latest_ts"))


def tree(nodes: DataFrame, root: str) -> DataFrame:
    """ST06, ST07: a node and all below it, with depth and path."""
    return nodes.sparkSession.sql(
        """WITH RECURSIVE t(node_id, parent_id, depth, path) AS (
          SELECT node_id, parent_id, 0, CAST(node_id AS STRING) FROM {nodes} WHERE node_id = :root
          UNION ALL SELECT n.node_id, n.parent_id, t.depth + 1, concat(t.path, '/', n.node_id) FROM {nodes} n JOIN t ON n.parent_id = t.node_id)
        SELECT * FROM t ORDER BY path""",
        {"root": root},
        nodes=nodes,
    )


def page_after(rows: DataFrame, ts, event_id, limit: int) -> DataFrame:
    """SO07: the page after a (ts, id) cursor, newest first."""
    before = (F.col("ts") < F.lit(ts)) | (F.col("ts") == F.lit(ts)) & (F.col("event_id") < F.lit(event_id))
    return rows.where(before).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def next_tasks(queue: DataFrame, count: int = 1, max_retries: int = 3) -> DataFrame:
    """SO03: pending tasks with retries left, highest priority first, then oldest."""
    return queue.where((F.col("status") == "running") & (F.col("retry_count") < max_retries)).orderBy(F.desc("priority"), "created_at", "job_id").limit(count)


def searched(logs: DataFrame, text: str, level: str | None = None, limit: int = 100) -> DataFrame:
    """PRJ13, PRJ09: case-insensitive substring with optional level, newest first."""
    found = logs.where(F.col("stage").ilike(f"%{text}%"))
    return (found.where(F.col("level") == level) if level else found).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
