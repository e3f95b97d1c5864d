"""Queries of stores, validators, pair statistics, self-organising maps and other operators that have bodies of their own."""

import numpy as np
from pyspark.sql import functions as F

from quadrille.functions import geo as g
from quadrille.functions.basic import round6
from quadrille.operators import changes as ch
from quadrille.operators import cluster as k
from quadrille.operators import features as fe
from quadrille.operators import merge as m
from quadrille.operators import models as mr
from quadrille.operators import more, pairs
from quadrille.operators import resample as r
from quadrille.operators import spatial as sa
from quadrille.operators import splits as sp
from quadrille.operators import validation as va
from quadrille.plans import inputs as i
from quadrille.plans import q_analysis as qa
from quadrille.plans.q_clean import RAW
from quadrille.plans.q_merge import AT
from quadrille.plans.registry import query
from quadrille.sources import io, stores
from quadrille.sources.scratch import scratch


def _r(df, *columns):
    return df.withColumns({c: round6(c) for c in columns})


# Distances of all pairs.

_D = "SELECT a.id AS i, b.id AS j, a.id % 3 AS li, b.id % 3 AS lj, " + " + ".join(f"CASE WHEN a.f{n} IS NULL OR b.f{n} IS NULL THEN 0 ELSE 1 END" for n in range(4)) + " AS n, " + " + ".join(f"coalesce(abs(a.f{n} - b.f{n}), 0)" for n in range(4)) + " AS num, " + " + ".join(f"coalesce(a.f{n} + b.f{n}, 0)" for n in range(4)) + " AS den FROM s a JOIN s b ON a.id <> b.id"
_PAIRS = f"SELECT i, j, li, lj, CASE WHEN n < 2 THEN NULL WHEN den > 0 THEN num / den ELSE 0 END AS d FROM ({_D})"


def _summary(limit):
    near = f"FILTER (d <= {limit})"
    return f"SELECT i AS id, count(*) {near} AS pairs, round_even(min(d) {near}, 6) AS least, round_even(avg(d) {near}, 6) AS mean, round_even(max(d) {near}, 6) AS greatest FROM ({_PAIRS}) GROUP BY 1"


@query("km13_sparse_pairs", _summary(0.3), s=i.SAMPLE)
def _(t):
    return _r(pairs.distance_summary(qa._samples(t), 0.3), "least", "mean", "greatest")


@query("km14_distance_matrix", _summary(1.0), s=i.SAMPLE)
def _(t):
    return _r(pairs.distance_summary(qa._samples(t), 1.0), "least", "mean", "greatest")


@query("km12_silhouette", f"SELECT round_even(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM (SELECT i, min(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM (SELECT i, li, lj, avg(coalesce(d, 1)) AS d FROM ({_PAIRS}) GROUP BY 1, 2, 3) GROUP BY 1)", s=i.SAMPLE)
def _(t):
    return _r(pairs.silhouette(qa._samples(t).withColumn("label", F.col("id") % 3)), "silhouette")


@query("mt02_beta_preservation", f"SELECT round_even(greatest((b - w) / (b + w), 0), 6) AS preservation FROM (SELECT avg(d) FILTER (li = lj) AS w, avg(d) FILTER (li <> lj) AS b FROM ({_PAIRS}))", s=i.SAMPLE)
def _(t):
    return _r(pairs.beta_preservation(qa._samples(t).withColumn("label", F.col("id") % 3)), "preservation")


def _planar(name, weight, over):
    w = f"SELECT i, w / sum(w) OVER (PARTITION BY i) AS w, zi, zj FROM (SELECT a.id AS i, {weight} AS w, a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.id <> b.id WHERE {over})"
    sums = f"SELECT sum(w) AS w, sum(w * w) AS s, sum(w * zi * zj) AS num, (SELECT count(*) FROM p) AS n, (SELECT sum(z * z) FROM z) AS m2, (SELECT sum(z * z * z * z) FROM z) AS m4 FROM ({w})"
    value = "n * num / (w * m2)"
    variance = "(n * ((n * n - 3 * n + 3) * s - n * w * w + 3 * w * w) - m4 * n / (m2 * m2) * ((n * n - n) * s - 2 * n * s + 6 * w * w)) / ((n - 1.0) * (n - 2) * (n - 3) * w * w)"
    return f"SELECT '{name}' AS weights, n, round_even(coalesce({value}, 0), 6) AS moran_i, round_even(-1.0 / (n - 1), 6) AS expected, round_even(CASE WHEN {variance} > 0 THEN ({value} + 1.0 / (n - 1)) / sqrt({variance}) END, 4) AS z_score FROM ({sums})"


_DISTANCE = "sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2))"


@query("sa01_global_moran", _planar("inverse", f"1 / {_DISTANCE}", f"{_DISTANCE} > 0") + " UNION ALL " + _planar("threshold", "1.0", f"{_DISTANCE} <= 20"), p=i.SUPPLIERPOINT, z="SELECT id, lon, lat, value - avg(value) OVER () AS z FROM p")
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    out = pairs.planar_moran(p).withColumn("weights", F.lit("inverse")).unionByName(pairs.planar_moran(p, 20.0).withColumn("weights", F.lit("threshold")))
    return _r(out, "moran_i", "expected").select("weights", "n", "moran_i", "expected", (F.rint(F.col("z_score") * 1e4) / 1e4).alias("z_score"))


_SLOPE = "CASE WHEN {0}a IS NOT NULL AND {0}b IS NOT NULL THEN ({0}b - {0}a) / 2 WHEN {0}b IS NOT NULL THEN {0}b - value WHEN {0}a IS NOT NULL THEN value - {0}a ELSE 0 END"
_AROUND = "SELECT *, " + ", ".join(f"{f}(value) OVER (PARTITION BY {a} ORDER BY {b}) AS {n}" for f, n0 in (("lag", "a"), ("lead", "b")) for a, b, n in (("row_idx", "col_idx", f"x{n0}"), ("col_idx", "row_idx", f"y{n0}"))) + " FROM p"
_STRENGTH = f"SELECT least(1, 2 * avg(sqrt(pow({_SLOPE.format('x')}, 2) + pow({_SLOPE.format('y')}, 2))) / (max(value) - min(value) + 1e-8)) AS strength FROM ({_AROUND})"
_ORDERED = "SELECT ((SELECT count(*) FROM p) / sum(1 / d) * sum(zz / d) / (SELECT sum(z * z) FROM z) + 1) / 2 AS moran FROM (SELECT sqrt(pow(a.row_idx - b.row_idx, 2) + pow(a.col_idx - b.col_idx, 2)) AS d, a.z * b.z AS zz FROM z a JOIN z b ON a.row_idx <> b.row_idx OR a.col_idx <> b.col_idx)"


@query("mt03_gradient", f"SELECT round_even(moran, 6) AS moran, round_even(strength, 6) AS strength, round_even(least(greatest((moran + strength) / 2, 0), 1), 6) AS score FROM ({_ORDERED}), ({_STRENGTH})", p=i.PIXEL, z="SELECT row_idx, col_idx, value - avg(value) OVER () AS z FROM p")
def _(t):
    return _r(pairs.gradient_detection(t.view(i.PIXEL)), "moran", "strength", "score")


@query("jn21_as_of_join", "SELECT e.event_id, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= e.event_id AND o_orderkey % 8 = 0) AS last_order FROM events e")
def _(t):
    marks = t.orders.where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("mark"))
    out = more.as_of(t.events.select(F.col("event_id").alias("at"), "event_id"), marks)
    return out.select("event_id", F.col("mark").alias("last_order"))


# Validators.


@query("va02_transform", "SELECT count(*) AS points, count(*) FILTER (id % 7 = 0) AS wrong, 5.0 AS greatest, count(*) FILTER (id % 7 = 0) = 0 AS valid FROM p WHERE abs(lat) < 85", p=i.POINT)
def _(t):
    p = t.view(i.POINT).where("abs(lat) < 85")
    moved = F.when(F.col("id") % 7 == 0, 5.0).otherwise(0.25)
    given = p.withColumns({"ex": F.radians("lon") * 6378137 + moved, "ey": F.log(F.tan(F.lit(np.pi / 4) + F.radians("lat") / 2)) * 6378137})
    return va.transform_errors(given, g.mercator("lon", "lat"), ("ex", "ey"))


def _ranges(kind, high):
    issues = f"concat_ws(',', CASE WHEN least < 0 THEN 'negative' END, CASE WHEN most > 2 * {high} THEN 'far above' END)"
    warnings = f"concat_ws(',', CASE WHEN most > {high} AND most <= 2 * {high} THEN 'above' END, CASE WHEN mean - floor(mean) > 0.01 THEN 'fractional' END, CASE WHEN std > 2 * mean THEN 'variance' END)"
    return f"SELECT '{kind}' AS kind, least, most, round_even(mean, 6) AS mean, {issues} AS issues, {warnings} AS warnings, {issues} = '' AS valid FROM (SELECT min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_pop(value) AS std FROM p)"


@query("va04_value_ranges", " UNION ALL ".join(_ranges(n, h) for n, (_, h) in va.EXPECTED.items()), p=RAW)
def _(t):
    out = None
    for kind in va.EXPECTED:
        one = va.value_ranges(t.view(RAW), kind).select(F.lit(kind).alias("kind"), "least", "most", round6("mean").alias("mean"), "issues", "warnings", "valid")
        out = one if out is None else out.unionByName(one)
    return out


RASTERS = "SELECT grid_id, name, CASE WHEN grid_id = 4 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs, CASE WHEN grid_id = 3 THEN 0.5e0 ELSE 0.25e0 END AS resolution, minx, miny, maxx, maxy FROM ({})".format(i.GRID)


@query("va07_consistency", " UNION ALL ".join(f"SELECT {n} AS first, count(*) AS rasters, max(resolution) - min(resolution) < 1e-6 AS resolution_consistent, min(crs) = max(crs) AS crs_consistent, min(maxx) > max(minx) AND min(maxy) > max(miny) AS spatial_overlap, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM r WHERE grid_id < {n}" for n in (3, 4, 5)), r=RASTERS)
def _(t):
    out = None
    for n in (3, 4, 5):
        one = va.consistency(t.view(RASTERS).where(F.col("grid_id") < n)).withColumn("first", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


_FAILED = "SELECT '{0}' AS validator, '{1}' AS severity, {2} AS failed, {3} AS skipped, {2} = 0 OR '{1}' = 'warning' AS valid FROM s"


@query("va10_validation_framework", " UNION ALL ".join(_FAILED.format(*x) for x in (("table.features.f0", "error", "count(*) FILTER (f0 IS NULL)", "false"), ("table.features.f1", "warning", "count(*) FILTER (f1 IS NULL OR f1 > 9)", "false"), ("table.conditional(large)", "error", "CAST(0 * count(*) AS BIGINT)", "true"), ("table.conditional(some)", "critical", "count(*) FILTER (f3 IS NULL OR f3 > 23)", "false"))), s=i.SAMPLE)
def _(t):
    features = va.Composite("features", [va.Check("f0", F.col("f0").isNotNull()), va.Check("f1", F.col("f1") <= 9, "warning")])
    large = va.Check("large", F.col("f2") < 0).conditional(F.count(F.lit(1)) > 10**12)
    some = va.Check("some", F.col("f3") <= 23, "critical").conditional(F.count("f3") > 0)
    return va.validated(t.view(i.SAMPLE), va.Composite("table", [features, large, some]))


@query("va12_storage_accuracy", "SELECT count(*) AS rows, count(*) FILTER (row_idx % 10 = 3) AS wrong, CASE WHEN count(*) FILTER (row_idx % 10 = 3) > 0 THEN 0.125 ELSE 0.0 END AS greatest, min(col_idx) = 0 AND max(col_idx) = 63 AND min(row_idx) = 0 AND max(row_idx) = 63 AS bounds_match, count(*) FILTER (row_idx % 10 = 3) = 0 AS valid FROM p", p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "accuracy")
    stored = m.with_coordinates(t.view(i.PIXEL), **AT).withColumn("x", F.col("x") + F.when(F.col("row_idx") % 10 == 3, 0.125).otherwise(0.0))
    io.write_parquet(stored, path)
    return va.storage_accuracy(t.spark.read.parquet(path), AT["minx"], AT["maxy"], AT["resolution"], (-32.0, -32.0, 32.0, 32.0))


@query("cl02_constraints", " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) FILTER (value < {a}) AS below, count(*) FILTER (value > {b}) AS above, round_even(avg(value) + {c} * stddev_pop(value), 4) AS cap FROM p" for n, a, b, c in (("plants", 0.0, 20000.0, 4.0), ("vertebrates", 0.0, 2000.0, 4.0), ("all", 0.0, 25000.0, 5.0))), p=RAW)
def _(t):
    from quadrille.operators.clean import CONSTRAINTS

    table = t.spark.createDataFrame([(n, *c) for n, c in CONSTRAINTS.items()], "kind string, least double, most double, k double")
    rows = t.view(RAW).crossJoin(F.broadcast(table)).groupBy("kind", "k")
    out = rows.agg(F.count_if(F.col("value") < F.col("least")).alias("below"), F.count_if(F.col("value") > F.col("most")).alias("above"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("kind", "below", "above", (F.rint((F.col("mean") + F.col("k") * F.col("std")) * 1e4) / 1e4).alias("cap"))


# Grids and resampling.


@query("fn07_cell_degrees", "SELECT id, round_even(10000 / ((111319.9 + 111319.9 * cos(radians(lat))) / 2), 6) AS degrees FROM p", p=i.SUPPLIERPOINT)
def _(t):
    return t.view(i.SUPPLIERPOINT).select("id", round6(g.degrees_of(10000, "lat")).alias("degrees"))


@query("re05_output_shape", "SELECT name, CAST(ceil((maxy - miny) / 0.3) AS INT) AS height, CAST(ceil((maxx - minx) / 0.3) AS INT) AS width, resolution > 0.3 AS is_upsampling, round_even(resolution / 0.3, 6) AS scale_factor FROM r", r=RASTERS)
def _(t):
    return _r(more.output_shape(t.view(RASTERS), 0.3), "scale_factor").select("name", "height", "width", "is_upsampling", "scale_factor")


@query("prj20_passthrough_decision", "SELECT grid_id, abs(resolution - 2001) <= 1 AS resampler, abs(resolution - 2001) < 1 AS loader FROM g", g=i.GRID)
def _(t):
    decided = lambda strict: more.passthrough(F.col("resolution"), F.lit(2001), 1, strict)
    return t.view(i.GRID).select("grid_id", decided(False).alias("resampler"), decided(True).alias("loader"))


_BLOCKS = "SELECT '{0}' AS method, count(*) AS cells, round_even(sum(v), 4) AS total FROM (SELECT {1} AS v FROM p GROUP BY row_idx // 4, col_idx // 4)"
_NEAREST = "SELECT 'nearest' AS method, count(*) AS cells, round_even(sum(value), 4) AS total FROM range(16) a(r) CROSS JOIN range(16) b(c) LEFT JOIN p ON row_idx = floor(r * 63 / 15.0 + 0.5) AND col_idx = floor(c * 63 / 15.0 + 0.5)"


@query("re01_dispatch", " UNION ALL ".join([*(_BLOCKS.format(*x) for x in (("mean", "avg(value)"), ("sum", "sum(value)"), ("max", "max(value)"), ("min", "min(value)"))), _NEAREST]), p=i.PIXEL)
def _(t):
    out = None
    for method in ("mean", "sum", "max", "min", "nearest"):
        found = r.resample(t.view(i.PIXEL), method, 4.0, (64, 64)).agg(F.count(F.lit(1)).alias("cells"), (F.rint(F.sum("value") * 1e4) / 1e4).alias("total"))
        one = found.select(F.lit(method).alias("method"), "cells", "total")
        out = one if out is None else out.unionByName(one)
    return out


_MEANS = "SELECT CAST(row_idx // 4 AS INT) AS target_row, CAST(col_idx // 4 AS INT) AS target_col, round_even(avg(value), 6) AS value FROM p GROUP BY 1, 2"


@query("re03_partitioned_resample", _MEANS, p=i.PIXEL)
def _(t):
    return _r(r.resample_chunks(t.view(i.PIXEL), "mean", 4, (64, 64), 16), "value")


@query("re04_resample_and_store", "SELECT CAST(row_idx // 4 AS INT) AS target_row, CAST(col_idx // 4 AS INT) AS target_col, sum(value) AS value FROM p GROUP BY 1, 2", p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "target")
    made = r.resample(t.view(i.PIXEL), "sum", 4.0, (64, 64))
    stale = made.where("target_row % 2 = 0").withColumn("value", F.lit(-1.0))
    io.write_parquet(ch.upserted(stale, made, ["target_row", "target_col"]), path)
    return t.spark.read.parquet(path)


@query("re10_cached_result", " UNION ALL ".join(f"SELECT '{n}' AS step, {f} AS found, {c} AS rows FROM (SELECT count(DISTINCT (row_idx // 4, col_idx // 4)) AS n FROM p)" for n, f, c in (("first", "false", "0"), ("fresh", "true", "n"), ("expired", "false", "0"), ("made again", "true", "n"), ("after eviction", "false", "0"), ("hits", "true", "1"), ("misses", "true", "4"), ("entries", "true", "0"))), p=i.PIXEL)
def _(t):
    cache = stores.ResultCache(t.spark, scratch(t.spark, "cache"), ttl=100)
    make = lambda: r.resample(t.view(i.PIXEL), "mean", 4.0, (64, 64))
    out, look = [], lambda step, df: out.append((step, df is not None, df.count() if df is not None else 0))
    look("first", cache.get("k", 0))
    cache.put("k", make(), 1)
    look("fresh", cache.get("k", 50))
    look("expired", cache.get("k", 200))
    look("made again", cache.get_or_make("k", make, 201))
    cache.evict(0, 203)
    look("after eviction", cache.get("k", 204))
    stats = cache.stats().first()
    out += [(n, True, stats[n]) for n in ("hits", "misses", "entries")]
    return t.spark.createDataFrame(out, "step string, found boolean, rows long")


# Sources and sinks.


@query("snk15_subset_export", "SELECT event_id FROM events WHERE value > 50 ORDER BY event_id LIMIT 25")
def _(t):
    path = scratch(t.spark, "subset") + ".json"
    t.events.where("value > 50").orderBy("event_id").limit(25).select("event_id").write.json(path)
    return io.read_table(t.spark, path, "event_id long")


def _bands(t):
    return [t.view(i.PIXEL).where((F.col("row_idx") >= n) & (F.col("row_idx") < n + 16)) for n in range(0, 64, 16)]


@query("snk06_streaming_csv", "SELECT row_idx, col_idx, value FROM p", p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "chunks") + ".csv"
    io.export_chunks(_bands(t), path, "csv", compression="gzip")
    return io.read_table(t.spark, path, "row_idx int, col_idx int, value double")


@query("snk07_streaming_parquet", "SELECT row_idx, col_idx, value, 4 AS chunks FROM p", p=i.PIXEL)
def _(t):
    path = scratch(t.spark, "chunks")
    chunks = io.export_chunks(_bands(t), path, "parquet", **{"parquet.block.size": 1 << 20})
    return io.read_table(t.spark, path).withColumn("chunks", F.lit(chunks))


@query("src04_csv_scan", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def _(t):
    path = scratch(t.spark, "nulls") + ".csv"
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("s_acctbal"))
    io.write_csv(rows, path)
    return io.read_table(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("snk08_metadata_sidecar", "SELECT count(*) AS rows, 'bigint' AS key_type, 'double' AS balance_type, 'parquet' AS format FROM supplier")
def _(t):
    path = scratch(t.spark, "metadata")
    io.write_sidecar(t.supplier.select("s_suppkey", "s_acctbal"), path, {"format": "parquet"})
    read = t.spark.read.schema("rows long, metadata string").json(path)
    field = lambda p: F.get_json_object("metadata", p)
    return read.select("rows", field("$.columns.s_suppkey").alias("key_type"), field("$.columns.s_acctbal").alias("balance_type"), field("$.format").alias("format"))


@query("snk12_climate_metadata", "SELECT id, lon AS x, CASE WHEN id % 9 <> 0 THEN lat END AS y, CAST(CAST(value AS FLOAT) AS DOUBLE) AS bio01, (SELECT count(*) FROM p WHERE id % 9 = 0) AS missing FROM p", p=i.POINT)
def _(t):
    p = t.view(i.POINT)
    path = scratch(t.spark, "climate")
    io.write_climate(p.select("id", F.col("lon").cast("string").alias("x"), F.when(F.col("id") % 9 == 0, "none").otherwise(F.col("lat").cast("string")).alias("y"), F.col("value").alias("bio01")), path)
    missing = t.spark.read.schema("rows long, metadata string").json(f"{path}.metadata").select(F.get_json_object("metadata", "$.missing_coordinates").cast("long").alias("missing"))
    return t.spark.read.parquet(path).withColumn("bio01", F.col("bio01").cast("double")).crossJoin(missing)


def _results(t):
    store = stores.ResultStore(t.spark, scratch(t.spark, "results"))
    for n in (1, 2, 3):
        rows = t.view(i.METRIC).where(F.col("experiment_id") == n).select("event_id", "value")
        store.save(str(n), rows, {"rows": rows.count()}, at=n)
    return store


@query("snk13_result_store", "SELECT experiment_id, event_id, value FROM m WHERE experiment_id IN (1, 3)", m=i.METRIC)
def _(t):
    store = _results(t)
    store.delete("2", at=10)
    out = None
    for name in (x.experiment for x in store.list().collect()):
        one = store.load(name).select(F.lit(int(name)).cast("long").alias("experiment_id"), "event_id", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk14_analysis_store", " UNION ALL ".join(f"SELECT '{n}' AS experiment, count(*) AS rows, '{{\"rows\": ' || count(*) || '}}' AS statistics FROM m WHERE experiment_id = {n}" for n in (3, 2)), m=i.METRIC)
def _(t):
    return _results(t).list(2).select("experiment", "rows", "statistics")


@query("src03_partitioned_scan", "SELECT event_id, value FROM m WHERE experiment_id = 3", m=i.METRIC)
def _(t):
    path = scratch(t.spark, "experiments")
    io.write_parquet(t.view(i.METRIC).repartition("experiment_id"), path, partition_by=["experiment_id"])
    return t.spark.read.parquet(path).where("experiment_id = 3").select("event_id", "value")


@query("snk17_log_batches", "SELECT sum(least(n, 100)) AS kept, sum(greatest(n - 100, 0)) AS dropped, sum(least(n, 100)) AS written FROM (SELECT count(*) AS n FROM events GROUP BY event_id % 4 = 0)")
def _(t):
    from quadrille.streaming.events import event_stream, log_sink

    folder, out = scratch(t.spark, "incoming"), scratch(t.spark, "logged")
    for n, part in enumerate(("event_id % 4 = 0", "event_id % 4 <> 0")):
        t.events.where(part).coalesce(1).write.mode("append").parquet(folder)
    log_sink(event_stream(t.spark, folder, t.events.schema, 1), out, scratch(t.spark, "offsets"), capacity=100)
    written = t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("written"))
    return t.spark.read.parquet(f"{out}.dropped").agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped")).crossJoin(written)


@query("snk09_experiment_rows", "SELECT 'cell_' || (row_idx * 64 + col_idx) AS cell_id, -32 + (col_idx + 0.5) AS x, 32 - (row_idx + 0.5) AS y, a.value AS accepted, r.value AS returned FROM a FULL JOIN r USING (row_idx, col_idx) WHERE -32 + (col_idx + 0.5) BETWEEN -10 AND 20.5 AND 32 - (row_idx + 0.5) BETWEEN -20.5 AND 8", a=i.PIXEL_A, r=i.PIXEL_R)
def _(t):
    path = scratch(t.spark, "experiment") + ".csv"
    rows = io.experiment_rows({"accepted": t.view(i.PIXEL_A), "returned": t.view(i.PIXEL_R)}, **AT, width=64, bounds=(-10.0, -20.5, 20.5, 8.0))
    io.write_csv(rows, path, gzip=True)
    return io.read_table(t.spark, path, "cell_id string, x double, y double, accepted double, returned double")


_CLOSE = f"SELECT {qa.HAV} AS km FROM p a JOIN p b ON a.id % 5 <> 0 AND b.id % 5 = 0 WHERE {qa.HAV} < {{0}}"


@query("sa06_independence", " UNION ALL ".join(f"SELECT {km} AS distance, count(*) = 0 AS independent, count(*) AS closer, round_even(min(km), 6) AS least FROM ({_CLOSE.format(km)})" for km in (1, 500)), p=i.SUPPLIERPOINT)
def _(t):
    p = t.view(i.SUPPLIERPOINT)
    out = None
    for km in (1, 500):
        one = sa.independence(p.where("id % 5 <> 0"), p.where("id % 5 = 0"), float(km)).withColumn("distance", F.lit(km))
        out = one if out is None else out.unionByName(one)
    return _r(out, "least")


# Updates and progress.

_LEVELS = "SELECT node_id, parent_id, CASE substr(node_id, 1, 1) WHEN 'r' THEN 'phase' WHEN 'n' THEN 'step' ELSE 'task' END AS level, CAST(CASE substr(node_id, 1, 1) WHEN 'r' THEN 5 WHEN 'n' THEN 40 ELSE 100 END AS BIGINT) AS total_units, CAST(progress AS BIGINT) AS completed_units FROM n"
_STEP = "coalesce((SELECT CAST(floor(40 * avg(c.progress) / 100) AS BIGINT) FROM n c WHERE c.parent_id = x.node_id), 0)"


@query("mu10_progress_propagation", "SELECT node_id, level, CASE level WHEN 'task' THEN completed_units WHEN 'step' THEN units ELSE (SELECT count(*) FROM l y WHERE y.parent_id = l.node_id AND y.units >= 40) END AS completed_units FROM l", n=i.NODE, l=f"SELECT x.*, CASE WHEN level = 'step' THEN {_STEP} ELSE completed_units END AS units FROM ({_LEVELS}) x")
def _(t):
    nodes = t.spark.sql(_LEVELS.replace("FROM n", "FROM {n}"), n=t.view(i.NODE))
    return ch.completed_units(nodes).select("node_id", "level", "completed_units")


@query("mu15_tile_statistics_update", "SELECT CAST(ty AS INT) AS tile_y, CAST(tx AS INT) AS tile_x, coalesce(n, 0) AS pixels, round_even(mean, 6) AS mean, most, CASE WHEN n IS NULL THEN 'empty' ELSE 'done' END AS status FROM range(9) a(ty) CROSS JOIN range(9) b(tx) LEFT JOIN (SELECT row_idx // 8 AS ty, col_idx // 8 AS tx, count(value) AS n, avg(value) AS mean, max(value) AS most FROM p GROUP BY 1, 2) USING (ty, tx)", p=i.PIXEL)
def _(t):
    tile = lambda c: F.floor(F.col(c) / 8).cast("int")
    tiles = t.spark.range(81).select(F.floor(F.col("id") / 9).cast("int").alias("tile_y"), (F.col("id") % 9).cast("int").alias("tile_x"))
    return _r(ch.with_statistics(tiles, t.view(i.PIXEL).select(tile("row_idx").alias("tile_y"), tile("col_idx").alias("tile_x"), "value")), "mean")


# Clustering and maps.


@query("km02_quality_strata", f"SELECT id, CASE WHEN v >= 3 THEN 'high' WHEN v = 2 THEN 'medium' ELSE 'low' END AS stratum FROM (SELECT id, {qa._NV} AS v FROM s) WHERE v >= 1", s=i.SAMPLE)
def _(t):
    return k.prefiltered(qa._samples(t), 1).select("id", "stratum")


@query("km05_initial_centres")
def _(t):
    rows = k.initial_centres(qa._samples(t), 4)
    return t.spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(rows)], "centre int, x array<double>")


@query("km11_best_k")
def _(t):
    out = []
    for method in ("silhouette", "elbow", "middle"):
        best, scores = k.choose_k(qa._samples(t), [2, 3, 4], method, iterations=2, sample_rows=300)
        out += [(method, n, round(s, 6), n == best) for n, s in scores.items()]
    return t.spark.createDataFrame(out, "method string, k int, score double, best boolean")


@query("sm01_initial_neurons")
def _(t):
    rows = [(method, n, x.tolist()) for method in ("pca", "stratified", "best_of", "random") for n, x in enumerate(k.som_start(qa._samples(t), (2, 3), method))]
    return t.spark.createDataFrame(rows, "method string, neuron int, weights array<double>")


@query("sm04_learning_schedule")
def _(t):
    _, history, ended = k.train_geo_som(qa._samples(t), (3, 3), epochs=12)
    return t.spark.createDataFrame([(*h.values(), ended) for h in history], "epoch int, error double, rate double, radius double, ended string")


@query("sm07_batch_som")
def _(t):
    rows = [(kind, *h.values()) for kind in ("gaussian", "bubble", "mexican_hat") for h in k.train_legacy_som(qa._samples(t), (3, 3), epochs=3, kind=kind)[1]]
    return t.spark.createDataFrame(rows, "kind string, epoch int, error double, rate double, radius double")


def _trained(t):
    return k.train_geo_som(qa._samples(t), (3, 3), epochs=3)[0]


@query("sm09_u_matrix")
def _(t):
    return t.spark.createDataFrame([(n, float(x)) for n, x in enumerate(k.u_matrix(_trained(t), (3, 3)).ravel())], "neuron int, u double")


@query("sm13_feature_importance")
def _(t):
    return t.spark.createDataFrame([(f"f{n}", float(x)) for n, x in enumerate(k.importance(_trained(t)))], "feature string, share double")


_LAST = "OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("wn11_training_history", f"SELECT run, epoch, round_even(CASE WHEN n > 10 THEN m END, 6) AS rate_mean, round_even(CASE WHEN n > 10 THEN s END, 6) AS rate_std, round_even(CASE WHEN n > 10 THEN s / m END, 6) AS stability FROM (SELECT experiment_id AS run, event_id AS epoch, avg(value) {_LAST} AS m, stddev_pop(value) {_LAST} AS s, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM (SELECT *, experiment_id AS run, event_id AS epoch FROM m))", m=i.METRIC)
def _(t):
    history = t.view(i.METRIC).select(F.col("experiment_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("rate"))
    return _r(k.rate_stability(history), "rate_mean", "rate_std", "stability").drop("rate")


@query("sp06_lattice_folds", "SELECT id, CAST(CASE WHEN lon < x1 AND lat < y1 THEN floor((lon - x0) * 3 / (x1 - x0)) * 3 + floor((lat - y0) * 3 / (y1 - y0)) ELSE 0 END AS INT) AS block FROM p, (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p)", p=i.POINT)
def _(t):
    return sp.lattice_blocks(t.view(i.POINT), 5).select("id", "block")


@query("sp06_buffered_folds")
def _(t):
    folds = sp.lattice_folds(t.view(i.POINT), 5).persist()
    out = None
    for f in range(5):
        train, test = sp.fold_split(folds, f, 3.0)
        one = train.select(F.lit(f).alias("fold"), "id", F.lit("train").alias("part")).unionByName(test.select(F.lit(f).alias("fold"), "id", F.lit("test").alias("part")))
        out = one if out is None else out.unionByName(one)
    return out


# Features and models.


@query("fe04_ecological_features", "SELECT id, latitude * longitude AS temp_x_precip_interaction, round_even(s / (m + 1e-8), 6) AS vegetation_seasonality, round_even(sqrt(pow(latitude, 2) + pow(longitude / 180, 2)), 6) AS terrain_complexity FROM (SELECT id, latitude, longitude, (SELECT avg(v) FROM unnest([plants_richness, terrestrial_richness, marine_richness]) u(v)) AS m, (SELECT stddev_samp(v) FROM unnest([plants_richness, terrestrial_richness, marine_richness]) u(v)) AS s FROM r)", r=i.RICHNESS)
def _(t):
    renamed = t.view(i.RICHNESS).select("id", F.col("latitude").alias("temp"), F.col("longitude").alias("precip"), F.col("plants_richness").alias("ndvi"), F.col("terrestrial_richness").alias("evi"), F.col("marine_richness").alias("lai"), F.col("latitude").alias("slope"), F.col("longitude").alias("aspect"))
    return _r(fe.ecological_features(renamed), "vegetation_seasonality", "terrain_complexity").select("id", "temp_x_precip_interaction", "vegetation_seasonality", "terrain_complexity")


@query("ex07_feature_builder", "SELECT id, round_even((latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER (), 6) AS latitude_z, round_even((longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER (), 6) AS longitude_z FROM r", r=i.RICHNESS)
def _(t):
    builder = fe.banded(["latitude", "longitude"], lambda c: {"mean": F.avg(c), "std": F.stddev_pop(c)}, lambda c, s: {"z": (F.col(c) - s["mean"]) / s["std"]})
    out = builder.fit_transform(t.view(i.RICHNESS))
    return _r(out, *builder.names).select("id", *builder.names)


_TWO = "SELECT count(*) AS n, var_pop(a) * count(*) + 1.0 AS aa, var_pop(b) * count(*) + 1.0 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS cy FROM p"


@query("so04_top_features", f"SELECT feature, round_even(abs(w) / (sum(abs(w)) OVER ()), 6) AS importance FROM (SELECT 'a' AS feature, (bb * ay - ab * cy) / (aa * bb - ab * ab) AS w FROM ({_TWO}) UNION ALL SELECT 'b', (aa * cy - ab * ay) / (aa * bb - ab * ab) FROM ({_TWO})) ORDER BY 2 DESC, 1 LIMIT 2", p=qa.XY)
def _(t):
    found = mr.importance(["a", "b"], mr.ridge(t.view(qa.XY), ["a", "b"], "y", 1.0))[:2]
    return t.spark.createDataFrame([(n, float(np.rint(x * 1e6) / 1e6)) for n, x in found], "feature string, importance double")


_FIT = "SELECT y, a, my - w * ma + w * a AS q FROM p, (SELECT covar_pop(a, y) / var_pop(a) AS w, avg(y) AS my, avg(a) AS ma FROM p)"


@query("mr05_information_criteria", f"SELECT round_even(6 - 2 * ll, 4) AS aic, round_even(3 * ln(n) - 2 * ll, 4) AS bic, round_even(mean, 6) AS residual_mean, round_even(std, 6) AS residual_std, round_even(bp * n, 6) AS bp_statistic FROM (SELECT *, -0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1) AS ll FROM (SELECT count(*) AS n, sum(pow(y - q, 2)) AS rss, avg(y - q) AS mean, stddev_pop(y - q) AS std, pow(corr(pow(y - q, 2), q), 2) AS bp FROM ({_FIT})))", p=qa.XY)
def _(t):
    rows = t.view(qa.XY)
    w, b = mr.ridge(rows, ["a"], "y", 0.0)
    fitted = rows.withColumn("q", F.col("a") * float(w[0]) + float(b))
    s = fitted.agg(F.sum((F.col("y") - F.col("q")) ** 2).alias("rss"), F.count("y").alias("n")).first()
    aic, bic = mr.information_criteria(mr.log_likelihood(s.rss, s.n), 3, s.n)
    out = _r(mr.residual_diagnostics(fitted, "y", "q"), "residual_mean", "residual_std", "bp_statistic")
    return out.select(F.lit(round(aic, 4)).alias("aic"), F.lit(round(bic, 4)).alias("bic"), "residual_mean", "residual_std", "bp_statistic")


@query("mr08_nested_workflow")
def _(t):
    rows = mr.nested_workflow(t.view(qa.XY), [["a"], ["a", "b"]], "y")
    return t.spark.createDataFrame([tuple(x.values()) for x in rows], "model string, r2 double, aic double, bic double, statistic double, p double, supported boolean")


@query("mr09_model_persistence", f"SELECT id, round_even(w * a + my - w * ma, 4) AS prediction FROM p, (SELECT covar_pop(a, y) / var_pop(a) AS w, avg(y) AS my, avg(a) AS ma FROM p)", p=qa.XY)
def _(t):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, LinearRegressionModel

    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(t.view(qa.XY))
    path = scratch(t.spark, "model")
    LinearRegression(labelCol="y", regParam=0.0, solver="normal").fit(rows).save(path)
    return LinearRegressionModel.load(path).transform(rows).select("id", (F.rint(F.col("prediction") * 1e4) / 1e4).alias("prediction"))


_PLACES = ((-100.0, 40.0), (0.0, 0.0), (120.0, -30.0))
_AT = " WHEN ".join(f"{n} THEN 2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin(radians({a} - lon) / 2), 2), 1.0)))" for n, (a, b) in enumerate(_PLACES))


@query("sm02_best_matching_unit", f"SELECT id, CAST(CASE WHEN v >= 2 THEN k ELSE -1 END AS INT) AS label, CASE WHEN v >= 2 THEN round_even(d, 6) END AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS n FROM (SELECT id, k, 0.7 * ({qa._NUM}) / ({qa._DEN}) + 0.3 * (CASE k WHEN {_AT} END) / 20000 AS d, {qa._NV} AS v FROM s JOIN p USING (id), {qa._C})) WHERE n = 1", s=i.SAMPLE, p=i.POINT)
def _(t):
    rows = qa._samples(t).join(t.view(i.POINT).select("id", "lon", "lat"), "id")
    return _r(k.assign(rows, qa.CENTRES, places=np.array(_PLACES), zero=np.inf).select("id", "label", "distance"), "distance")


_T = "abs({0}_idx + 0.5 - (target_{0} + 0.5) * 4) / 4"
_KERNELS = {
    "cubic": "CASE WHEN {0} <= 1 THEN 1.5 * pow({0}, 3) - 2.5 * pow({0}, 2) + 1 WHEN {0} < 2 THEN -0.5 * pow({0}, 3) + 2.5 * pow({0}, 2) - 4 * {0} + 2 ELSE 0 END",
    "cubicspline": "CASE WHEN {0} < 1 THEN (4 - 6 * pow({0}, 2) + 3 * pow({0}, 3)) / 6 WHEN {0} < 2 THEN pow(2 - {0}, 3) / 6 ELSE 0 END",
    "lanczos": "CASE WHEN {0} < 1e-9 THEN 1 WHEN {0} < 3 THEN 3 * sin(pi() * {0}) * sin(pi() * {0} / 3) / pow(pi() * {0}, 2) ELSE 0 END",
}
_WARP = "SELECT '{0}' AS method, target_row, target_col, round_even(sum(a * b * value) / sum(a * b), 6) AS value FROM (SELECT CAST(r AS INT) AS target_row, CAST(c AS INT) AS target_col, value, {1} AS a, {2} AS b FROM (SELECT *, r AS target_row, c AS target_col FROM p, range(16) x(r), range(16) y(c))) WHERE a <> 0 AND b <> 0 GROUP BY ALL"


@query("ag29_warp_kernels", " UNION ALL ".join(_WARP.format(n, x.format(_T.format("row")), x.format(_T.format("col"))) for n, x in _KERNELS.items()), p=i.PIXEL)
def _(t):
    out = None
    for method in _KERNELS:
        one = r.warped(t.view(i.PIXEL), (64, 64), (16, 16), method).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return _r(out, "value")


_REQUEST = "SELECT s_suppkey AS id, CAST(1 + s_suppkey % 13 AS DOUBLE) / 4 AS scale_y, CAST(1 + s_suppkey % 7 AS DOUBLE) / 8 AS scale_x, CASE s_suppkey % 6 WHEN 0 THEN 'nearest' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'bicubic' WHEN 3 THEN 'lanczos' WHEN 4 THEN 'average' ELSE 'sum' END AS method, s_suppkey % 5 = 0 AS categorical, CASE s_suppkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'safe' ELSE 'unsafe' END AS cast FROM {supplier}"
_SUITS = "CASE method WHEN 'bilinear' THEN scale_y > 0.1 AND scale_x > 0.1 WHEN 'bicubic' THEN scale_y > 0.1 AND scale_x > 0.1 WHEN 'lanczos' THEN scale_y > 0.5 AND scale_x > 0.5 WHEN 'average' THEN scale_y <= 1 AND scale_x <= 1 ELSE true END"


@query("re06_method_report", f"SELECT id, {_SUITS} AS suitable, CASE WHEN categorical THEN 'nearest' WHEN s > 2 THEN 'bicubic' WHEN s < 0.5 THEN 'average' ELSE 'bilinear' END AS recommended, round_even(pow(CASE WHEN s BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN s BETWEEN 0.5 AND 2 THEN 0.8 WHEN s BETWEEN 0.1 AND 5 THEN 0.6 ELSE 0.3 END * CASE \"cast\" WHEN 'same' THEN 1.0 WHEN 'safe' THEN 0.9 ELSE 0.7 END * CASE WHEN {_SUITS} THEN 1.0 ELSE 0.6 END, 1 / 3.0), 6) AS confidence, CASE WHEN s < 1 THEN 1 - s ELSE 0.1 END AS information_loss, CASE WHEN s < 0.5 AND method <> 'average' THEN 0.7 ELSE 0.1 END AS aliasing_risk, CASE method WHEN 'nearest' THEN 0.6 WHEN 'bilinear' THEN 0.8 WHEN 'bicubic' THEN 0.9 ELSE 0.7 END AS accuracy FROM (SELECT *, (scale_x + scale_y) / 2 AS s FROM r)", r=_REQUEST.replace("AS cast", 'AS "cast"'))
def _(t):
    return _r(r.method_report(t.view(_REQUEST)), "confidence").drop("scale_y", "scale_x", "method", "categorical", "cast")


_TESTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN concat('TEST_', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 4 = 1 THEN 'run' ELSE NULL END AS name, o_orderdate AS created_at FROM {orders}"


@query("mu14_test_rows", "SELECT id FROM x WHERE NOT (coalesce(name, '') LIKE 'TEST\\_%' ESCAPE '\\' AND created_at > TIMESTAMP '1995-01-01 12:00:00' - INTERVAL 48 HOUR)", x=_TESTS)
def _(t):
    return ch.without_test_rows(t.view(_TESTS), F.lit("1995-01-01 12:00:00").cast("timestamp"), 48).select("id")


_FAILURES = "SELECT event_id AS at, concat('stage', CAST(user_id % 9 AS STRING)) AS stage, CASE event_id % 4 WHEN 0 THEN 'Connection lost' WHEN 1 THEN 'validation failed' WHEN 2 THEN 'broken' ELSE NULL END AS message FROM {events}"


@query("ex14_recovery_plan", "SELECT \"at\", stage, n AS attempt, strategy, CASE WHEN strategy = 'retry' THEN CASE n WHEN 1 THEN 30 ELSE 60 END END AS delay FROM (SELECT *, CASE WHEN message = 'Connection lost' THEN 'retry' WHEN message = 'validation failed' AND stage IN ('stage3', 'stage4') THEN 'skip' WHEN n > 3 THEN 'abort' ELSE 'retry' END AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY \"at\") AS n FROM f))", f=_FAILURES.replace("AS at", 'AS "at"'))
def _(t):
    return ch.recovery_plan(t.view(_FAILURES), ("stage3", "stage4")).drop("message")


# Components.


@query("ex02_registration", "SELECT * FROM (VALUES ('cv', 'folds', ''), ('model', 'line', 'tif'), ('raster_source', 'pixels', 'parquet,tif'), ('raster_source', 'tiles', 'tif')) v(kind, name, formats)")
def _(t):
    from quadrille.plans.components import Registry

    registry = Registry()
    source, model, cv = (registry.decorator(kind) for kind in ("raster_source", "model", "cv"))
    source("pixels", formats=["tif", "parquet"])(lambda: None)
    source("tiles", formats=["tif"], resolutions=(0.0, 1.0))(lambda: None)
    model("line", formats=["tif"])(lambda: None)
    cv("folds")(lambda: None)
    return t.spark.createDataFrame([x[:3] for x in registry.listed()], "kind string, name string, formats string")


@query("ex03_analyzer_factory", "SELECT * FROM (VALUES ('kmeans', 'kmeans'), ('som', 'train_som'), ('geo_som', 'train_geo_som'), ('legacy_som', 'train_legacy_som')) v(method, made)")
def _(t):
    from quadrille.plans.components import ANALYZERS, analyzer

    return t.spark.createDataFrame([(n, analyzer(n).__name__) for n in ANALYZERS], "method string, made string")


@query("ex13_skip_when_fresh", "SELECT * FROM (VALUES ('missing', false), ('written', true), ('written, a day', true), ('old, a day', false), ('half written', false)) v(stage, skip)")
def _(t):
    import time

    from quadrille.plans.components import fresh

    missing, path, half = (scratch(t.spark, n) for n in ("missing", "stage", "half"))
    io.write_parquet(t.region, path)
    t.region.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    now = time.time()
    rows = [("missing", fresh(t.spark, missing, now)), ("written", fresh(t.spark, path, now)), ("written, a day", fresh(t.spark, path, now, 1)), ("old, a day", fresh(t.spark, path, now + 2 * 86400, 1)), ("half written", fresh(t.spark, half, now))]
    return t.spark.createDataFrame(rows, "stage string, skip boolean")


@query("ex08_batch_processor", " UNION ALL ".join(f"SELECT {n} AS place, '{name}' AS stage, '{state}' AS state, {rows} AS rows FROM events" for n, (name, state, rows) in enumerate((("raw", "again", "0 * count(*)"), ("raw", "made", "count(*)"), ("large", "made", "count(*) FILTER (value > 50)"), ("raw", "taken up", "count(*)"), ("large", "made", "count(*) FILTER (value > 50)")))))
def _(t):
    from quadrille.plans.stages import Stages

    seen, tries = [], []
    stages = Stages(t.spark, scratch(t.spark, "stages"), progress=lambda *x: seen.append((len(seen), *x)))

    def raw():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("connection lost")
        return t.events.select("event_id", "value")

    for again in (False, True):
        rows = stages.run("raw", raw)
        stages.run("large", lambda rows=rows: rows.where("value > 50"))
        if not again:
            stages.clear("large")
    return t.spark.createDataFrame(seen, "place int, stage string, state string, rows long")


@query("ex09_tile_processor", "SELECT row_idx, col_idx, round_even(avg(v), 6) AS value FROM (SELECT p.row_idx, p.col_idx, q.value AS v FROM p JOIN p q ON abs(p.row_idx - q.row_idx) <= 1 AND abs(p.col_idx - q.col_idx) <= 1) GROUP BY 1, 2", p=i.PIXEL)
def _(t):
    from quadrille.plans.stages import tiled

    def smoothed(x):
        padded = np.pad(x, 1, constant_values=np.nan)
        around = np.stack([padded[a : a + x.shape[0], b : b + x.shape[1]] for a in range(3) for b in range(3)])
        n = (~np.isnan(around)).sum(axis=0)
        return np.where(np.isnan(x), np.nan, np.nansum(around, axis=0) / np.maximum(n, 1))

    return _r(tiled(t.view(i.PIXEL), 10, 1, smoothed, (64, 64)), "value")


@query("ex10_checkpoints", "SELECT 'kept' AS stage, 1 AS made, count(*) AS rows FROM region UNION ALL SELECT 'damaged', 2, count(*) FROM nation")
def _(t):
    from quadrille.plans.stages import Stages

    folder, made = scratch(t.spark, "checkpoints"), {"kept": 0, "damaged": 0}

    def make(name, df):
        made[name] += 1
        return df

    for _ in range(2):
        stages = Stages(t.spark, folder)
        out = [(n, df.count()) for n, df in (("kept", stages.run("kept", lambda: make("kept", t.region))), ("damaged", stages.run("damaged", lambda: make("damaged", t.nation))))]
        if made["damaged"] == 1:
            t.nation.limit(1).write.mode("overwrite").parquet(f"{folder}/damaged")
    return t.spark.createDataFrame([(n, made[n], rows) for n, rows in out], "stage string, made int, rows long")


@query("ex15_cache_eviction", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', true)) v(key, held)")
def _(t):
    cache = stores.ResultCache(t.spark, scratch(t.spark, "lru"))
    for at, key in enumerate("abc"):
        cache.put(key, t.region, at)
    cache.get("a", 5)  # so b is the one read least recently
    cache.evict(2 * t.region.count(), 6)
    return t.spark.createDataFrame([(key, cache.get(key, 7) is not None) for key in "abc"], "key string, held boolean")
