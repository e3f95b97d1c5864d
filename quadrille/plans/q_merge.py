"""Queries of scans, projections and merges."""

from pyspark.sql import functions as F

from quadrille.functions.basic import clip_cast, round6
from quadrille.operators import merge as m
from quadrille.plans import inputs as i
from quadrille.plans.registry import query

AT = {"minx": -32.0, "maxy": 32.0, "resolution": 1.0}
_X, _Y = "-32.0 + (col_idx + 0.5)", "32.0 - (row_idx + 0.5)"


def _at(t, text):
    return m.with_coordinates(t.view(text), **AT)


@query("prj01_index_to_coordinates", f"SELECT row_idx, col_idx, {_X} AS x, {_Y} AS y, value FROM p", p=i.PIXEL)
def _(t):
    return _at(t, i.PIXEL)


@query("prj02_backfill", f"SELECT row_idx, col_idx, CASE WHEN row_idx % 3 = 0 OR col_idx % 4 = 0 THEN {_X} ELSE 1.0 END AS x_coord, CASE WHEN row_idx % 3 = 0 OR col_idx % 4 = 0 THEN {_Y} ELSE 2.0 END AS y_coord FROM p", p=i.PIXEL)
def _(t):
    p = t.view(i.PIXEL).select("row_idx", "col_idx", F.when(F.col("row_idx") % 3 != 0, 1.0).alias("x_coord"), F.when(F.col("col_idx") % 4 != 0, 2.0).alias("y_coord"))
    return m.backfilled(p, **AT)


@query("prj03_nonzero", "SELECT * FROM p WHERE value IS NOT NULL AND value <> 0", p=i.PIXEL_N)
def _(t):
    return m.nonzero(t.view(i.PIXEL_N))


@query("prj04_bounded_load", f"SELECT * FROM (SELECT row_idx, col_idx, value, {_X} AS x, {_Y} AS y FROM p) WHERE x BETWEEN -10 AND 12.5 AND y BETWEEN -3.5 AND 20", p=i.PIXEL)
def _(t):
    return m.within(t.view(i.PIXEL), (-10.0, -3.5, 12.5, 20.0), **AT)


@query("prj06_alignment_shift", f"SELECT least(greatest({_X} + 0.25, -180), 180) AS x, least(greatest({_Y} - 0.5, -90), 90) AS y, value FROM p", p=i.PIXEL)
def _(t):
    return m.shifted(_at(t, i.PIXEL), 0.25, -0.5).select("x", "y", "value")


@query("prj07_aligned_coordinates", f"SELECT * FROM (SELECT {_X} + 0.25 AS x, {_Y} - 0.25 AS y, value FROM p) WHERE x >= -5 AND x < 5.75 AND y >= 0 AND y < 9 AND value IS NOT NULL", p=i.PIXEL_N)
def _(t):
    return m.aligned(_at(t, i.PIXEL_N), 0.25, -0.25, (-5.0, 0.0, 5.75, 9.0)).select("x", "y", "value")


@query("prj08_relative_chunk", "SELECT CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col_idx, value FROM range(10) a(r) CROSS JOIN range(12) b(c) LEFT JOIN p ON row_idx - 20 = r AND col_idx - 30 = c", p=i.PIXEL_A)
def _(t):
    return m.dense_chunk(t.view(i.PIXEL_A), (20, 30), (30, 42))


@query("prj17_systematic_sample", "SELECT * FROM p WHERE row_idx % 8 = 0 AND col_idx % 8 = 0", p=i.PIXEL)
def _(t):
    return t.view(i.PIXEL).where((F.col("row_idx") % 8 == 0) & (F.col("col_idx") % 8 == 0))


@query("prj19_clip_cast", "SELECT row_idx, col_idx, CAST(least(greatest(value * 100, -128), 127) AS TINYINT) AS small FROM p", p=i.PIXEL_N)
def _(t):
    return t.view(i.PIXEL_N).select("row_idx", "col_idx", clip_cast(F.col("value") * 100, "tinyint").alias("small"))


@query("src06_tiles", "SELECT row_idx // 20 AS tile_y, col_idx // 20 AS tile_x, count(*) AS n, sum(value) AS total FROM p GROUP BY 1, 2", p=i.PIXEL)
def _(t):
    from quadrille.sources.grids import tile_of

    return tile_of(t.view(i.PIXEL), 20).groupBy("tile_y", "tile_x").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("src08_point_read", f"SELECT id, value FROM (SELECT s_suppkey AS id, CAST(floor(s_suppkey % 70 - 34 + 0.25 + 32) AS INT) AS c, CAST(floor(32 - (s_suppkey % 50 - 20 + 0.75)) AS INT) AS r FROM supplier) LEFT JOIN p ON r = row_idx AND c = col_idx", p=i.PIXEL)
def _(t):
    points = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 70 - 34 + 0.25).alias("x"), (F.col("s_suppkey") % 50 - 20 + 0.75).alias("y"))
    return m.snapped(points, t.view(i.PIXEL), **AT).select("id", "value")


@query("src12_coordinate_grid", "SELECT -10.0 + (g % 40) * 0.5 AS x, 5.0 + (g // 40) * 0.5 AS y, CAST((g // 40) // 4 AS INT) AS chunk FROM range(800) r(g)")
def _(t):
    from quadrille.sources.grids import coordinate_grid

    return coordinate_grid(t.spark, (-10.0, 5.0, 10.0, 15.0), 0.5, chunk_rows=4)


@query("src14_overlapping_windows", "SELECT CAST(r AS INT) AS row_off, CAST(c AS INT) AS col_off, CAST(least(20, 64 - r) AS INT) AS height, CAST(least(20, 64 - c) AS INT) AS width FROM range(0, 64, 16) a(r) CROSS JOIN range(0, 64, 16) b(c)")
def _(t):
    from quadrille.sources.grids import windows

    return windows(t.spark, 64, 64, 20, 4)


_MERGE = f"""SELECT coalesce(a.x, r.x) AS x, coalesce(a.y, r.y) AS y, a.value AS a, r.value AS r FROM (SELECT round_even({_X}, 6) AS x, round_even({_Y}, 6) AS y, value FROM pa WHERE value <> 0) a
FULL JOIN (SELECT round_even({_X}, 6) AS x, round_even({_Y}, 6) AS y, value FROM pr WHERE value <> 0) r ON a.x = r.x AND a.y = r.y"""


@query("jn01_coordinate_merge", _MERGE, pa=i.PIXEL_A, pr=i.PIXEL_R)
def _(t):
    return m.sorted_yx(m.coordinate_merge({"a": m.nonzero(_at(t, i.PIXEL_A)), "r": m.nonzero(_at(t, i.PIXEL_R))}))


@query("flagship_merge_richness", f"SELECT floor(x / 8) AS bin_x, floor(y / 8) AS bin_y, count(*) AS coordinates, count(a) AS with_a, count(r) AS with_r, count(n) AS with_n, sum(coalesce(a, 0) + coalesce(r, 0) + coalesce(n, 0)) AS richness FROM (SELECT coalesce(m.x, o.x) AS x, coalesce(m.y, o.y) AS y, a, r, o.value AS n FROM ({_MERGE}) m FULL JOIN (SELECT {_X} AS x, {_Y} AS y, value FROM pn WHERE value <> 0) o ON m.x = o.x AND m.y = o.y) GROUP BY 1, 2", pa=i.PIXEL_A, pr=i.PIXEL_R, pn=i.PIXEL_N)
def _(t):
    merged = m.coordinate_merge({"a": m.nonzero(_at(t, i.PIXEL_A)), "r": m.nonzero(_at(t, i.PIXEL_R)), "n": m.nonzero(_at(t, i.PIXEL_N))})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return merged.groupBy(F.floor(F.col("x") / 8).cast("double").alias("bin_x"), F.floor(F.col("y") / 8).cast("double").alias("bin_y")).agg(
        F.count(F.lit(1)).alias("coordinates"), F.count("a").alias("with_a"), F.count("r").alias("with_r"), F.count("n").alias("with_n"), F.sum(zero("a") + zero("r") + zero("n")).alias("richness")
    )


@query("jn02_grid_merge", f"SELECT x, y, a.value AS a, r.value AS r FROM (SELECT -32.0 + g % 40 + 0.5 AS x, 12.0 + g // 40 + 0.5 AS y FROM range(800) s(g)) LEFT JOIN (SELECT {_X} AS x, {_Y} AS y, value FROM pa) a USING (x, y) LEFT JOIN (SELECT {_X} AS x, {_Y} AS y, value FROM pr) r USING (x, y) WHERE a.value IS NOT NULL OR r.value IS NOT NULL", pa=i.PIXEL_A, pr=i.PIXEL_R)
def _(t):
    from quadrille.sources.grids import coordinate_grid

    grid = coordinate_grid(t.spark, (-31.5, 12.5, 8.5, 32.5), 1.0)
    return m.grid_merge(grid, {"a": _at(t, i.PIXEL_A), "r": _at(t, i.PIXEL_R)})


@query("jn03_streaming_chunks", f"SELECT CAST(floor((32.0 - ({_Y})) / 10) AS INT) AS chunk, count(*) AS n, sum(value) AS total FROM p GROUP BY 1", p=i.PIXEL)
def _(t):
    return _at(t, i.PIXEL).groupBy(m.chunk_number(F.col("y"), 32.0, 1.0, 10).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("jn04_overlap_percent", "SELECT 'a' AS dataset_a, 'r' AS dataset_b, s AS shared, round_even(100.0 * s / least(na, nr), 6) AS overlap_percent, 100.0 * s / least(na, nr) < 10 AS low_overlap FROM (SELECT (SELECT count(*) FROM pa JOIN pr USING (row_idx, col_idx)) AS s, (SELECT count(*) FROM pa) AS na, (SELECT count(*) FROM pr) AS nr)", pa=i.PIXEL_A, pr=i.PIXEL_R)
def _(t):
    return m.overlap_percent({"a": _at(t, i.PIXEL_A), "r": _at(t, i.PIXEL_R)}).withColumn("overlap_percent", round6("overlap_percent"))


@query("jn16_nearest_alignment", "SELECT row_idx, col_idx, a.value AS a, r.value AS r FROM pa a LEFT JOIN pr r USING (row_idx, col_idx)", pa=i.PIXEL_A, pr=i.PIXEL_R)
def _(t):
    a = _at(t, i.PIXEL_A).select(F.col("x") + 0.2, F.col("y") - 0.2, F.col("value").alias("a")).toDF("x", "y", "a")
    return m.snapped(a, t.view(i.PIXEL_R), **AT).select("row_idx", "col_idx", "a", F.col("value").alias("r"))


@query("ac01_rasterise_last_wins", "SELECT CAST(round_even((90 - lat) / 10, 0) AS INT) AS row_idx, CAST(round_even((lon + 180) / 10, 0) AS INT) AS col_idx, max_by(value, id) AS value FROM p GROUP BY 1, 2", p=i.POINT)
def _(t):
    return m.rasterised(t.view(i.POINT).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "value"), minx=-180.0, maxy=90.0, resolution=10.0, order="id")


@query("ac02_dense_grid", f"SELECT x, y, value FROM (SELECT DISTINCT {_X} AS x FROM p) CROSS JOIN (SELECT DISTINCT {_Y} AS y FROM p) LEFT JOIN (SELECT {_X} AS x, {_Y} AS y, value FROM p) USING (x, y)", p=i.PIXEL_A)
def _(t):
    return m.dense_grid(_at(t, i.PIXEL_A))
