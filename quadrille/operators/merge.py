"""Pixel projections and merges of datasets on rounded coordinates (PRJ, JN01-JN04, JN16, AC)."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.basic import clip, round6


def with_coordinates(pixels: DataFrame, *, minx: float, maxy: float, resolution: float, origin: str = "center") -> DataFrame:
    """PRJ01: x and y of pixel centres (or corners) from row_idx and col_idx."""
    half = 0.5 if origin == "center" else 0.0
    return pixels.withColumns({"x": F.lit(minx) + (F.col("col_idx") + half) * resolution, "y": F.lit(maxy) - (F.col("row_idx") + half) * resolution})


def backfilled(pixels: DataFrame, *, minx: float, maxy: float, resolution: float) -> DataFrame:
    """PRJ02: both stored coordinates computed anew where either is NULL."""
    missing = F.col("x_coord").isNull() | F.col("y_coord").isNull()
    x, y = F.lit(minx) + (F.col("col_idx") + 0.5) * resolution, F.lit(maxy) - (F.col("row_idx") + 0.5) * resolution
    return pixels.withColumns({"x_coord": F.when(missing, x).otherwise(F.col("x_coord")), "y_coord": F.when(missing, y).otherwise(F.col("y_coord"))})


def nonzero(pixels: DataFrame, value: str = "value") -> DataFrame:
    """PRJ03."""
    return pixels.where(F.col(value).isNotNull() & (F.col(value) != 0))


def within(pixels: DataFrame, bounds: tuple[float, float, float, float], *, minx: float, maxy: float, resolution: float) -> DataFrame:
    """PRJ04: inclusive coordinate bounds, first as index ranges that reach the Parquet scan, widened by one, then exactly."""
    a, b, c, d = bounds
    low_col, high_col = int((a - minx) / resolution - 0.5) - 1, int((c - minx) / resolution - 0.5) + 1
    low_row, high_row = int((maxy - d) / resolution - 0.5) - 1, int((maxy - b) / resolution - 0.5) + 1
    near = pixels.where(F.col("col_idx").between(low_col, high_col) & F.col("row_idx").between(low_row, high_row))
    return with_coordinates(near, minx=minx, maxy=maxy, resolution=resolution).where(F.col("x").between(a, c) & F.col("y").between(b, d))


def shifted(df: DataFrame, dx: float, dy: float) -> DataFrame:
    """PRJ06: an alignment shift, held within the globe."""
    return df.withColumns({"x": clip(F.col("x") + dx, -180.0, 180.0), "y": clip(F.col("y") + dy, -90.0, 90.0)})


def aligned(df: DataFrame, dx: float, dy: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """PRJ07: shift, then half-open bounds in shifted space; zeros stay, NULL values go."""
    a, b, c, d = bounds
    moved = df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    return moved.where((F.col("x") >= a) & (F.col("x") < c) & (F.col("y") >= b) & (F.col("y") < d) & F.col("value").isNotNull())


def relative_chunk(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """PRJ08: pixels of a half-open window, by indices relative to its corner."""
    inside = (F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]) & (F.col("col_idx") >= cols[0]) & (F.col("col_idx") < cols[1])
    return pixels.where(inside).select((F.col("row_idx") - rows[0]).alias("row_idx"), (F.col("col_idx") - cols[0]).alias("col_idx"), "value")


def dense_chunk(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """PRJ08, dense: every cell of the window, NULL where there is no pixel."""
    spark, width = pixels.sparkSession, cols[1] - cols[0]
    cells = spark.range((rows[1] - rows[0]) * width).select((F.col("id") / width).cast("int").alias("row_idx"), (F.col("id") % width).cast("int").alias("col_idx"))
    return cells.join(relative_chunk(pixels, rows, cols), ["row_idx", "col_idx"], "left")


def long_form(datasets: Mapping[str, DataFrame], *, rounded: bool = True) -> DataFrame:
    """(x, y, dataset, value) of all datasets."""
    out = None
    for name, df in datasets.items():
        key = (round6("x"), round6("y")) if rounded else (F.col("x"), F.col("y"))
        one = df.select(key[0].alias("x"), key[1].alias("y"), F.lit(name).alias("dataset"), F.col("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def coordinate_merge(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """JN01: outer merge of datasets (x, y, value) on coordinates rounded to six decimals; one column for each.

    A union and one aggregation by (x, y), so one shuffle whatever the number of datasets; a coordinate that a dataset
    repeats counts with its greatest value. A single dataset isn't rounded. Sort with ``sorted_yx``.
    """
    rows = long_form(datasets, rounded=len(datasets) > 1)
    return rows.groupBy("x", "y").agg(*(F.max(F.when(F.col("dataset") == n, F.col("value"))).alias(n) for n in datasets))


def sorted_yx(df: DataFrame) -> DataFrame:
    """SO01."""
    return df.orderBy("y", "x")


def grid_merge(grid: DataFrame, datasets: Mapping[str, DataFrame]) -> DataFrame:
    """JN02: a coordinate grid with each dataset's value, without coordinates that no dataset has."""
    merged = coordinate_merge({**datasets}) if len(datasets) > 1 else long_form(datasets).groupBy("x", "y").agg(F.max("value").alias(next(iter(datasets))))
    return grid.select(round6("x").alias("x"), round6("y").alias("y")).distinct().join(merged, ["x", "y"]).dropna(how="all", subset=list(datasets))


def chunk_number(y: Column, top: float, resolution: float, rows: int) -> Column:
    """JN03: the y-slice of ``rows`` grid rows that a coordinate belongs to, from the top."""
    return F.floor((F.lit(top) - y) / (resolution * rows)).cast("int")


def overlap_percent(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """JN04: for each pair of datasets 100 * shared / least number of distinct rounded coordinates, and a warning below 10."""
    names = list(datasets)
    have = long_form(datasets).groupBy("x", "y").agg(*(F.max((F.col("dataset") == n).cast("int")).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = have.agg(*(F.sum(n).alias(n) for n in names), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("dataset_a"), F.lit(b).alias("dataset_b"), F.col(f"{a}|{b}").alias("shared"), F.least(a, b).alias("smaller")) for a, b in pairs))
    out = sums.select(F.explode(rows).alias("r")).select("r.*")
    share = F.coalesce(F.try_divide(F.col("shared") * 100.0, F.col("smaller")), F.lit(0.0))
    return out.select("dataset_a", "dataset_b", "shared", share.alias("overlap_percent"), (share < 10).alias("low_overlap"))


def snapped(targets: DataFrame, pixels: DataFrame, *, minx: float, maxy: float, resolution: float) -> DataFrame:
    """JN16, SRC08: the value of the pixel that holds each target point (x, y); NULL outside or without data."""
    index = targets.withColumns({"col_idx": F.floor((F.col("x") - minx) / resolution).cast("int"), "row_idx": F.floor((F.lit(maxy) - F.col("y")) / resolution).cast("int")})
    return index.join(pixels.select("row_idx", "col_idx", "value"), ["row_idx", "col_idx"], "left")


def dense_grid(df: DataFrame, value: str = "value") -> DataFrame:
    """AC02: each combination of the distinct x and the distinct y, NULL where there is no row."""
    return df.select("x").distinct().join(df.select("y").distinct(), F.lit(True)).join(df.select("x", "y", value), ["x", "y"], "left")


def rasterised(points: DataFrame, *, minx: float, maxy: float, resolution: float, order: str) -> DataFrame:
    """AC01: the nearest cell of each point; of several points the last by ``order`` stays."""
    cell = points.withColumns({"col_idx": F.rint((F.col("x") - minx) / resolution).cast("int"), "row_idx": F.rint((F.lit(maxy) - F.col("y")) / resolution).cast("int")})
    return cell.groupBy("row_idx", "col_idx").agg(F.max_by("value", order).alias("value"))
