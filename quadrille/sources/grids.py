"""Generated coordinates, windows and tiles (SRC06, SRC07, SRC12-SRC14, FN06, FN10)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def coordinate_grid(spark: SparkSession, bounds: tuple[float, float, float, float], resolution: float, chunk_rows: int | None = None) -> DataFrame:
    """SRC12, SRC13: cell origins of a grid, x fastest, without the far ends; with ``chunk_rows`` the number of the chunk."""
    nx, ny = round((bounds[2] - bounds[0]) / resolution), round((bounds[3] - bounds[1]) / resolution)
    row = F.floor(F.col("id") / nx)
    out = spark.range(nx * ny).select((F.lit(bounds[0]) + (F.col("id") % nx) * resolution).alias("x"), (F.lit(bounds[1]) + row * resolution).alias("y"), *([F.floor(row / chunk_rows).cast("int").alias("chunk")] if chunk_rows else []))
    return out


def windows(spark: SparkSession, height: int, width: int, size: int, overlap: int = 0) -> DataFrame:
    """SRC14: row-major windows with a step of size - overlap, cut at the raster's edges."""
    step = size - overlap
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))).alias("row_off"), F.lit(1).alias("one"))
    both = rows.select("row_off", F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step))).alias("col_off"))
    return both.select("row_off", "col_off", F.least(F.lit(size), height - F.col("row_off")).alias("height"), F.least(F.lit(size), width - F.col("col_off")).alias("width"))


def tile_of(pixels: DataFrame, size: int) -> DataFrame:
    """SRC06: the tile of each pixel."""
    return pixels.withColumns({"tile_y": F.floor(F.col("row_idx") / size).cast("int"), "tile_x": F.floor(F.col("col_idx") / size).cast("int")})


def window_of_bounds(bounds: tuple[float, float, float, float], *, minx: float, maxy: float, resolution: float, height: int, width: int) -> tuple[int, int, int, int]:
    """SRC07: (row_off, col_off, rows, columns) by truncating division, held within the raster."""
    col, row = max(0, int((bounds[0] - minx) / resolution)), max(0, int((maxy - bounds[3]) / resolution))
    return row, col, min(height - row, int((bounds[3] - bounds[1]) / resolution)), min(width - col, int((bounds[2] - bounds[0]) / resolution))


def cubic_grid(spark: SparkSession, bounds: tuple[float, float, float, float], size: float, resolution: int) -> DataFrame:
    """FN10, WN03: cells of ``size`` degrees with ids, bounds cut at the far edges, centres and areas."""
    from quadrille.functions.geo import area_km2, cell_id

    nx, ny = int((bounds[2] - bounds[0]) / size), int((bounds[3] - bounds[1]) / size)
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j"))
    cells = cells.withColumns({"minx": F.lit(bounds[0]) + F.col("i") * size, "miny": F.lit(bounds[1]) + F.col("j") * size})
    cells = cells.withColumns({"maxx": F.least(F.col("minx") + size, F.lit(bounds[2])), "maxy": F.least(F.col("miny") + size, F.lit(bounds[3]))})
    return cells.withColumns({"cell_id": cell_id(F.lit(resolution), F.col("i"), F.col("j")), "cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2, "area_km2": area_km2("minx", "miny", "maxx", "maxy")})
