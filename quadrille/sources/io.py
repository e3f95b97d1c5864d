"""Readers and writers (SRC01-SRC04, SRC09, SNK03-SNK08, SNK12-SNK15). All go through Spark, so any file system works."""

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinate names by priority: fixed values of the reference.
LONGITUDES = ("longitude", "lon", "x", "x_coord", "long")
LATITUDES = ("latitude", "lat", "y", "y_coord")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC04: Parquet, CSV, JSON or ORC by suffix; CSV and JSON want a schema."""
    kind = next((k for k in ("parquet", "csv", "json", "orc") if f".{k}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, inferSchema=schema is None) if kind == "csv" else reader.format(kind).load(path)


def coordinate_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """SRC02: the longitude and latitude columns."""
    names = {c.lower(): c for c in df.columns}
    return next((names[c] for c in LONGITUDES if c in names), None), next((names[c] for c in LATITUDES if c in names), None)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("cell_id", "id")) -> list[str]:
    """SRC01, SRC02: numeric columns but coordinates and ids."""
    skip = {*exclude, *coordinate_columns(df)}
    return [c for c, kind in df.dtypes if c not in skip and (kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"))]


def analysis_scan(df: DataFrame) -> DataFrame:
    """SRC01: coordinates and an array of features, NaN as missing."""
    lon, lat = coordinate_columns(df)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.array(*map(value, feature_columns(df))).alias("features"))


def proportions(df: DataFrame) -> DataFrame:
    """SRC02: share missing and share zero of each feature, in one aggregation."""
    names = feature_columns(df)
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(x for c in names for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|m"), F.count_if(F.col(c) == 0).alias(f"{c}|z"))))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(f"{c}|m") / F.nullif(F.col("n"), F.lit(0))).alias("missing"), (F.col(f"{c}|z") / F.nullif(F.col("n"), F.lit(0))).alias("zero")) for c in names))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def dataset_type(name) -> F.Column:
    """SRC09: the kind of a raster by its file name."""
    n = F.lower(name)
    return F.when(n.contains("plant") | n.contains("daru"), "plants").when(n.contains("vertebrate") | n.contains("iucn"), "vertebrates").when(n.contains("terrestrial"), "terrestrial").when(n.contains("marine"), "marine").otherwise("unknown")


def exploded_pixels(rows: DataFrame, nodata: float | None = None) -> DataFrame:
    """SNK02, SNK03: (row_idx, col_idx, value) of raster rows (row_idx, values), without nodata and NaN."""
    out = rows.select("row_idx", F.posexplode("values").alias("col_idx", "value"))
    kept = out.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.where(F.col("value") != nodata) if nodata is not None else kept


def write_csv(df: DataFrame, path: str, *, gzip: bool = False, null: str = "") -> None:
    """SNK04, SNK06."""
    df.write.mode("overwrite").option("header", True).option("nullValue", null).option("compression", "gzip" if gzip else "none").csv(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), rows_per_file: int = 0, row_group_bytes: int | None = None) -> None:
    """SNK05, SNK07: snappy, bounded files and row groups."""
    w = df.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_chunks(chunks, path: str, kind: str = "csv", **options) -> int:
    """SNK06, SNK07: DataFrames written one after another into one folder; how many there were. If one fails, the whole export goes."""
    n = 0
    try:
        for n, df in enumerate(chunks, 1):
            df.write.mode("overwrite" if n == 1 else "append").option("header", True).options(**options).format(kind).save(path)
            spark = df.sparkSession
    except Exception:
        if n:
            _deleted(df.sparkSession, path)
        raise
    if n:
        _deleted(spark, f"{path}/_SUCCESS")
        spark.range(1).select(F.lit(n).alias("chunks")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.done")
    return n


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_sidecar(df: DataFrame, path: str, extra: Mapping | None = None) -> None:
    """SNK08: one JSON line with the number of rows, columns and types."""
    body = json.dumps({"columns": dict(df.dtypes), **(extra or {})}, sort_keys=True)
    df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(body).alias("metadata")).coalesce(1).write.mode("overwrite").json(path)


def experiment_rows(bands: Mapping[str, DataFrame], *, minx: float, maxy: float, resolution: float, width: int, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """SNK09: cell_id ``cell_<row * width + col>``, x, y of the pixel's centre and a column for each band of pixels (row_idx, col_idx, value), cut to bounds (minx, miny, maxx, maxy), both ends included.

    One union and one aggregation by pixel, however many bands there are.
    """
    rows = None
    for name, df in bands.items():
        one = df.select("row_idx", "col_idx", F.lit(name).alias("band"), "value")
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("row_idx", "col_idx").agg(*(F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in bands))
    cell = F.concat(F.lit("cell_"), (F.col("row_idx") * width + F.col("col_idx")).cast("string"))
    out = wide.select(cell.alias("cell_id"), (minx + (F.col("col_idx") + 0.5) * resolution).alias("x"), (maxy - (F.col("row_idx") + 0.5) * resolution).alias("y"), *bands)
    return out if bounds is None else out.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))


#: SRC11: scale factors of the climate bands, fixed values of the reference.
CLIMATE_SCALES = {"bio01": 0.1, "bio04": 0.01, "bio12": 1.0}


def climate_bands(df: DataFrame) -> DataFrame:
    """SRC11: scaled bands as floats."""
    return df.withColumns({c: (F.col(c) * s).cast("float") for c, s in CLIMATE_SCALES.items() if c in df.columns})


def climate_table(df: DataFrame) -> DataFrame:
    """SNK12: (x, y, bands...): coordinates as doubles, climate bands as floats, all else as it is. Missing coordinate columns are an error."""
    missing = [c for c in ("x", "y") if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    kinds = {"x": "double", "y": "double"} | {c: "float" for c in df.columns if c in CLIMATE_SCALES}
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {kind})") for c, kind in kinds.items()})


def write_climate(df: DataFrame, path: str) -> dict:
    """SNK12: writes ``climate_table(df)`` with a sidecar ``path``.metadata; what it checked. Coordinates outside the globe are an error and nothing is written."""
    out = climate_table(df)
    r = out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r.x0 is not None and (r.x0 < -180 or r.x1 > 180):
        raise ValueError("longitudes outside -180 to 180")
    if r.y0 is not None and (r.y0 < -90 or r.y1 > 90):
        raise ValueError("latitudes outside -90 to 90")
    write_parquet(out, path)
    write_sidecar(out, f"{path.rstrip('/')}.metadata", {"missing_coordinates": r.missing})
    return {"rows": r.rows, "missing": r.missing}


def reservoir(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """PRJ16: n rows, the same each time: the least hashes."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
