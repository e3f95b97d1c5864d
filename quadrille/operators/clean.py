"""Cleaning, normalisation and validation (CL01-CL09, VA01-VA14, WN04, WN05)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.basic import clip, round6
from quadrille.operators.quantiles import quantiles

#: CL02: fixed values of the reference: least, greatest, and standard deviations of the cap.
CONSTRAINTS = {"plants": (0.0, 20000.0, 4.0), "vertebrates": (0.0, 2000.0, 4.0), "all": (0.0, 25000.0, 5.0)}


def clean_tiles(pixels: DataFrame, kind: str = "all", nodata: float | None = None, tile: int = 16) -> DataFrame:
    """CL01, WN04: by tile: nodata to NULL, negatives to 0, a cap at mean + k std (population, after negatives), then the range."""
    low, high, k = CONSTRAINTS[kind]
    v = F.when(F.col("value") != nodata, F.col("value")) if nodata is not None else F.col("value")
    out = pixels.withColumns({"tile_y": F.floor(F.col("row_idx") / tile).cast("int"), "tile_x": F.floor(F.col("col_idx") / tile).cast("int"), "v": F.when(v < 0, 0.0).otherwise(v), "was_negative": F.coalesce(v < 0, F.lit(False))})
    # Statistics by tile are joined, not windowed: a tile of any size is a partial aggregation.
    stats = out.groupBy("tile_y", "tile_x").agg((F.avg("v") + k * F.stddev_pop("v")).alias("cap"))
    out = out.join(stats, ["tile_y", "tile_x"])
    return out.withColumns({"was_outlier": F.coalesce(F.col("v") > F.col("cap"), F.lit(False)), "clean": F.when(F.col("v").isNotNull(), clip(F.least("v", "cap"), low, high))})


def cleaning_counts(cleaned: DataFrame) -> DataFrame:
    """CL01: how many values each rule changed."""
    return cleaned.groupBy("tile_y", "tile_x").agg(F.count_if("was_negative").alias("negatives"), F.count_if("was_outlier").alias("outliers"), F.count_if(F.col("v").isNull()).alias("nodata"), F.sum("clean").alias("total"))


def normalisation(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """CL03: (offset, scale) by column, on data that isn't missing, in one aggregation."""
    if method == "robust":
        found = {c: quantiles(df, c, [0.25, 0.5, 0.75]) or [0.0, 0.0, 0.0] for c in columns}
        return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in found.items()}
    how = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[method]
    row = df.agg(*(x.alias(f"{c}|{k}") for c in columns for k, x in enumerate(how(F.col(c))))).first()
    return {c: (float(row[f"{c}|0"] or 0.0), float(row[f"{c}|1"] or 0.0) or 1.0) for c in columns}


def normalised(df: DataFrame, params: dict[str, tuple[float, float]], missing: float | None = 0.0) -> DataFrame:
    """CL03 (missing becomes 0), CL07, CL08 (``missing`` None keeps it)."""
    made = {c: (F.col(c) - a) / b for c, (a, b) in params.items()}
    return df.withColumns({c: F.coalesce(x, F.lit(missing)) if missing is not None else x for c, x in made.items()})


def denormalised(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """CL04: the correct inverse for every method (Q7)."""
    return df.withColumns({c: F.col(c) * b + a for c, (a, b) in params.items()})


def scaled_on_zeros(df: DataFrame, columns: list[str], transform=None) -> DataFrame:
    """CL07, CL08: z-scores fitted on data whose missing values count as 0; missing values stay missing."""
    moved = df.withColumns({c: transform(F.col(c)) for c in columns}) if transform else df
    params = normalisation(moved.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}), columns)
    return normalised(moved, params, None)


def handled_missing(df: DataFrame, columns: list[str], strategy: str, share: float = 0.5) -> DataFrame:
    """CL05: keep, drop_samples, drop_features (more than ``share`` missing), mean, median, zero."""
    if strategy == "drop_samples":
        return df.dropna(subset=columns)
    if strategy == "zero":
        return df.fillna(0.0, subset=columns)
    if strategy == "drop_features":
        row = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)).first()
        return df.drop(*(c for c in columns if (row[c] or 0) > share))
    if strategy == "median":
        found = {c: quantiles(df, c, [0.5]) for c in columns}
        return df.fillna({c: q[0] for c, q in found.items() if q})
    if strategy == "mean":
        row = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
        return df.fillna({c: row[c] for c in columns if row[c] is not None})
    return df


def varying(df: DataFrame, columns: list[str], least: float = 1e-10) -> list[str]:
    """CL06: columns whose population variance is above ``least``."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if (row[c] or 0.0) > least]


def global_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """CL09: one mean and standard deviation over all columns' values."""
    n = sum((F.count(c) for c in columns), F.lit(0))
    total, squares = (sum((F.coalesce(F.sum(f(F.col(c))), F.lit(0.0)) for c in columns), F.lit(0.0)) for f in (lambda x: x, lambda x: x * x))
    row = df.agg((total / n).alias("m"), F.sqrt(squares / n - (total / n) * (total / n)).alias("s")).first()
    return df.withColumns({c: (F.col(c) - row.m) / row.s for c in columns})


def table_issues(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """VA03, WN05: (feature, rows, nulls, null_percent, outliers, issues) from two aggregations over the table.

    Outliers have a |z| above 3 with the sample deviation, only with more than ten values.
    """
    first = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}|m"), F.stddev_samp(c).alias(f"{c}|s"), F.count(c).alias(f"{c}|n")))).first()
    parts = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        usable = first[f"{c}|n"] > 10 and first[f"{c}|s"]
        z = F.abs((F.col(c) - first[f"{c}|m"]) / first[f"{c}|s"]) > 3 if usable else F.lit(False)
        low, high = (ranges or {}).get(c, (None, None))
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.count_if(z).alias(f"{c}|outliers"), (F.count_if((F.col(c) < low) | (F.col(c) > high)) if low is not None else F.lit(0).cast("long")).alias(f"{c}|outside")]
    sums = df.agg(*parts)
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), "rows", F.col(f"{c}|nulls").alias("nulls"), F.col(f"{c}|outliers").alias("outliers"), F.col(f"{c}|outside").alias("outside")) for c in columns))
    out = sums.select(F.explode(rows).alias("r")).select("r.*")
    share = lambda x: F.coalesce(F.try_divide(F.col(x) * 100.0, F.col("rows")), F.lit(0.0))
    issues = F.array_compact(F.array(F.when(share("nulls") > 10, "nulls"), F.when(share("outliers") > 1, "outliers"), F.when(F.col("outside") > 0, "range")))
    return out.select("feature", "rows", "nulls", round6(share("nulls")).alias("null_percent"), "outliers", "outside", F.array_join(issues, ",").alias("issues"))


def bounds_issues(minx: Column, miny: Column, maxx: Column, maxy: Column, tolerance: float = 1e-6) -> Column:
    """VA01: comma-joined problems of a box; empty if there is none."""
    return F.array_join(F.array_compact(F.array(F.when(minx >= maxx, "x order"), F.when(miny >= maxy, "y order"), F.when((minx < -180 - tolerance) | (maxx > 180 + tolerance), "longitude"), F.when((miny < -90 - tolerance) | (maxy > 90 + tolerance), "latitude"))), ",")


def anomalies(df: DataFrame, value: str = "value") -> DataFrame:
    """VA05: uniform, discrete, and values outside 1.5 IQR of the quartiles."""
    v = F.col(value)
    q = quantiles(df, value, [0.25, 0.75]) or [0.0, 0.0]
    low, high = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
    return df.agg(F.count(v).alias("count"), F.count_if((v < low) | (v > high)).alias("tukey_outliers"), (F.countDistinct(v) <= 1).alias("uniform"), F.coalesce(F.max(F.abs(v - F.rint(v))) == 0, F.lit(False)).alias("discrete"), F.coalesce(F.stddev_pop(v) > 2 * F.avg(v), F.lit(False)).alias("spread"))


def missing_profile(df: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """VA08: share missing of each feature, and whether it is above 0.7."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing"), F.col("n").alias("rows")) for c in columns))
    return sums.select(F.explode(rows).alias("r")).select("r.*", round6(F.try_divide(F.col("r.missing") * 1.0, F.col("r.rows"))).alias("share")).withColumn("problematic", F.col("share") > 0.7)


def quality_checks(df: DataFrame, columns: list[str], largest_missing: float = 0.1) -> DataFrame:
    """VA09: (check, value, passed)."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("missing"))
    share = F.coalesce(F.try_divide(F.col("missing") * 1.0, F.col("rows") * len(columns)), F.lit(0.0))
    rows = F.array(F.struct(F.lit("rows").alias("check"), F.col("rows").cast("double").alias("value"), (F.col("rows") > 0).alias("passed")), F.struct(F.lit("missing").alias("check"), round6(share).alias("value"), (share <= largest_missing).alias("passed")))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def rollup(issues: DataFrame) -> DataFrame:
    """VA11: issues by stage and severity."""
    return issues.groupBy("stage").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "view").alias("warnings"))


def profile(df: DataFrame, columns: list[str], key: tuple[str, str] = ("x", "y")) -> DataFrame:
    """VA13: nulls and range of each column, and how many rows share their key with another."""
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *(x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))))
    return sums.crossJoin(repeated)


def migration_complete(pixels: DataFrame) -> DataFrame:
    """VA14: whether all rows with a value have both coordinates."""
    out = pixels.where("value IS NOT NULL AND value <> 0").agg(F.count(F.lit(1)).alias("rows"), F.count("x_coord").alias("with_x"), F.count("y_coord").alias("with_y"))
    return out.withColumn("complete", (F.col("rows") == F.col("with_x")) & (F.col("rows") == F.col("with_y")))


def coverage_check(boxes: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """VA06: each box's share of a target box, and whether it is at least 0.99."""
    w, h = F.least("maxx", F.lit(maxx)) - F.greatest("minx", F.lit(minx)), F.least("maxy", F.lit(maxy)) - F.greatest("miny", F.lit(miny))
    share = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / ((maxx - minx) * (maxy - miny))
    return boxes.withColumn("share", round6(share)).withColumn("covers", share >= 0.99)


def by_row_window(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """WN07: first and second differences."""
    w = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("d1", F.col(value) - F.lag(value).over(w))
    return out.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
