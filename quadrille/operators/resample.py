"""Resampling of pixel tables (AG21-AG32, AG36, AG39, RE01-RE07, JN13, JN14).

Sources are (row_idx, col_idx, value); a target cell is a group of source indices, so each method is one aggregation.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.quantiles import quantiles


def data_value(nodata: float | None, value: str = "value") -> Column:
    """The value, NULL where it is nodata or NaN."""
    v = F.col(value)
    return F.when((v != nodata) & ~F.isnan(v), v) if nodata is not None else F.when(~F.isnan(v), v)


def _median(v):
    return F.median(v)


#: AG39: every aggregation by name; first and last are by row-major order.
AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "median": _median,
    "mode": lambda v: F.mode(v, True),
    "std": F.stddev_pop,
    "var": F.var_pop,
    "first": lambda v: F.min_by(v, F.when(v.isNotNull(), F.struct("row_idx", "col_idx"))),
    "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct("row_idx", "col_idx"))),
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
}


def block_aggregate(pixels: DataFrame, k: int, height: int, width: int, method: str = "mean", nodata: float | None = None) -> DataFrame:
    """AG21, AG22, AG29: k x k blocks; rows and columns of an incomplete last block are left out."""
    kept = pixels.where((F.col("row_idx") < height // k * k) & (F.col("col_idx") < width // k * k))
    return kept.groupBy(F.floor(F.col("row_idx") / k).cast("int").alias("target_row"), F.floor(F.col("col_idx") / k).cast("int").alias("target_col")).agg(AGGREGATES.get(method, F.avg)(data_value(nodata)).alias("value"))


def block_starts(n_source: int, n_target: int) -> list[tuple[int, int]]:
    """AG24: start and end of each target's sources."""
    factor = n_source / n_target
    return [(int(i * factor), int((i + 1) * factor)) for i in range(n_target)]


def _bucket(index: str, n_source: int, n_target: int) -> Column:
    """The target of a source index: the largest i with int(i * factor) <= index; NULL past the last end."""
    factor = n_source / n_target
    near = F.floor((F.col(index) + 1) / factor)
    guess = F.when((near * factor).cast("int") <= F.col(index), near).otherwise(near - 1)
    return F.when(guess < n_target, guess.cast("int"))


def block_sum(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], nodata: float | None = None) -> DataFrame:
    """AG23, AG24: sums with nodata as 0. A block without data is 0 at a factor of two, else nodata (0 if there is none)."""
    v = data_value(nodata)
    out = pixels.select(_bucket("row_idx", source[0], target[0]).alias("target_row"), _bucket("col_idx", source[1], target[1]).alias("target_col"), v.alias("v")).where("target_row IS NOT NULL AND target_col IS NOT NULL")
    empty = 0.0 if nodata is None or abs(source[0] / target[0] - 2) < 0.1 else nodata
    return out.groupBy("target_row", "target_col").agg(F.coalesce(F.sum("v"), F.lit(empty)).alias("value"))


def overlaps(start: Column, size: float, target: float) -> Column:
    """JN13: (index, share) of the targets of length ``target`` that the source [start, start + size) overlaps on one axis."""
    end = start + size
    indices = F.sequence(F.floor(start / target), F.greatest(F.floor(start / target), F.ceil(end / target) - 1))
    return F.transform(indices, lambda k: F.struct(k.cast("int").alias("i"), ((F.least(end, (k + 1) * target) - F.greatest(start, k * target)) / size).alias("w")))


def area_mapping(pixels: DataFrame, ratio: float) -> DataFrame:
    """JN13: source pixels with their target cells of ``ratio`` source pixels, and the share of the source's area there."""
    one = lambda c: overlaps(F.col(c).cast("double"), 1.0, ratio)
    out = pixels.withColumn("r", F.explode(one("row_idx"))).withColumn("c", F.explode(one("col_idx")))
    return out.select("row_idx", "col_idx", "value", F.col("r.i").alias("target_row"), F.col("c.i").alias("target_col"), (F.col("r.w") * F.col("c.w")).alias("weight"))


def weighted_mean(mapping: DataFrame, nodata: float | None = None, empty: float | None = None) -> DataFrame:
    """AG25 (empty targets are nodata), AG26 (with ``empty`` 0)."""
    v = data_value(nodata)
    mean = F.sum(v * F.col("weight")) / F.nullif(F.sum(F.when(v.isNotNull(), F.col("weight"))), F.lit(0.0))
    fill = empty if empty is not None else nodata
    return mapping.groupBy("target_row", "target_col").agg((F.coalesce(mean, F.lit(fill)) if fill is not None else mean).alias("value"))


def majority(mapping: DataFrame, nodata: float | None = None) -> DataFrame:
    """AG27: the class with the largest weight; ties go to the class that comes first in row-major order. Nodata has no vote."""
    votes = mapping.withColumn("v", data_value(nodata)).groupBy("target_row", "target_col", "v").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("weight"))).alias("w"), F.min(F.struct("row_idx", "col_idx")).alias("at"))
    # Weights are compared at 1e-9, so that equal sums in another order tie.
    order = F.struct(F.round("w", 9).alias("w"), (-F.col("at.row_idx")).alias("r"), (-F.col("at.col_idx")).alias("c"))
    best = F.max_by("v", F.when(F.col("v").isNotNull(), order))
    return votes.groupBy("target_row", "target_col").agg((best if nodata is None else F.coalesce(best, F.lit(nodata))).alias("value"))


def redistributed(mapping: DataFrame) -> DataFrame:
    """AG28: each source's value, split over its targets by weight, so that the total stays."""
    total = mapping.groupBy("row_idx", "col_idx").agg(F.sum("weight").alias("all"))
    return mapping.join(total, ["row_idx", "col_idx"]).groupBy("target_row", "target_col").agg(F.sum(F.col("value") * F.col("weight") / F.col("all")).alias("value"))


def coarse_store(pixels: DataFrame, kind: str, resolution: float, *, minx: float, maxy: float) -> DataFrame:
    """AG30: sums for richness, else means, in cells of ``resolution``, with centre coordinates."""
    how = F.sum if kind == "richness" else F.avg
    out = pixels.groupBy(F.floor((F.col("x") - minx) / resolution).alias("c"), F.floor((F.lit(maxy) - F.col("y")) / resolution).alias("r")).agg(how("value").alias("value"))
    return out.select((F.lit(minx) + (F.col("c") + 0.5) * resolution).alias("x"), (F.lit(maxy) - (F.col("r") + 0.5) * resolution).alias("y"), "value")


def coverage(pixels: DataFrame, k: int, nodata: float | None = None) -> DataFrame:
    """AG31: percent of a target's sources that have data."""
    return pixels.groupBy(F.floor(F.col("row_idx") / k).cast("int").alias("target_row"), F.floor(F.col("col_idx") / k).cast("int").alias("target_col")).agg((F.avg(data_value(nodata).isNotNull().cast("int")) * 100).alias("coverage"))


def zoom_nearest(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """RE02: corner-aligned nearest resampling, i * (n - 1) / (m - 1)."""
    spark = pixels.sparkSession
    cells = spark.range(target[0] * target[1]).select((F.col("id") / target[1]).cast("int").alias("target_row"), (F.col("id") % target[1]).cast("int").alias("target_col"))
    at = lambda c, n, m: F.floor(F.col(c) * ((n - 1) / max(1, m - 1)) + 0.5).cast("int")
    cells = cells.withColumns({"row_idx": at("target_row", source[0], target[0]), "col_idx": at("target_col", source[1], target[1])})
    return cells.join(pixels.select("row_idx", "col_idx", "value"), ["row_idx", "col_idx"], "left").select("target_row", "target_col", "value")


def zoom_bilinear(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """RE02, AG26 upsampling: corner-aligned bilinear; weights of missing corners are shared out, below 0.01 it is NULL."""
    spark = pixels.sparkSession
    cells = spark.range(target[0] * target[1]).select((F.col("id") / target[1]).cast("int").alias("target_row"), (F.col("id") % target[1]).cast("int").alias("target_col"))
    y, x = (F.col(c) * ((n - 1) / max(1, m - 1)) for c, n, m in (("target_row", source[0], target[0]), ("target_col", source[1], target[1])))
    corners = F.array(*(F.struct((F.floor(y) + a).cast("int").alias("row_idx"), (F.floor(x) + b).cast("int").alias("col_idx"), ((y - F.floor(y) if a else 1 - (y - F.floor(y))) * (x - F.floor(x) if b else 1 - (x - F.floor(x)))).alias("weight")) for a in (0, 1) for b in (0, 1)))
    joined = cells.withColumn("k", F.explode(corners)).select("target_row", "target_col", "k.*").where("weight > 0").join(pixels.select("row_idx", "col_idx", "value"), ["row_idx", "col_idx"], "left")
    held = F.sum(F.when(F.col("value").isNotNull(), F.col("weight")))
    return joined.groupBy("target_row", "target_col").agg(F.when(held > 0.01, F.sum(F.col("value") * F.col("weight")) / held).alias("value"))


def output_shape(bounds: tuple[float, float, float, float], resolution: float) -> tuple[int, int]:
    """RE05."""
    return math.ceil((bounds[3] - bounds[1]) / resolution), math.ceil((bounds[2] - bounds[0]) / resolution)


def _kernel(t: Column, method: str) -> Column:
    """AG29: the weight at a distance of ``t`` target pixels (source pixels where the target is finer)."""
    x = F.abs(t)
    if method == "cubic":
        return F.when(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1).when(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2).otherwise(0.0)
    if method == "cubicspline":
        return F.when(x < 1, (4 - 6 * x**2 + 3 * x**3) / 6).when(x < 2, (2 - x) ** 3 / 6).otherwise(0.0)
    if method == "lanczos":
        return F.when(x < 1e-9, 1.0).when(x < 3, 3 * F.sin(math.pi * x) * F.sin(math.pi * x / 3) / (math.pi * x) ** 2).otherwise(0.0)
    raise ValueError(f"no kernel {method!r}")


def warped(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], method: str = "cubic") -> DataFrame:
    """AG29: (target_row, target_col, value) by a cubic, cubic B-spline or Lanczos (three lobes) kernel over pixel centres.

    Where the target is coarser the kernel is as many times wider. Pixels that are missing or outside take no part, and
    the weights of the others are shared out; NULL where they come to nothing.
    """
    lobes = 3 if method == "lanczos" else 2
    out = pixels.where(F.col("value").isNotNull() & ~F.isnan("value")).select("row_idx", "col_idx", "value")
    for c, n, m in (("row", source[0], target[0]), ("col", source[1], target[1])):
        ratio = n / m
        wide = max(ratio, 1.0)
        centre = F.col(f"{c}_idx") + 0.5
        first, last = F.ceil((centre - lobes * wide) / ratio - 0.5), F.floor((centre + lobes * wide) / ratio - 0.5)
        places = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(m - 1)).cast("int"))
        out = out.withColumn(f"target_{c}", F.explode(places)).withColumn(f"__{c}", _kernel((centre - (F.col(f"target_{c}") + 0.5) * ratio) / wide, method))
    w = F.col("__row") * F.col("__col")
    return out.where(w != 0).groupBy("target_row", "target_col").agg((F.sum(w * F.col("value")) / F.when(F.abs(F.sum(w)) > 1e-9, F.sum(w))).alias("value"))


#: RE06: fixed values of the reference: scales (target over source) at which a method is suitable, how well it interpolates, and confidence by scale.
SUITABLE = {"nearest": (0.0, math.inf), "bilinear": (0.1, math.inf), "bicubic": (0.1, math.inf), "lanczos": (0.5, math.inf), "average": (0.0, 1.0), "mode": (0.0, 1.0)}
ACCURACY = {"nearest": 0.6, "bilinear": 0.8, "bicubic": 0.9}
SPATIAL = ((0.8, 1.2, 1.0), (0.5, 2.0, 0.8), (0.1, 5.0, 0.6))
CASTS = {"same": 1.0, "safe": 0.9, "unsafe": 0.7}


def method_report(requests: DataFrame) -> DataFrame:
    """RE06: requests (scale_y, scale_x, method, categorical, cast) with whether the method suits, the one to take instead, confidence, loss and risk of aliasing.

    A method suits where both scales are above its least (any, for the least 0) and up to its greatest one; methods
    without limits always do.
    """
    both = lambda f: f(F.col("scale_y")) & f(F.col("scale_x"))
    suits, accuracy = F.lit(True), F.lit(0.7)
    for name, (low, high) in SUITABLE.items():
        fits = both(lambda s, low=low, high=high: (s > low if low else F.lit(True)) & (s <= high if high < math.inf else F.lit(True)))
        suits = F.when(F.col("method") == name, fits).otherwise(suits)
    for name, value in ACCURACY.items():
        accuracy = F.when(F.col("method") == name, value).otherwise(accuracy)
    scale = (F.col("scale_x") + F.col("scale_y")) / 2
    spatial, data = F.lit(0.3), F.lit(0.7)
    for low, high, value in reversed(SPATIAL):
        spatial = F.when(scale.between(low, high), value).otherwise(spatial)
    for name, value in CASTS.items():
        data = F.when(F.col("cast") == name, value).otherwise(data)
    best = F.when(F.col("categorical"), "nearest").when(scale > 2, "bicubic").when(scale < 0.5, "average").otherwise("bilinear")
    risk = F.when((scale < 0.5) & ~F.col("method").isin("average", "mode"), 0.7).otherwise(0.1)
    return requests.withColumns({"suitable": suits, "recommended": best, "confidence": F.cbrt(spatial * data * F.when(suits, 1.0).otherwise(0.6)), "information_loss": F.when(scale < 1, 1 - scale).otherwise(0.1), "aliasing_risk": risk, "accuracy": accuracy})


def strategy_for(kind: str) -> str:
    """RE07."""
    return {"richness": "sum", "continuous": "average", "categorical": "majority"}.get(kind, "nearest")


def resample(pixels: DataFrame, method: str, ratio: float, source: tuple[int, int], nodata: float | None = None) -> DataFrame:
    """RE01: any method by name, from ``source`` rows and columns to cells of ``ratio`` pixels."""
    target = math.ceil(source[0] / ratio), math.ceil(source[1] / ratio)
    if method == "area_weighted":
        return weighted_mean(area_mapping(pixels, ratio), nodata)
    if method == "average":
        return weighted_mean(area_mapping(pixels, ratio), nodata, 0.0)
    if method == "sum":
        return block_sum(pixels, source, target, nodata)
    if method == "sum_legacy":
        return redistributed(area_mapping(pixels, ratio))
    if method == "majority":
        return majority(area_mapping(pixels, ratio), nodata)
    if method in ("nearest", "bilinear"):
        return (zoom_nearest if method == "nearest" else zoom_bilinear)(pixels, source, target)
    return block_aggregate(pixels, max(1, int(ratio)), *source, method, nodata)


def resample_chunks(pixels: DataFrame, method: str, ratio: int, source: tuple[int, int], rows: int) -> DataFrame:
    """RE03: ``resample`` of bands of ``rows`` source rows, a multiple of ``ratio``, each by itself and put back in its place: the same cells as of the whole."""
    if rows % ratio:
        raise ValueError("a band must be whole target rows")
    out = None
    for first in range(0, source[0], rows):
        height = min(rows, source[0] - first)
        band = pixels.where((F.col("row_idx") >= first) & (F.col("row_idx") < first + height)).withColumn("row_idx", (F.col("row_idx") - first).cast("int"))
        one = resample(band, method, ratio, (height, source[1])).withColumn("target_row", (F.col("target_row") + first // ratio).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


def percentile_profile(df: DataFrame, value: str = "value") -> DataFrame:
    """AG36: exact linear percentiles."""
    marks = (1, 5, 25, 50, 75, 95, 99)
    found = quantiles(df, value, [p / 100 for p in marks]) or [None] * len(marks)
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"p{m} double" for m in marks))


def overlap_upscale(source: DataFrame, target: DataFrame, size: float, method: str = "mean") -> DataFrame:
    """AG32, JN14, JN15: source boxes (s_minx...) against target boxes (t_minx...) by bins of ``size`` degrees; weight is the share of the source's area."""
    pairs = bin_join(source, target, size)
    w = F.greatest(F.least("s_maxx", "t_maxx") - F.greatest("s_minx", "t_minx"), F.lit(0.0)) * F.greatest(F.least("s_maxy", "t_maxy") - F.greatest("s_miny", "t_miny"), F.lit(0.0)) / ((F.col("s_maxx") - F.col("s_minx")) * (F.col("s_maxy") - F.col("s_miny")))
    pairs = pairs.withColumn("w", w).where("w > 0")
    how = {"sum": F.sum(F.col("value") * F.col("w")), "max": F.max("value"), "min": F.min("value")}.get(method, F.sum(F.col("value") * F.col("w")) / F.sum("w"))
    return pairs.groupBy("target").agg(how.alias("value"), F.count(F.lit(1)).alias("sources"))


def _touching(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that touch, by an equi-join on bins of ``size``; each pair once, in the bin of its first corner."""
    bins = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}minx") / size), F.floor(F.col(f"{p}maxx") / size)))
    rows = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}miny") / size), F.floor(F.col(f"{p}maxy") / size)))
    a = source.withColumn("bx", bins("s_")).withColumn("by", rows("s_"))
    b = target.withColumn("bx", bins("t_")).withColumn("by", rows("t_"))
    near = (F.col("s_minx") <= F.col("t_maxx")) & (F.col("s_maxx") >= F.col("t_minx")) & (F.col("s_miny") <= F.col("t_maxy")) & (F.col("s_maxy") >= F.col("t_miny"))
    first = (F.col("bx") == F.floor(F.greatest("s_minx", "t_minx") / size)) & (F.col("by") == F.floor(F.greatest("s_miny", "t_miny") / size))
    return a.join(b, ["bx", "by"]).where(near & first).drop("bx", "by")


#: Rows of a few dozen bytes that are broadcast: tens of MB.
BROADCAST_ROWS = 500_000


def _bounded(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def bin_join(source: DataFrame, target: DataFrame, size: float, boxes: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """JN12: pairs of boxes that touch. Different boxes are matched in bins of ``size``; rows of one box share its matches.

    ``boxes`` may filter the matches (s_..., t_...) and give them columns. The rows' pairs come from two plain equi-joins,
    dealt by source rows, so that a box of many rows is not one task's.
    """
    corners = {side: [f"{side}_{c}" for c in ("minx", "miny", "maxx", "maxy")] for side in "st"}
    found = boxes(_touching(source.select(*corners["s"]).distinct(), target.select(*corners["t"]).distinct(), size))
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return source.repartition(tasks).join(_bounded(found), corners["s"]).join(_bounded(target), corners["t"])
