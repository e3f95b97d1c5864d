"""Alignment checks, cached results, greedy neighbourhoods and further metrics."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.basic import round6


def alignment_issues(rasters: DataFrame) -> DataFrame:
    """FN15: for pairs of rasters (name, crs, resolution, minx, miny): critical or warning differences."""
    a, b = (rasters.toDF(*(f"{p}_{c}" for c in rasters.columns)) for p in "ab")
    size = F.abs(F.col("a_resolution") - F.col("b_resolution"))
    steps = (F.col("a_minx") - F.col("b_minx")) / F.col("a_resolution")
    off = F.abs(steps - F.rint(steps))
    issue = F.when(F.col("a_crs") != F.col("b_crs"), "crs").when(size > 1e-3, "resolution").when(F.abs(F.col("a_minx") - F.col("b_minx")) > 1.0, "bounds").when(off > 0.1, "origin").otherwise("none")
    return a.join(b, F.col("a_name") < F.col("b_name")).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), issue.alias("issue"))


def target_shape(boxes: DataFrame, pixel: float) -> DataFrame:
    """FN16: columns and rows of the boxes' intersection, truncated."""
    w, h = F.min("maxx") - F.max("minx"), F.min("maxy") - F.max("miny")
    return boxes.agg((w / pixel).cast("int").alias("width"), (h / pixel).cast("int").alias("height"))


def output_shape(rasters: DataFrame, target: float) -> DataFrame:
    """RE05: ``rasters`` (minx, miny, maxx, maxy, resolution) and the height and width of the result, rounded up, whether it is finer, and the scale."""
    if target <= 0:
        raise ValueError("the target resolution must be positive")
    size = lambda a, b: F.ceil((F.col(b) - F.col(a)) / target).cast("int")
    return rasters.withColumns({"height": size("miny", "maxy"), "width": size("minx", "maxx"), "is_upsampling": F.lit(target) < F.col("resolution"), "scale_factor": F.col("resolution") / target})


def clipped_cells(cells: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """FN12: cells cut to the bounds; the id of a cell that was cut ends in _clipped."""
    x0, y0 = F.greatest("minx", F.lit(bounds[0])), F.greatest("miny", F.lit(bounds[1]))
    x1, y1 = F.least("maxx", F.lit(bounds[2])), F.least("maxy", F.lit(bounds[3]))
    cut = (x0 != F.col("minx")) | (y0 != F.col("miny")) | (x1 != F.col("maxx")) | (y1 != F.col("maxy"))
    return cells.where((x0 < x1) & (y0 < y1)).select(F.when(cut, F.concat("cell_id", F.lit("_clipped"))).otherwise(F.col("cell_id")).alias("cell_id"), x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))


def relative_cutoff(text: str, now: Column) -> Column:
    """PRJ14: ``now`` less '1h', '30m' or '7d'."""
    found = re.fullmatch(r"(\d+)([smhd])", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    seconds = int(found[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]]
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def filtered(df: DataFrame, **equals) -> DataFrame:
    """PRJ09: a conjunction of the filters that are given; None is left out."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def neighbourhood_means(points: DataFrame, degrees: float, least: int = 3) -> DataFrame:
    """AG33: means by bins of ``degrees``, for bins with at least ``least`` points; others stay single.

    The reference merges greedily in row order; bins have no order, so results don't depend on how rows are dealt.
    """
    bins = points.withColumns({"bx": F.floor(F.col("lon") / degrees), "by": F.floor(F.col("lat") / degrees)})
    return bins.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).where(F.col("n") >= least)


def gradient(cells: DataFrame, along: str = "row_idx", at: str = "col_idx") -> DataFrame:
    """WN10, MT03: central differences along each row of a grid (row_idx, col_idx, value), one-sided at its ends."""
    w = Window.partitionBy(along).orderBy(at)
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    v = F.col("value")
    slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - v).when(before.isNotNull(), v - before).otherwise(0.0)
    return cells.withColumn("gradient", slope)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """MT05: 1 - |rank correlation| with mean ranks for ties, from ranks that are counted by bins."""
    from quadrille.operators.splits import ranked

    def ranks(c: str) -> DataFrame:
        first = ranked(df.select(F.col(c).alias("v"), F.monotonically_increasing_id().alias("t")), "v", "t")
        return first.groupBy(F.col("v").alias(f"__{c}")).agg(F.avg("rank").alias(f"rank_{c}"))

    out = df.select(F.col(a).alias(f"__{a}"), F.col(b).alias(f"__{b}")).join(ranks(a), f"__{a}").join(ranks(b), f"__{b}")
    return out.agg((1 - F.abs(F.corr(f"rank_{a}", f"rank_{b}"))).alias("preserved"))


def passthrough(source: Column, target: Column, tolerance: float = 1e-6, strict: bool = False) -> Column:
    """PRJ10, PRJ20: whether a dataset has the target's resolution; the resampler takes the tolerance itself, the loader (``strict``) doesn't."""
    return F.abs(source - target) < tolerance if strict else F.abs(source - target) <= tolerance


def outer_variables(frames: dict[str, DataFrame]) -> DataFrame:
    """JN19: variables (lat, lon, value) side by side, by one union and one aggregation."""
    rows = None
    for name, df in frames.items():
        one = df.select("lat", "lon", F.lit(name).alias("k"), "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("lat", "lon").agg(*(F.max(F.when(F.col("k") == n, F.col("value"))).alias(n) for n in frames))


def species_cells(ranges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """JN15: species boxes (species, s_...) against cells (cell, t_...): area in km2 of a planar degree of 111.32 km, and percent of the cell."""
    from quadrille.operators.resample import bin_join

    area = F.greatest(F.least("s_maxx", "t_maxx") - F.greatest("s_minx", "t_minx"), F.lit(0.0)) * F.greatest(F.least("s_maxy", "t_maxy") - F.greatest("s_miny", "t_miny"), F.lit(0.0))
    cell = (F.col("t_maxx") - F.col("t_minx")) * (F.col("t_maxy") - F.col("t_miny"))
    shared = lambda boxes: boxes.where(area > 0).withColumns({"area_km2": round6(area * 111.32**2), "coverage_percent": round6(area / cell * 100)})
    return bin_join(ranges, cells, size, shared).select("species", "cell", "area_km2", "coverage_percent")


def as_of(events: DataFrame, marks: DataFrame, width: int = 1024) -> DataFrame:
    """JN21: events (at, ...) with ``mark``, that of the last of ``marks`` (at, mark) not after them; NULL if there is none.

    Rows are dealt into buckets of ``width`` units, buckets into groups of ``width``, and only the groups are in one
    order: what a bucket lacks is carried over from the last bucket, or group, that has a mark.
    """
    rest = [c for c in events.columns if c != "at"]
    none = F.lit(None)
    rows = events.select("at", *rest, none.cast(marks.schema["mark"].dataType).alias("mark"), F.lit(True).alias("__asks"))
    rows = rows.unionByName(marks.select("at", *(none.cast(events.schema[c].dataType).alias(c) for c in rest), "mark", F.lit(False).alias("__asks")))
    rows = rows.withColumns({"__b": F.floor(F.col("at") / width), "__g": F.floor(F.col("at") / (width * width))})
    before = lambda by, w: F.last("top", True).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    buckets = rows.groupBy("__g", "__b").agg(F.max_by(F.when(~F.col("__asks"), F.col("mark")), F.when(~F.col("__asks"), F.col("at"))).alias("top"))
    groups = buckets.groupBy("__g").agg(F.max_by("top", F.when(F.col("top").isNotNull(), F.col("__b"))).alias("top"))
    groups = groups.select("__g", before("__g", Window.partitionBy()).alias("__far"))
    buckets = buckets.select("__g", "__b", before("__b", Window.partitionBy("__g")).alias("__near"))
    here = F.last("mark", True).over(Window.partitionBy("__b").orderBy("at", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("__here", here).where("__asks").join(buckets, ["__g", "__b"]).join(groups, "__g")
    return out.select("at", *rest, F.coalesce("__here", "__near", "__far").alias("mark"))


def touched(cache: DataFrame, log: DataFrame) -> DataFrame:
    """MU03: access counts with those of an append-only access log; reading writes nothing."""
    return cache.join(log.groupBy("key").agg(F.count(F.lit(1)).alias("reads"), F.max("ts").alias("last")), "key", "left").withColumn("access_count", F.col("access_count") + F.coalesce("reads", F.lit(0)))
