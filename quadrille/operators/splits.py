"""Deterministic splits and folds (SP01-SP10, WN08, WN09). Random orders are hash orders."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.geo import KM_PER_DEGREE
from quadrille.operators.quantiles import quantiles


def hash_order(column: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(column), F.lit(seed))


def km_blocks(points: DataFrame, km: float) -> DataFrame:
    """SP01: block = latitude slot * longitude slots + longitude slot."""
    size = km / KM_PER_DEGREE
    slots = int(360 / size) + 1
    return points.withColumn("block", F.floor((F.col("lat") + 90) / size) * slots + F.floor((F.col("lon") + 180) / size))


def block_folds(points: DataFrame, km: float, k: int, seed: int = 42) -> DataFrame:
    """SP01: blocks in hash order, cut into k runs; the last run takes the rest. Ranks are over blocks, not rows."""
    return _runs(km_blocks(points, km), k, seed, 1)


def _runs(blocks: DataFrame, k: int, seed: int, least: int) -> DataFrame:
    """``blocks`` and ``fold``: distinct blocks in hash order, cut into k runs of at least ``least``; the last takes the rest."""
    distinct = blocks.select("block").distinct()
    size = max(distinct.count() // k, least)
    placed = ranked(distinct.withColumn("h", hash_order("block", seed)), "h", "block")
    fold = F.least(F.floor(F.col("rank") / size), F.lit(k - 1)) if size else F.lit(k - 1)
    return blocks.join(placed.select("block", fold.cast("int").alias("fold")), "block")


def lattice_blocks(points: DataFrame, k: int) -> DataFrame:
    """SP06: ``points`` and ``block`` of a lattice of ceil(sqrt(k)) by ceil(sqrt(k)) half-open blocks over their box; the greatest longitude and latitude are in no block and so in block 0."""
    n = math.ceil(math.sqrt(k))
    box = points.agg(F.min("lon").alias("__x0"), F.max("lon").alias("__x1"), F.min("lat").alias("__y0"), F.max("lat").alias("__y1"))
    slot = lambda c, a, b: F.floor(F.try_divide((F.col(c) - F.col(a)) * n, F.col(b) - F.col(a)))
    inside = (F.col("lon") < F.col("__x1")) & (F.col("lat") < F.col("__y1"))
    block = F.when(inside, slot("lon", "__x0", "__x1") * n + slot("lat", "__y0", "__y1")).otherwise(0)
    return points.crossJoin(F.broadcast(box)).withColumn("block", F.coalesce(block, F.lit(0)).cast("int")).drop("__x0", "__x1", "__y0", "__y1")


def lattice_folds(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """SP06: ``lattice_blocks`` and ``fold``: occupied blocks in hash order, cut into k runs; with fewer blocks than folds the last fold has all."""
    return _runs(lattice_blocks(points, k), k, seed, 0)


def fold_split(folds: DataFrame, fold: int, buffer: float | None = None) -> tuple[DataFrame, DataFrame]:
    """SP06: (train, test) of a fold; with ``buffer``, training points within that planar distance of a test point go.

    Points meet test points by an equi-join on cells of the buffer's size.
    """
    test, train = folds.where(F.col("fold") == fold), folds.where(F.col("fold") != fold)
    if not buffer:
        return train, test
    cell = lambda c: F.floor(F.col(c) / buffer)
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = train.select("id", "lon", "lat").withColumn("__cx", near("lon")).withColumn("__cy", near("lat"))
    b = test.select(F.col("lon").alias("__x"), F.col("lat").alias("__y"), cell("lon").alias("__cx"), cell("lat").alias("__cy"))
    close = a.join(b, ["__cx", "__cy"]).where(F.sqrt((F.col("lon") - F.col("__x")) ** 2 + (F.col("lat") - F.col("__y")) ** 2) <= buffer)
    return train.join(close.select("id").distinct(), "id", "left_anti"), test


def checkerboard(points: DataFrame, bounds: tuple[float, float, float, float], blocks: int, k: int) -> DataFrame:
    """SP02: fold (i + j) % 2 for two folds, else (2 i + j) % k, of a lattice over the bounds."""
    slot = lambda c, a, b: F.least(F.greatest(F.floor((F.col(c) - a) / ((b - a) / blocks)), F.lit(0)), F.lit(blocks - 1))
    i, j = slot("lat", bounds[1], bounds[3]), slot("lon", bounds[0], bounds[2])
    return points.withColumn("fold", ((i + j) % 2 if k == 2 else (2 * i + j) % k).cast("int"))


def fold_statistics(folds: DataFrame) -> DataFrame:
    """SP03."""
    total = folds.agg(F.count(F.lit(1)).alias("n"))
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("samples")).crossJoin(total).select("fold", "samples", (F.col("samples") * 100.0 / F.col("n")).alias("percent"))


def quantile_bands(df: DataFrame, column: str, bands: int) -> DataFrame:
    """SP05, WN09: the band of each row between exact percentiles; values at a limit are in the upper band."""
    limits = quantiles(df, column, [q / bands for q in range(1, bands)]) or []
    return df.withColumn("fold", sum(((F.col(column) >= q).cast("int") for q in limits), F.lit(0)))


def exact_split(df: DataFrame, column: str, train: float, validation: float, seed: int = 42) -> DataFrame:
    """SP08: exact sizes in hash order. Cuts are found from counts of hash ranges, so no task ranks all rows."""
    h = hash_order(column, seed)
    n = df.count()
    cuts = [int(n * train), int(n * train) + int(n * validation)]
    bins = 4096
    slot = F.floor((h / 2.0**64 + 0.5) * bins)
    keyed = df.withColumns({"__h": h, "__b": slot})
    counts = {r[0]: r[1] for r in keyed.groupBy("__b").count().collect()}
    before, run = {}, 0
    for b in sorted(counts):
        before[b], run = run, run + counts[b]
    at = F.row_number().over(Window.partitionBy("__b").orderBy("__h", column)) - 1
    # Only the range that a cut falls into needs an order within it; its rows before the cut are on the cut's left.
    held = {next((b for b in sorted(before, reverse=True) if before[b] <= cut), 0): None for cut in cuts}
    offset = F.lit(0)
    for b in held:
        offset = F.when(F.col("__b") == b, before.get(b, 0)).otherwise(offset)
    place = at + offset
    ordered = F.when(place < cuts[0], "train").when(place < cuts[1], "validation").otherwise("test")
    whole = lambda cut: [b for b in before if before[b] + counts[b] <= cut]
    last = [max(whole(cut), default=-1) for cut in cuts]
    plain = F.when(F.col("__b") <= last[0], "train").when(F.col("__b") <= last[1], "validation").otherwise("test")
    cut_rows = keyed.where(F.col("__b").isin(*held)).withColumn("split", ordered)
    return cut_rows.unionByName(keyed.where(~F.col("__b").isin(*held)).withColumn("split", plain)).drop("__h", "__b")


def ranked(df: DataFrame, order: str, tie: str, bins: int = 512) -> DataFrame:
    """``df`` and ``rank``, its place from 0 by (order, tie).

    Rows are dealt into bins between approximate quantiles; ranks are counted within a bin and moved on by the sizes of
    the bins before, so no task sorts all rows. Only the bins' limits and sizes reach the driver.
    """
    limits = df.agg(F.percentile_approx(order, F.array(*(F.lit(q / bins) for q in range(1, bins))), 10 * bins).alias("q")).first().q or []
    limits = sorted(set(limits))
    # A value that is a limit has a bin of its own.
    at = F.lit(0) if not limits else F.size(F.filter(F.array(*map(F.lit, limits)), lambda q: q < F.col(order))) * 2 + F.array_contains(F.array(*map(F.lit, limits)), F.col(order)).cast("int")
    keyed = df.withColumn("__bin", at)
    sizes = {r[0]: r[1] for r in keyed.groupBy("__bin").count().collect()}
    before, total = [], 0
    for b in sorted(sizes):
        before += [b, total]
        total += sizes[b]
    offset = F.element_at(F.create_map(*map(F.lit, before)), F.col("__bin")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__bin").orderBy(order, tie)) - 1
    return keyed.withColumn("rank", (within + offset).cast("long")).drop("__bin")


def latitudinal_split(points: DataFrame, train: float, validation: float) -> DataFrame:
    """SP07, WN08: by rank of (lat, id), truncated cuts."""
    n = points.count()
    out = ranked(points, "lat", "id")
    return out.withColumn("split", F.when(F.col("rank") < int(n * train), "train").when(F.col("rank") < int(n * train) + int(n * validation), "validation").otherwise("test")).drop("rank")


def systematic_blocks(points: DataFrame, degrees: float) -> DataFrame:
    """SP07: block id bx * 1000 + by, every fifth to test and every fifth to validation."""
    block = F.floor((F.col("lon") + 180) / degrees) * 1000 + F.floor((F.col("lat") + 90) / degrees)
    return points.withColumn("block", block).withColumn("split", F.when(F.col("block") % 5 == 0, "test").when(F.col("block") % 5 == 1, "validation").otherwise("train"))
