"""Spatial autocorrelation and pair statistics (SA01-SA07, JN17, JN18, KM13, MT)."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geo import KM_PER_DEGREE, haversine_km


def near_pairs(points: DataFrame, km: float, others: DataFrame | None = None) -> DataFrame:
    """(i, j, km) of points (id, lon, lat) within ``km``, by an equi-join on bins of latitude and longitude.

    A point looks into every bin that a point within ``km`` can be in; near the poles and the date line that is all
    longitudes of a latitude band. Without ``others`` a point isn't paired with itself.
    """
    size = max(km / KM_PER_DEGREE * 1.001, 0.05)
    bands = math.ceil(180 / size)
    slots = math.ceil(360 / size)
    left = points.select(F.col("id").alias("i"), F.col("lon").alias("lon_i"), F.col("lat").alias("lat_i"))
    right = (others if others is not None else points).select(F.col("id").alias("j"), F.col("lon").alias("lon_j"), F.col("lat").alias("lat_j"))
    band = lambda c: F.least(F.floor((F.col(c) + 90) / size), F.lit(bands - 1)).cast("int")
    slot = lambda c: F.pmod(F.floor((F.col(c) + 180) / size), F.lit(slots)).cast("int")
    # Degrees of longitude that km is at the band's edge nearest to a pole.
    edge = F.least(F.abs(F.col("lat_i")) + 2 * size, F.lit(90.0))
    reach = F.when(edge >= 89.9, F.lit(slots)).otherwise(F.least(F.ceil(1.02 / F.cos(F.radians(F.least(edge, F.lit(89.9))))) + 1, F.lit(slots)))
    wide = F.when(2 * reach + 1 >= slots, F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(F.transform(F.sequence(-reach, reach), lambda d: F.pmod(slot("lon_i") + d, F.lit(slots)).cast("bigint")))
    a = left.withColumn("band", F.explode(F.sequence(band("lat_i") - 1, band("lat_i") + 1))).withColumn("slot", F.explode(F.array_distinct(wide.cast("array<int>"))))
    b = right.withColumns({"band": band("lat_j"), "slot": slot("lon_j")})
    pairs = a.join(b, ["band", "slot"]).withColumn("km", haversine_km("lon_i", "lat_i", "lon_j", "lat_j")).where(F.col("km") <= km)
    return (pairs if others is not None else pairs.where("i <> j")).select("i", "j", "km")


def moran(points: DataFrame, weights: DataFrame) -> DataFrame:
    """SA01-SA03: (i, n) of Moran's I with row-standardised weights (i, j, w) and values (id, value); normal p-value besides."""
    mean = points.agg(F.avg("value").alias("m"), F.count("value").alias("n"), F.sum("value").alias("t"), F.var_pop("value").alias("v"))
    z = points.crossJoin(mean.select("m")).select("id", (F.col("value") - F.col("m")).alias("z"))
    total = weights.groupBy("i").agg(F.sum("w").alias("all"))
    rows = weights.join(total, "i").select("i", "j", (F.col("w") / F.col("all")).alias("w"))
    lagged = rows.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"), F.sum("w").alias("w"))
    sums = lagged.join(z.withColumnRenamed("id", "i"), "i").agg(F.sum(F.col("z") * F.col("lag")).alias("num"), F.sum("w").alias("w"))
    out = sums.crossJoin(mean)
    value = F.try_divide(F.col("n") / F.nullif(F.col("w"), F.lit(0.0)) * F.col("num"), F.col("v") * F.col("n"))
    return out.select(F.coalesce(value, F.lit(0.0)).alias("moran_i"), (F.lit(-1.0) / F.nullif(F.col("n") - 1, F.lit(0))).alias("expected"), "n")


def local_moran(points: DataFrame, weights: DataFrame) -> DataFrame:
    """SA04: z_i / variance * weighted mean of the neighbours' z."""
    mean = points.agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    z = points.crossJoin(mean).select("id", (F.col("value") - F.col("m")).alias("z"), "v")
    lag = weights.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg((F.sum(F.col("w") * F.col("zj")) / F.sum("w")).alias("lag"))
    return z.join(lag.withColumnRenamed("i", "id"), "id", "left").select("id", F.coalesce(F.col("z") / F.col("v") * F.col("lag"), F.lit(0.0)).alias("local_i"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """SA02: of each i the k nearest j as weights of 1; ties to the least j.

    A point's neighbours are first cut to k in each of a few parts, so that no list grows with a dense place.
    """
    from pyspark.sql import Window

    first = lambda df, *by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("km", "j"))).where(F.col("__n") <= k).drop("__n")
    parted = first(pairs.withColumn("__part", F.pmod(F.xxhash64("j"), F.lit(16))), "i", "__part").drop("__part")
    return first(parted, "i").select("i", "j", F.lit(1.0).alias("w"))


def inverse_distance(pairs: DataFrame) -> DataFrame:
    """SA01, SA02."""
    return pairs.where("km > 0").select("i", "j", (1 / F.col("km")).alias("w"))


def correlogram(points: DataFrame, km: float, bins: int) -> DataFrame:
    """SA05: number of ordered pairs and mean product of deviations in equal, half-open distance bins up to ``km``; each point with itself is in bin 0."""
    mean = points.agg(F.avg("value").alias("m"))
    z = points.crossJoin(mean).select("id", (F.col("value") - F.col("m")).alias("z"))
    pairs = near_pairs(points, km).where(F.col("km") < km).unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("km")))
    out = pairs.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    return out.groupBy(F.floor(F.col("km") / (km / bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("zi") * F.col("zj")).alias("covariance"))


def cluster_quality(rows: DataFrame) -> DataFrame:
    """SA07: mean distance of a cluster's points to its centroid (planar degrees), and its size."""
    centres = rows.groupBy("label").agg(F.avg("lon").alias("cx"), F.avg("lat").alias("cy"))
    d = F.sqrt((F.col("lon") - F.col("cx")) ** 2 + (F.col("lat") - F.col("cy")) ** 2)
    return rows.join(centres, "label").groupBy("label").agg(F.avg(d).alias("spread"), F.count(F.lit(1)).alias("size"))


def buffer_excluded(train: DataFrame, test: DataFrame, km: float) -> DataFrame:
    """JN18, SP04: training points that are farther than ``km`` from every test point."""
    close = near_pairs(train, km, test).select(F.col("i").alias("id")).distinct()
    return train.join(close, "id", "left_anti")


def independence(train: DataFrame, test: DataFrame, km: float) -> DataFrame:
    """SA06: whether every training point is at least ``km`` from every test point: (independent, closer, least), the pairs that are closer and the least distance of them."""
    close = near_pairs(train, km, test).where(F.col("km") < km)
    return close.agg((F.count(F.lit(1)) == 0).alias("independent"), F.count(F.lit(1)).alias("closer"), F.min("km").alias("least"))


def nearest_reference(samples: DataFrame, references: DataFrame, distance) -> DataFrame:
    """JN17: the reference (ref, y) with the least distance to each sample (id, x); ties to the least ref, -1 where no distance is defined.

    ``references`` is dealt into blocks of a few thousand; each is broadcast in its turn, so that a sample meets all of
    them and no more are held at once.
    """
    block, rows = 4096, references.count()
    best, found = F.min(F.when(F.col("d").isNotNull(), F.struct("d", "ref"))), None
    blocks = max(1, -(-rows // block))
    for b in range(blocks):
        some = references.where(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == b) if blocks > 1 else references
        one = samples.crossJoin(F.broadcast(some)).withColumn("d", distance("x", "y")).groupBy("id").agg(best.alias("b"))
        found = one if found is None else found.unionByName(one)
    pairs = found.select("id", F.col("b.d").alias("d"), F.col("b.ref").alias("ref"))
    return pairs.groupBy("id").agg(best.alias("b")).select("id", F.coalesce(F.col("b.ref"), F.lit(-1)).alias("ref"), F.col("b.d").alias("distance"))


def cooccurrence(presence: DataFrame) -> DataFrame:
    """MT01: how many sites two species share, for pairs of species (site, species)."""
    one = presence.distinct()
    a, b = one.select("site", F.col("species").alias("a")), one.select("site", F.col("species").alias("b"))
    return a.join(b, "site").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"))


def rare_species(presence: DataFrame, share: float = 0.1) -> DataFrame:
    """MT04: species with a prevalence below ``share``."""
    sites = presence.select("site").distinct().agg(F.count(F.lit(1)).alias("n"))
    return presence.distinct().groupBy("species").agg(F.count(F.lit(1)).alias("sites")).crossJoin(sites).select("species", "sites", (F.col("sites") / F.col("n")).alias("prevalence")).where(F.col("prevalence") < share)


def p_value(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def between(value: str, low: float, high: float) -> Column:
    return F.col(value).between(low, high)
