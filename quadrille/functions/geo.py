"""Spherical and grid geometry as column expressions (FN01-FN17, FN30)."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.basic import col

EARTH_KM, KM_PER_DEGREE, METRES_PER_DEGREE = 6371.0, 111.0, 111319.9


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """FN01."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def normalised_distance(km) -> Column:
    """FN02: 20 000 km is 1."""
    return F.least(col(km) / 20000.0, F.lit(1.0))


def combined_distance(feature, geo, feature_weight: float = 0.7) -> Column:
    """FN02."""
    return col(feature) * feature_weight + col(geo) * (1 - feature_weight)


def area_km2(minx, miny, maxx, maxy) -> Column:
    """FN03."""
    middle = (col(miny) + col(maxy)) / 2
    return (col(maxx) - col(minx)) * KM_PER_DEGREE * F.abs(F.cos(F.radians(middle))) * (col(maxy) - col(miny)) * KM_PER_DEGREE


def box_intersection(a: str, b: str) -> list[Column]:
    """FN04: minx, miny, maxx, maxy of the intersection of the boxes whose columns begin with ``a`` and ``b``; NULL where empty."""
    low = [F.greatest(F.col(f"{a}{c}"), F.col(f"{b}{c}")) for c in ("minx", "miny")]
    high = [F.least(F.col(f"{a}{c}"), F.col(f"{b}{c}")) for c in ("maxx", "maxy")]
    real = (low[0] < high[0]) & (low[1] < high[1])
    return [F.when(real, x).alias(n) for x, n in zip((*low, *high), ("minx", "miny", "maxx", "maxy"), strict=True)]


def box_contains(x, y) -> Column:
    """FN04, PRJ18: inclusive."""
    return col(x).between(F.col("minx"), F.col("maxx")) & col(y).between(F.col("miny"), F.col("maxy"))


def boxes_touch(a: str, b: str) -> Column:
    """JN12, PRJ18: inclusive overlap."""
    return (F.col(f"{a}minx") <= F.col(f"{b}maxx")) & (F.col(f"{a}maxx") >= F.col(f"{b}minx")) & (F.col(f"{a}miny") <= F.col(f"{b}maxy")) & (F.col(f"{a}maxy") >= F.col(f"{b}miny"))


def buffered(km: float) -> dict[str, Column]:
    """FN05: the four bounds, moved out by km / 111 degrees."""
    d = km / KM_PER_DEGREE
    return {"minx": F.col("minx") - d, "miny": F.col("miny") - d, "maxx": F.col("maxx") + d, "maxy": F.col("maxy") + d}


def subdivided(boxes: DataFrame, largest: float) -> DataFrame:
    """FN06: each box as int(extent / largest) + 1 parts an axis."""
    nx, ny = ((F.col(f"max{a}") - F.col(f"min{a}")) / largest for a in "xy")
    out = boxes.withColumns({"nx": nx.cast("int") + 1, "ny": ny.cast("int") + 1})
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    sx, sy = (F.col("maxx") - F.col("minx")) / F.col("nx"), (F.col("maxy") - F.col("miny")) / F.col("ny")
    return out.select("*", (F.col("minx") + F.col("i") * sx).alias("part_minx"), (F.col("miny") + F.col("j") * sy).alias("part_miny"))


def cell_degrees(metres: float, latitude: float) -> float:
    """FN07."""
    return metres / ((METRES_PER_DEGREE + METRES_PER_DEGREE * math.cos(math.radians(latitude))) / 2)


def degrees_of(metres: float, latitude) -> Column:
    """FN07: degrees that ``metres`` are in the mean of both axes at a latitude."""
    return metres / ((111319.9 + 111319.9 * F.cos(F.radians(latitude))) / 2)


def cell_id(resolution, i, j) -> Column:
    """FN08: C{resolution}_{i}_{j}, five digits each."""
    return F.format_string("C%d_%05d_%05d", col(resolution), col(i), col(j))


def cell_of(x, y, *, minx: float, miny: float, size: float, resolution: int) -> Column:
    """FN08: the id of a point's cell, by truncation; NULL left of or below the grid."""
    i, j = ((col(x) - minx) / size).cast("int"), ((col(y) - miny) / size).cast("int")
    return F.when((col(x) >= minx) & (col(y) >= miny), cell_id(F.lit(resolution), i, j))


def parsed_cell(identifier) -> tuple[Column, Column, Column]:
    """FN08: resolution, i, j."""
    parts = F.split(F.substr(col(identifier), F.lit(2)), "_")
    return parts[0].cast("int"), parts[1].cast("int"), parts[2].cast("int")


def neighbours(cells: DataFrame, *, minx: float, miny: float, maxx: float, maxy: float, size: float) -> DataFrame:
    """FN09: (cell_id, neighbour) for the eight cells around whose origin is within the bounds, inclusive."""
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    resolution, i, j = parsed_cell("cell_id")
    out = cells.select("cell_id", resolution.alias("r"), i.alias("i"), j.alias("j"), F.explode(steps).alias("d")).select("cell_id", "r", (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"))
    x, y = F.lit(minx) + F.col("i") * size, F.lit(miny) + F.col("j") * size
    return out.where(x.between(minx, maxx) & y.between(miny, maxy)).select("cell_id", cell_id("r", "i", "j").alias("neighbour"))


def hex_bin(x, y, size: float) -> tuple[Column, Column]:
    """FN11, without the H3 library: axial coordinates of a flat-topped hexagon of ``size`` degrees. Not H3 cells."""
    q, r = col(x) * 2 / 3 / size, (-col(x) / 3 + math.sqrt(3) / 3 * col(y)) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("long")


def compatible(a, b) -> Column:
    """FN13: resolutions whose ratio is within 0.1 of a whole number."""
    ratio = F.greatest(col(a), col(b)) / F.least(col(a), col(b))
    return F.abs(ratio - F.rint(ratio)) < 0.1


def grid_shift(origin, reference, resolution) -> Column:
    """FN14: the shift that aligns an origin with a reference grid; 0 where it is within a hundredth of a pixel."""
    steps = (col(origin) - col(reference)) / col(resolution)
    fraction = steps - F.rint(steps)
    return F.when(F.abs(fraction) > 0.01, -fraction * col(resolution)).otherwise(0.0)


def mercator(lon, lat) -> tuple[Column, Column]:
    """FN30, VA02: EPSG:3857 metres."""
    r = 6378137.0
    return F.radians(col(lon)) * r, F.log(F.tan(math.pi / 4 + F.radians(col(lat)) / 2)) * r


def inverse_mercator(x, y) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(col(x) / r), F.degrees(2 * F.atan(F.exp(col(y) / r)) - math.pi / 2)


def cache_key(source, resolution, method, bounds) -> Column:
    """FN23."""
    return F.md5(F.concat_ws("_", col(source), F.format_string("%.6f", col(resolution)), col(method), col(bounds)))
