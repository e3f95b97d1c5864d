"""Feature engineering (FE01-FE09)."""

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.basic import clip
from quadrille.functions.distance import shannon, simpson
from quadrille.operators.quantiles import quantiles

TROPIC = 23.43645


def richness_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """FE01: total, log1p of it, proportions, ratios within 0 to 100, Shannon and Simpson; missing counts as 0."""
    v = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    total = sum(v.values(), F.lit(0.0))
    out = {"total_richness": total, "log_total_richness": F.log1p(total), "shannon": shannon(F.array(*v.values())), "simpson": simpson(F.array(*v.values()))}
    out |= {f"{c}_proportion": x / (total + 1e-8) for c, x in v.items()}
    out |= {f"{a}_{b}_ratio": clip(v[a] / (v[b] + 1e-8), 0.0, 100.0) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    return df.withColumns(out)


def spatial_features(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """FE02."""
    y, x = F.col(lat), F.col(lon)
    return df.withColumns(
        {
            "abs_latitude": F.abs(y),
            "distance_from_equator": F.abs(y),
            "distance_from_tropic": F.least(F.abs(y - TROPIC), F.abs(y + TROPIC)),
            "is_tropical": (F.abs(y) <= TROPIC).cast("int"),
            "hemisphere": F.when(y < 0, -1).otherwise(1),
            "cos_latitude": F.cos(F.radians(y)),
            "latitude_squared": y * y,
            "longitude_squared": x * x,
            "lat_lon": y * x,
        }
    )


def bin_edges(df: DataFrame, column: str, bins: int, method: str = "quantile") -> list[float]:
    """FE03: quantile edges without duplicates, or uniform ones."""
    if method == "quantile":
        found = quantiles(df, column, [k / bins for k in range(bins + 1)]) or []
        return sorted(set(found))
    row = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    return [row.a + (row.b - row.a) * k / bins for k in range(bins + 1)] if row.a is not None else []


def binned(column: str, edges: list[float]) -> Column:
    """FE03: right-closed bins from 0, the least value included; what is outside is 0."""
    out = F.lit(0)
    for k in range(len(edges) - 1, 0, -1):
        out = F.when((F.col(column) <= edges[k]) & ((F.col(column) > edges[k - 1]) if k > 1 else (F.col(column) >= edges[0])), k - 1).otherwise(out)
    return out


#: FE04: parts of column names by kind; fixed values of the reference.
ECOLOGICAL = {
    "climate": ("temp", "temperature", "bio_1", "mean_temp", "precip", "precipitation", "bio_12", "annual_precip", "bio_4", "bio_15", "temp_seasonality", "precip_seasonality"),
    "vegetation": ("ndvi", "evi", "lai", "vegetation", "greenness"),
    "terrain": ("elevation", "slope", "aspect", "terrain", "altitude"),
}


def ecological_columns(columns: list[str]) -> dict[str, list[str]]:
    """FE04: the columns of each kind, by what their names have in them."""
    return {kind: [c for c in columns if any(w in c.lower() for w in words)] for kind, words in ECOLOGICAL.items()}


def ecological_features(df: DataFrame, lat: str = "latitude") -> DataFrame:
    """FE04: temperature x precipitation of each pair of columns, variation of vegetation indices (sample deviation over mean), ruggedness of slope and aspect; placeholders where no column matches."""
    found = ecological_columns(df.columns)
    has = lambda word: [c for c in found["climate"] if word in c.lower()]
    out: dict[str, Column] = {f"{a}_x_{b}_interaction": F.col(a) * F.col(b) for a in has("temp") for b in has("precip") if len(found["climate"]) > 1}
    plants = found["vegetation"]
    if len(plants) > 1:
        # Missing indices take no part, as in a mean over those that are there.
        n = sum((F.col(c).isNotNull().cast("int") for c in plants), F.lit(0))
        mean = F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in plants), F.lit(0.0)), n)
        squares = sum((F.coalesce((F.col(c) - mean) ** 2, F.lit(0.0)) for c in plants), F.lit(0.0))
        out["vegetation_seasonality"] = F.sqrt(F.try_divide(squares, n - 1)) / (mean + 1e-8)
    if {"slope", "aspect"} <= set(df.columns):
        out["terrain_complexity"] = F.sqrt(F.col("slope") ** 2 + (F.col("aspect") / 180) ** 2)
    if not any(found.values()):
        slant = {"ecological_placeholder_1": F.sin, "ecological_placeholder_2": F.cos}
        out = {n: 0.1 * f(F.radians(lat)) if lat in df.columns else F.lit(0.0) for n, f in slant.items()}
        out |= {"ecological_placeholder_3": F.lit(0.0), "ndvi_placeholder": F.lit(0.0)}
    return df.withColumns(out) if out else df


class FeatureBuilder:
    """EX07: features that are fitted in one aggregation and added as expressions.

    ``statistics`` are aggregates by name, ``features`` makes columns from what they came to. ``bands`` (EX07's hook for
    rasters of several bands) applies the same features to each of some columns, with the column's name in front.
    """

    def __init__(self, name: str, statistics: dict[str, Column], features, needs: tuple[str, ...] = ()):
        self.name, self.statistics, self.features, self.needs, self.fitted = name, statistics, features, needs, None

    def fit(self, df: DataFrame) -> "FeatureBuilder":
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        self.fitted = df.agg(*(c.alias(n) for n, c in self.statistics.items())).first().asDict() if self.statistics else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise ValueError(f"{self.name} isn't fitted")
        return df.withColumns(self.features(self.fitted))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    @property
    def names(self) -> list[str]:
        return list(self.features(self.fitted)) if self.fitted is not None else []


def banded(columns: list[str], statistics, features) -> FeatureBuilder:
    """EX07: a builder for several bands: ``statistics(column)`` and ``features(column, values)`` of each, under ``<column>_<name>``."""
    made = {f"{c}_{n}": x for c in columns for n, x in statistics(c).items()}
    return FeatureBuilder("bands", made, lambda found: {f"{c}_{n}": x for c in columns for n, x in features(c, {k: found[f"{c}_{k}"] for k in statistics(c)}).items()}, tuple(columns))


def climate_proxies(lat: str = "latitude") -> dict[str, Column]:
    """FE07: fixed ladder of the reference by absolute latitude."""
    a = F.abs(F.col(lat))
    return {"avg_temp": 30 - 0.5 * a, "seasonal_temp": F.when(a < 23.5, 5.0).when(a < 45, 15.0).when(a < 66.5, 25.0).otherwise(35.0)}


def parse_formula(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """FE06: target and terms of ``y ~ a + b:c + d*e``; a term is its factors. ``d*e`` is d, e and d:e."""
    target, _, right = formula.partition("~")
    if not target.strip() or not right.strip():
        raise ValueError(f"not a formula: {formula!r}")
    parts, depth, word = [], 0, ""
    for ch in right:
        depth += (ch == "(") - (ch == ")")
        if ch == "+" and not depth:
            parts.append(word)
            word = ""
        else:
            word += ch
    terms: list[tuple[str, ...]] = []
    for part in (p.strip() for p in [*parts, word]):
        if not part or part == "1":
            continue
        if "*" in part and "(" not in part:
            factors = [f.strip() for f in part.split("*")]
            made = [(f,) for f in factors] + [tuple(factors)]
        else:
            made = [tuple(f.strip() for f in part.split(":"))] if "(" not in part else [(part,)]
        terms += [m for m in made if m not in terms]
    return target.strip(), terms


def formula_columns(terms: list[tuple[str, ...]]) -> dict[str, Column]:
    """FE06: a column for each term; ``log(x)``, ``sqrt(x)`` and ``I(x)`` are applied."""

    def factor(name: str) -> Column:
        call = re.fullmatch(r"(\w+)\((.+)\)", name)
        return {"log": F.log, "sqrt": F.sqrt, "exp": F.exp}.get(call[1], lambda x: x)(F.expr(call[2])) if call else F.col(name)

    return {":".join(t): math.prod((factor(f) for f in t[1:]), start=factor(t[0])) for t in terms}


def is_nested(small: list[tuple[str, ...]], large: list[tuple[str, ...]]) -> bool:
    """FE06."""
    return set(small) < set(large)


def cell_minmax(features: DataFrame) -> DataFrame:
    """FE09: values within their cell's range, 0 where it has none."""
    w = Window.partitionBy("grid_id", "cell_id")
    low, high = F.min("feature_value").over(w), F.max("feature_value").over(w)
    return features.withColumn("normalised", F.coalesce(F.try_divide(F.col("feature_value") - low, high - low), F.lit(0.0)))


def knn_impute(df: DataFrame, columns: list[str], k: int = 5, lat: str = "lat", lon: str = "lon", spatial: float = 0.5, block: int = 1024) -> DataFrame:
    """FE08: missing values as the mean of the k nearest donors by coordinates and shared features, all scaled.

    All rows are donors. Distinct rows are compared in blocks of about ``block``, and the k best of each block are merged;
    ties go to the least hash, and a value without donors is its column's mean.
    """
    import numpy as np
    import pyarrow as pa

    names = [lat, lon, *columns]
    df = df.withColumns({c: F.col(c).cast("double") for c in names})
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(x for c in names for x in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s")))).first()
    mean, scale = np.array([row[f"{c}|m"] or 0.0 for c in names]), np.array([row[f"{c}|s"] or 1.0 for c in names])
    weights = np.array([spatial / 2] * 2 + [(1 - spatial) / max(1, len(columns))] * len(columns))
    vectors = df.groupBy(F.array(*names).alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v"))
    parts = max(1, -(-row["rows"] // block))
    part = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(parts)).alias("part")
    donors = vectors.groupBy(part).agg(F.collect_list(F.struct("h", "v", "n")).alias("donors")).repartition(parts, "part").select("donors")  # a task for each block, which AQE doesn't coalesce
    needy = vectors.where(F.exists("v", lambda x: x.isNull() | F.isnan(x))).groupBy(part).agg(F.collect_list("v").alias("needy")).select("needy")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                wanted, held = (batch.column(c).slice(r, 1).flatten() for c in (0, 1))
                vectors_wanted, (h, v, n) = wanted.to_pylist(), held.flatten()
                h, n, raw = h.to_numpy(), n.to_numpy(), np.array([[np.nan if x is None else x for x in y] for y in v.to_pylist()], float)
                order = np.argsort(h, kind="stable")
                h, n, raw = h[order], n[order], raw[order]
                z, out = (raw - mean) / scale, []
                for q in vectors_wanted:
                    x = (np.array([np.nan if y is None else y for y in q], float) - mean) / scale
                    both = ~np.isnan(x) & ~np.isnan(z)
                    share = (both * weights).sum(axis=1)
                    d = np.where(share > 0, (np.where(both, z - x, 0) ** 2 * weights).sum(axis=1) / np.where(share > 0, share, 1), np.inf)
                    for c in np.flatnonzero(np.isnan(x)):
                        able = np.flatnonzero(~np.isnan(z[:, c]) & np.isfinite(d))
                        near = able[np.argsort(d[able], kind="stable")[:k]]
                        near = np.repeat(near, np.minimum(n[near], k))[:k]
                        out += [(q, int(c), float(d[i]), int(h[i]), float(raw[i, c])) for i in near]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.int64(), pa.float64()), strict=True)], ["v", "c", "d", "h", "x"])

    found = needy.crossJoin(donors).mapInArrow(run, "v array<double>, c int, d double, h long, x double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "h", "x"))), 1, k)
    filled = found.groupBy("v", "c").agg(best.alias("b")).select("v", "c", (F.aggregate("b", F.lit(0.0), lambda s, x: s + x["x"]) / F.size("b")).alias("x"))
    filled = filled.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("__filled")).withColumnRenamed("v", "__v")
    joined = df.join(filled, F.array(*names).eqNullSafe(F.col("__v")), "left")
    value = {c: F.when(F.col(c).isNull() | F.isnan(c), F.coalesce(F.col("__filled")[n], F.lit(float(mean[n])))).otherwise(F.col(c)) for n, c in enumerate(names)}
    return joined.select(*(value[c].alias(c) if c in value else F.col(f"`{c}`") for c in df.columns))
