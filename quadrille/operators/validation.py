"""Validators as row conditions, alone, together or under a condition (VA02, VA04, VA07, VA10, VA12).

All checks of a table are one aggregation over it, however many there are.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.basic import round6

SEVERITIES = ("info", "warning", "error", "critical")


@dataclass(frozen=True)
class Check:
    """VA10: rows for which ``passes`` is false (or NULL) fail; ``when``, a condition of the whole table, may leave the check out."""

    name: str
    passes: Column
    severity: str = "error"
    when: Column | None = None

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"no severity {self.severity!r}")

    def conditional(self, when: Column) -> "Check":
        """The same check, run only if the aggregate condition holds; conditions add up."""
        return Check(f"conditional({self.name})", self.passes, self.severity, when if self.when is None else self.when & when)


@dataclass
class Composite:
    """VA10: several checks, or composites, as one; names are prefixed."""

    name: str
    parts: list = field(default_factory=list)

    def checks(self) -> list[Check]:
        out = []
        for part in self.parts:
            for c in part.checks() if isinstance(part, Composite) else [part]:
                out.append(Check(f"{self.name}.{c.name}", c.passes, c.severity, c.when))
        return out


def validated(df: DataFrame, validator) -> DataFrame:
    """VA10: (validator, severity, failed, skipped, valid) of a check or composite; only errors and critical ones make invalid."""
    checks = validator.checks() if isinstance(validator, Composite) else [validator]
    counts = [F.count_if(~F.coalesce(c.passes, F.lit(False))).alias(f"f{k}") for k, c in enumerate(checks)]
    runs = [F.coalesce(c.when, F.lit(False)).alias(f"w{k}") if c.when is not None else F.max(F.lit(True)).alias(f"w{k}") for k, c in enumerate(checks)]
    sums = df.agg(*counts, *runs)
    row = lambda k, c: F.struct(F.lit(c.name).alias("validator"), F.lit(c.severity).alias("severity"), F.when(F.col(f"w{k}"), F.col(f"f{k}")).otherwise(F.lit(0)).alias("failed"), (~F.coalesce(F.col(f"w{k}"), F.lit(c.when is None))).alias("skipped"))
    out = sums.select(F.explode(F.array(*(row(k, c) for k, c in enumerate(checks)))).alias("r")).select("r.*")
    return out.withColumn("valid", (F.col("failed") == 0) | F.col("severity").isin("info", "warning"))


def is_valid(results: DataFrame) -> DataFrame:
    """VA10: one row: whether all are valid, and failing checks by severity."""
    failing = [F.count_if((F.col("failed") > 0) & (F.col("severity") == s)).alias(s) for s in SEVERITIES]
    return results.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"), *failing)


#: VA04: values that a kind of dataset may have; fixed values of the reference's cleaning limits.
EXPECTED = {"plants": (0.0, 20000.0), "vertebrates": (0.0, 2000.0), "all": (0.0, 25000.0)}


def value_ranges(df: DataFrame, kind: str, value: str = "value", floating: bool = True) -> DataFrame:
    """VA04: the range of ``value`` against what ``kind`` expects: (least, most, mean, std, issues, warnings, valid).

    Issues: negative values, a maximum over twice the expected one. Warnings: below the expected minimum, above the
    expected maximum up to twice it, a fractional mean of floating counts, a deviation over twice the mean.
    """
    v = F.col(value)
    found = df.agg(F.count(v).alias("count"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    if kind not in EXPECTED:
        return found.withColumns({"issues": F.lit(""), "warnings": F.lit("unknown kind"), "valid": F.lit(True)})
    low, high = EXPECTED[kind]
    joined = lambda *x: F.array_join(F.array_compact(F.array(*x)), ",")
    issues = joined(F.when((F.col("least") < low) & (F.col("least") < 0), "negative"), F.when(F.col("most") > 2 * high, "far above"), F.when(F.col("count") == 0, "no data"))
    warnings = joined(F.when((F.col("least") < low) & (F.col("least") >= 0), "below"), F.when((F.col("most") > high) & (F.col("most") <= 2 * high), "above"), F.when(F.lit(floating) & (F.pmod(F.col("mean"), F.lit(1.0)) > 0.01), "fractional"), F.when(F.col("std") > 2 * F.col("mean"), "variance"))
    return found.withColumns({"issues": issues, "warnings": warnings}).withColumn("valid", F.col("issues") == "")


def consistency(rasters: DataFrame) -> DataFrame:
    """VA07: one row for rasters (crs, resolution, minx, miny, maxx, maxy): equal resolutions (1e-6) and CRS, whether all overlap, and the union of their bounds."""
    w, h = F.min("maxx") - F.max("minx"), F.min("maxy") - F.max("miny")
    bounds = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    return rasters.agg(F.count(F.lit(1)).alias("rasters"), (F.max("resolution") - F.min("resolution") < 1e-6).alias("resolution_consistent"), (F.min("crs") == F.max("crs")).alias("crs_consistent"), ((w > 0) & (h > 0)).alias("spatial_overlap"), *bounds)


def transform_errors(points: DataFrame, made: tuple[Column, Column], expected: tuple[str, str], most: float = 1.0) -> DataFrame:
    """VA02: metres between transformed and expected points: (points, wrong, greatest, valid); wrong is farther than ``most``."""
    d = F.sqrt((made[0] - F.col(expected[0])) ** 2 + (made[1] - F.col(expected[1])) ** 2)
    out = points.select(d.alias("d")).agg(F.count("d").alias("points"), F.count_if(F.col("d") > most).alias("wrong"), round6(F.max("d")).alias("greatest"))
    return out.withColumn("valid", F.col("wrong") == 0)


def storage_accuracy(pixels: DataFrame, minx: float, maxy: float, resolution: float, bounds: tuple[float, float, float, float], tolerance: float = 1e-6) -> DataFrame:
    """VA12: stored coordinates (x, y) against pixel centres, of all rows: (rows, wrong, greatest, bounds_match, valid)."""
    x, y = F.abs(F.col("x") - (minx + (F.col("col_idx") + 0.5) * resolution)), F.abs(F.col("y") - (maxy - (F.col("row_idx") + 0.5) * resolution))
    found = pixels.where("value IS NOT NULL").agg(F.count(F.lit(1)).alias("rows"), F.count_if((x > tolerance) | (y > tolerance)).alias("wrong"), round6(F.coalesce(F.max(F.greatest(x, y)), F.lit(0.0))).alias("greatest"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")))
    ends = zip(("min_x", "min_y", "max_x", "max_y"), bounds, strict=True)
    near = F.lit(True)
    for name, value in ends:
        near = near & (F.abs(F.col(name) - value) < resolution)
    return found.select("rows", "wrong", "greatest", F.coalesce(near, F.lit(False)).alias("bounds_match"), (F.col("wrong") == 0).alias("valid"))
