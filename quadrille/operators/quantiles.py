"""Exact percentiles without a task that holds all values."""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, column: str, shares: list[float], bins: int = 256) -> list[float] | None:
    """The exact percentiles ``shares`` (0 to 1) of ``column``, interpolated linearly; None without a value. NULL and NaN take no part.

    Values are counted first, so that one which many rows have is one row. Distinct values are dealt into bins between
    approximate percentiles; only the bins that hold a wanted place are put in order, each in its own task.
    """
    v = F.col(column).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        cuts = values.agg(F.percentile_approx("v", F.array(*(F.lit(k / bins) for k in range(1, bins))), 10 * bins).alias("q")).first().q
        if not cuts:
            return None
        limits = F.array(*map(F.lit, sorted(set(cuts))))
        binned = values.withColumn("bin", F.size(F.filter(limits, lambda q: q < F.col("v"))))
        before, total = {}, 0
        for r in sorted(binned.groupBy("bin").agg(F.sum("n").alias("n")).collect()):
            before[r.bin], total = total, total + r.n
        places = sorted({p for q in shares for p in (int(q * (total - 1)), min(int(q * (total - 1)) + 1, total - 1))})
        wanted = {max((b for b in before if before[b] <= p), key=before.get) for p in places}
        start = F.element_at(F.create_map(*(F.lit(x) for b in sorted(wanted) for x in (b, before[b]))), F.col("bin"))
        end = start + F.sum("n").over(Window.partitionBy("bin").orderBy("v"))
        held = binned.where(F.col("bin").isin(*wanted)).withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
        at = F.filter(F.array(*map(F.lit, places)), lambda p: (p >= F.col("start")) & (p < F.col("end")))
        found = {p: r.v for r in held.withColumn("at", at).where(F.size("at") > 0).select("at", "v").collect() for p in r.at}
    finally:
        values.unpersist()
    out = []
    for q in shares:
        low = int(q * (total - 1))
        a, b = found[low], found[min(low + 1, total - 1)]
        out.append(a + (b - a) * (q * (total - 1) - low))
    return out
