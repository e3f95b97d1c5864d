"""Upserts, clean-ups, transitions and roll-ups as functions from tables to tables (MU01-MU16, SNK01)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: MU08: allowed transitions of a status; fixed values of the reference.
TRANSITIONS = (("pending", "running"), ("running", "completed"), ("running", "failed"), ("failed", "running"), ("pending", "cancelled"), ("running", "cancelled"))


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """MU01: rows of ``new`` whose key is new are added; of several with one key any one."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """SNK01, MU02: ``new`` replaces rows of its key; with ``order`` the last of several new rows stays.

    One aggregation over the union, so a key that many rows have is combined before the shuffle.
    """
    rest = [c for c in old.columns if c not in key]
    tagged = old.select("*", F.lit(0).alias("__v"), F.lit(None).cast("long").alias("__o")).unionByName(new.select("*", F.lit(1).alias("__v"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("__o")).select(*old.columns, "__v", "__o"))
    return tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__v", "__o")).alias("r")).select(*key, "r.*").select(*old.columns)


def kept_cache(cache: DataFrame, cutoff: Column, least_access: int) -> DataFrame:
    """MU05: entries that aren't both old and seldom read."""
    return cache.where(~((F.col("created_at") < cutoff) & (F.col("access_count") <= least_access)))


def unexpired(exports: DataFrame, now: Column) -> DataFrame:
    """MU04."""
    return exports.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def recent(logs: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """MU06."""
    return logs.where(F.col(ts) >= cutoff)


def transitioned(rows: DataFrame, target: Column) -> DataFrame:
    """MU08: the status moves where the transition is allowed."""
    allowed = F.concat_ws(">", F.col("status"), target).isin(*(f"{a}>{b}" for a, b in TRANSITIONS))
    return rows.withColumns({"allowed": allowed, "status": F.when(allowed, target).otherwise(F.col("status"))})


def propagated(nodes: DataFrame, levels: int = 3) -> DataFrame:
    """MU09: a parent's progress is the mean of its children's, from the leaves up, ``levels`` times."""
    out = nodes
    for _ in range(levels - 1):
        means = out.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.avg("progress").alias("mean"))
        out = out.join(means, "node_id", "left").select("node_id", "parent_id", "name", F.coalesce("mean", "progress").alias("progress"))
    return out


def completed_units(nodes: DataFrame, counted: tuple[str, ...] = ("pipeline", "phase"), levels: int = 3) -> DataFrame:
    """MU10: nodes (node_id, parent_id, level, total_units, completed_units) whose parents follow their children, from the leaves up.

    A parent of a ``counted`` level has as many completed units as completed children; any other has the whole part of
    its total at the mean of its children's percentages. Completed is who has all units; without units 0 percent.
    """
    done = F.col("total_units").isNotNull() & (F.col("total_units") > 0) & (F.col("completed_units") >= F.col("total_units"))
    percent = F.coalesce(F.try_divide(F.col("completed_units") * 100.0, F.col("total_units")), F.lit(0.0))
    out = nodes
    for _ in range(levels - 1):
        children = out.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count_if(done).alias("__done"), F.avg(percent).alias("__mean"))
        units = F.when(F.col("level").isin(*counted), F.col("__done")).otherwise(F.floor(F.col("total_units") * F.col("__mean") / 100))
        out = out.join(children, "node_id", "left").withColumn("completed_units", F.when(F.col("__mean").isNull(), F.col("completed_units")).otherwise(units).cast("long")).drop("__done", "__mean")
    return out.withColumn("percent", percent)


def with_statistics(tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """MU15: tiles (tile_y, tile_x, ...) with count, mean and greatest value of their pixels (tile_y, tile_x, value), and a status: empty, or done."""
    found = pixels.groupBy("tile_y", "tile_x").agg(F.count("value").alias("pixels"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    out = tiles.join(found, ["tile_y", "tile_x"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))
    return out.withColumn("status", F.when(F.col("pixels") == 0, "empty").otherwise("done"))


def without_test_rows(rows: DataFrame, now: Column, hours: int = 1, prefix: str = "TEST_", names: tuple[str, ...] = ("name", "job_name", "species_name", "experiment_name", "description", "variable")) -> DataFrame:
    """MU14: ``rows`` but for test data: one of its name columns begins with ``prefix`` and, where there is a created_at, it is from the last ``hours``."""
    marked = [F.coalesce(F.col(c).startswith(prefix), F.lit(False)) for c in names if c in rows.columns]
    if not marked:
        return rows
    test = marked[0]
    for m in marked[1:]:
        test = test | m
    if "created_at" in rows.columns:
        test = test & F.coalesce(F.col("created_at") > now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))
    return rows.where(~test)


#: EX14: fixed values of the reference: seconds to wait by failures so far, attempts, words of errors that pass, and of those whose stage may be left out.
RETRY_DELAYS, MAX_RETRIES = (5, 30, 60), 3
PASSING, QUALITY = ("memory", "connection", "timeout", "temporary"), ("quality", "validation")


def recovery_plan(failures: DataFrame, optional: tuple[str, ...] = (), most: int = MAX_RETRIES) -> DataFrame:
    """EX14: failures (stage, message, at) with attempt, strategy (retry, skip or abort) and seconds to wait before a retry.

    Errors that pass are retried at any attempt; quality errors leave out a stage that is optional; any other is retried
    until the stage has failed ``most`` times before.
    """
    from pyspark.sql import Window

    has = lambda words: F.coalesce(F.lower("message").rlike("|".join(words)), F.lit(False))
    attempt = F.row_number().over(Window.partitionBy("stage").orderBy("at"))
    strategy = F.when(has(PASSING), "retry").when(has(QUALITY) & F.col("stage").isin(*optional), "skip").when(F.col("attempt") > most, "abort").otherwise("retry")
    delay = F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(F.col("attempt") + 1, F.lit(len(RETRY_DELAYS))).cast("int"))
    return failures.withColumn("attempt", attempt).withColumn("strategy", strategy).withColumn("delay", F.when(F.col("strategy") == "retry", delay))


def finished(tasks: DataFrame, ok: Column) -> DataFrame:
    """MU11: success or failure with one more retry."""
    return tasks.withColumns({"status": F.when(ok, "completed").otherwise("failed"), "retry_count": F.col("retry_count") + F.when(ok, 0).otherwise(1)})


def merged_json(left: str, right: str) -> Column:
    """MU13, MU16: maps of text, the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), F.col(right))


def with_progress(nodes: DataFrame) -> DataFrame:
    """MU16: percent of completed over total; NULL without a total."""
    return nodes.withColumn("percent", F.col("completed") * 100.0 / F.nullif(F.col("total"), F.lit(0)))
