"""Streaming over append-only event folders (STR2-STR5, SNK17)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.basic import round6


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A streaming source of Parquet files; ``ts`` becomes a timestamp with the session's zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rate_limited(events: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """STR2: at most one event of a type and source in each interval (the first to come)."""
    slot = F.floor(F.unix_timestamp("ts") / seconds)
    out = events.withColumn("slot", slot)
    return out.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_type", "user_id", "slot"]) if events.isStreaming else out.dropDuplicates(["event_type", "user_id", "slot"])


def windowed(events: DataFrame, size: str = "10 seconds", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """STR3, STR4: count, mean and greatest value by time window and type."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    out = source.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", round6("mean").alias("mean"), "max")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """STR5: sessions of a user."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def memory_level(percent: Column) -> Column:
    """STR3: fixed thresholds of the reference, 80 and 90 percent."""
    return F.when(percent >= 90, "critical").when(percent >= 80, "warning").otherwise("normal")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a streaming frame over what is there, into Parquet; exactly once by its checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """SNK17: batches of a streaming frame to a function."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_sink(df: DataFrame, path: str, checkpoint: str, *, capacity: int = 10_000, fallback: str | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> None:
    """SNK17: batches of a streaming frame appended to ``path``, a bounded queue: of a batch the first ``capacity`` rows by ``order``.

    What a batch has beyond them is dropped, as the sink is defined, and counted in ``path``.dropped (batch, kept,
    dropped). A batch that can't be written to ``path`` goes to ``fallback`` as JSON lines, if that is given. A batch
    that runs again writes its own folder again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        total = batch.count()
        kept = batch.orderBy(*order).limit(capacity) if total > capacity else batch
        try:
            kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception:
            if fallback is None:
                raise
            kept.write.mode("overwrite").json(f"{fallback}/batch={number}")
        counts = batch.sparkSession.createDataFrame([(min(total, capacity), max(0, total - capacity))], "kept long, dropped long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}.dropped/batch={number}")

    each_batch(df, sink, checkpoint)
