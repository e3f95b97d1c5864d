"""Stores of results in a shared folder: by experiment, and a cache by key with expiry and eviction (SNK13, SNK14, RE10).

An index is a log of small Parquet rows that is only added to; its state is an aggregation of it. Results are Parquet.
"""

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.io import _deleted

_LOG = "key string, event string, path string, at double, rows long, checksum string, ttl double, body string"


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of their hashes that doesn't depend on their order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("c")).first()
    return r.n, r.c


class _Log:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _add(self, key: str, event: str, path: str | None = None, at: float | None = None, rows: int | None = None, checksum: str | None = None, ttl: float | None = None, body: str | None = None) -> None:
        row = (key, event, path, time.time() if at is None else float(at), rows, checksum, None if ttl is None else float(ttl), body)
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")

    def _state(self) -> DataFrame:
        """The last stored entry of each key that isn't deleted since, with its reads since then."""
        log = self._rows()
        last = log.where("event IN ('store', 'delete')").groupBy("key").agg(F.max_by(F.struct("event", "path", "at", "rows", "checksum", "ttl", "body"), "at").alias("r"))
        kept = last.where("r.event = 'store'").select("key", "r.*").drop("event")
        used = log.where("event = 'hit'").select(F.col("key").alias("k"), F.col("at").alias("used"))
        joined = kept.join(used, (F.col("key") == F.col("k")) & (F.col("used") >= F.col("at")), "left")
        return joined.groupBy(*kept.columns).agg(F.count("used").alias("reads"), F.greatest(F.max("used"), F.max("at")).alias("last"))


class ResultStore(_Log):
    """SNK13, SNK14: results of experiments with JSON statistics: save, load, list (newest first), delete."""

    def save(self, experiment: str, df: DataFrame, statistics: dict | None = None, at: float | None = None) -> None:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows, checksum = _checksum(self.spark.read.parquet(path))
        self._add(experiment, "store", path, at, rows, checksum, None, json.dumps(statistics or {}, sort_keys=True))

    def load(self, experiment: str) -> DataFrame:
        found = self._state().where(F.col("key") == experiment).first()
        if found is None:
            raise KeyError(experiment)
        return self.spark.read.parquet(found.path)

    def list(self, limit: int | None = None) -> DataFrame:
        out = self._state().select(F.col("key").alias("experiment"), "at", "rows", F.col("body").alias("statistics")).orderBy(F.desc("at"), "experiment")
        return out.limit(limit) if limit is not None else out

    def delete(self, experiment: str, at: float | None = None) -> bool:
        found = self._state().where(F.col("key") == experiment).first()
        if found is None:
            return False
        self._add(experiment, "delete", at=at)
        _deleted(self.spark, found.path)
        return True


class ResultCache(_Log):
    """RE10: results by key; an entry older than its time to live, or whose rows no longer sum up, is a miss and goes."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float | None = None):
        super().__init__(spark, folder)
        self.ttl = ttl

    def put(self, key: str, df: DataFrame, at: float | None = None) -> None:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows, checksum = _checksum(self.spark.read.parquet(path))
        self._add(key, "store", path, at, rows, checksum, self.ttl)

    def get(self, key: str, at: float | None = None) -> DataFrame | None:
        now = time.time() if at is None else at
        found = self._state().where(F.col("key") == key).first()
        if found is not None and (found.ttl is None or now - found.at <= found.ttl):
            df = self.spark.read.parquet(found.path)
            if _checksum(df) == (found.rows, found.checksum):
                self._add(key, "hit", at=now)
                return df
        if found is not None:
            self._drop(found, now)
        self._add(key, "miss", at=now)
        return None

    def get_or_make(self, key: str, make, at: float | None = None) -> DataFrame:
        """The cached result, or that of ``make()``, which is stored: a warm-up where nothing is there yet."""
        found = self.get(key, at)
        if found is None:
            self.put(key, make(), at)
            found = self.spark.read.parquet(self._state().where(F.col("key") == key).first().path)
        return found

    def evict(self, most_rows: int, at: float | None = None) -> list[str]:
        """Drops the entries used least recently until the rest have at most ``most_rows`` rows; their keys."""
        now, gone = time.time() if at is None else at, []
        entries = self._state().orderBy("last", "key").collect()
        total = sum(e.rows for e in entries)
        for e in entries:
            if total <= most_rows:
                break
            self._drop(e, now)
            total -= e.rows
            gone.append(e.key)
        return gone

    def _drop(self, entry, at: float) -> None:
        self._add(entry.key, "delete", at=at)
        _deleted(self.spark, entry.path)

    def stats(self) -> DataFrame:
        """One row: entries, rows, hits, misses, hit_rate."""
        log = self._rows().agg(F.count_if(F.col("event") == "hit").alias("hits"), F.count_if(F.col("event") == "miss").alias("misses"))
        held = self._state().agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        return held.crossJoin(log).withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits") * 1.0, F.col("hits") + F.col("misses")), F.lit(0.0)))
