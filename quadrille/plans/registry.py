"""Registration of queries with their SQL, and the tables they read."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes; ``view(text)`` runs SQL whose ``{name}`` are those tables."""

    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in self.names if f"{{{n}}}" in text})


def plain(text: str) -> str:
    """The same text for an engine that has the tables under their own names."""
    return text.format(**{n: n for n in Tables.names})


def with_views(sql: str, **views: str) -> str:
    """``sql`` with derived inputs as common table expressions."""
    head = ", ".join(f"{name} AS ({plain(text)})" for name, text in views.items())
    text = f"WITH {head} {sql}" if head else sql
    # Literals such as 0.5 are doubles here, not decimals.
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)


def query(name: str, sql: str | None = None, **views: str):
    """Registers ``f(t)``; ``sql`` is its oracle, which may read the derived inputs ``views``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, **views)
        return f

    return add
