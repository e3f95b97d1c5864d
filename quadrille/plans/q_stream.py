"""Queries of sources, sinks, streams and the registry."""

from pyspark.sql import functions as F

from quadrille.functions.basic import round6
from quadrille.operators import splits  # noqa: F401
from quadrille.plans import inputs as i
from quadrille.plans.components import default_registry
from quadrille.plans.registry import query
from quadrille.sources import io
from quadrille.streaming import events as ev


@query("src01_analysis_scan", "SELECT longitude AS lon, latitude AS lat, [plants_richness, terrestrial_richness, marine_richness] AS features FROM r", r=i.RICHNESS)
def _(t):
    return io.analysis_scan(t.view(i.RICHNESS))


@query("src02_proportions", " UNION ALL ".join(f"SELECT '{c}' AS feature, round_even(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing, round_even(count(*) FILTER ({c} = 0) / count(*), 6) AS zero FROM r" for c in ("plants_richness", "terrestrial_richness", "marine_richness")), r=i.RICHNESS)
def _(t):
    return io.proportions(t.view(i.RICHNESS)).withColumns({"missing": round6("missing"), "zero": round6("zero")})


@query("src09_dataset_type", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%plant%' THEN 'plants' WHEN lower(p_type) LIKE '%marine%' THEN 'marine' ELSE 'unknown' END AS kind FROM part")
def _(t):
    return t.part.select("p_partkey", io.dataset_type(F.col("p_type")).alias("kind"))


@query("src11_climate_scales", "SELECT s_suppkey, CAST(s_acctbal * 0.1 AS FLOAT) AS bio01, CAST(s_acctbal AS FLOAT) AS bio12 FROM supplier")
def _(t):
    return io.climate_bands(t.supplier.select("s_suppkey", F.col("s_acctbal").alias("bio01"), F.col("s_acctbal").alias("bio12")))


@query("snk02_passthrough_explode", "SELECT CAST(vec_id AS INT) AS row_idx, CAST(unnest(range(64)) AS INT) AS col_idx, unnest(embedding) AS value FROM embeddings")
def _(t):
    return io.exploded_pixels(t.embeddings.select(F.col("vec_id").cast("int").alias("row_idx"), F.col("embedding").alias("values")))


@query("prj16_reservoir_sample", "SELECT 100 AS n")
def _(t):
    return io.reservoir(t.customer, 100, "c_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("str2_rate_limit", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id, epoch_us(ts) // 3600000000 AS s FROM events)")
def _(t):
    return ev.rate_limited(t.events.withColumn("ts", F.col("ts").cast("timestamp")), 3600).agg(F.count(F.lit(1)).alias("n"))


@query("str3_tumbling_metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round_even(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1, 2")
def _(t):
    return ev.windowed(t.events, "1 hour").drop("end")


@query("str4_sliding_alerts", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM events, range(3) r(k) WHERE event_type = 'error') GROUP BY 1")
def _(t):
    return ev.windowed(t.events.where("event_type = 'error'"), "3 hours", "1 hour").select("start", "n")


@query("str5_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t):
    return ev.sessions(t.events, "30 minutes")


@query("ex01_registry_lookup")
def _(t):
    r = default_registry()
    out = r.get("resampler", "no_such_method", "mean")(t.view(i.PIXEL), 4, (64, 64))
    return out.agg(F.count(F.lit(1)).alias("cells"), F.lit(len(r.find("resampler", capability="upsample"))).alias("upsamplers"))


@query("ag38_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("re07_strategy", "SELECT 'richness' AS kind, 'sum' AS strategy UNION ALL SELECT 'continuous', 'average' UNION ALL SELECT 'categorical', 'majority' UNION ALL SELECT 'other', 'nearest'")
def _(t):
    from quadrille.operators.resample import strategy_for

    return t.spark.createDataFrame([(k, strategy_for(k)) for k in ("richness", "continuous", "categorical", "other")], "kind string, strategy string")
