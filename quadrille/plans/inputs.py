"""Reference-shaped inputs derived from the driver tables, in SQL that Spark and DuckDB both run."""

PIXEL = "SELECT CAST(l_partkey % 64 AS INT) AS row_idx, CAST(l_suppkey % 64 AS INT) AS col_idx, sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2"
PIXEL_A = "SELECT CAST(l_partkey % 64 AS INT) AS row_idx, CAST(l_suppkey % 64 AS INT) AS col_idx, sum(l_quantity) AS value FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1, 2"
PIXEL_R = "SELECT CAST(l_partkey % 64 AS INT) AS row_idx, CAST(l_suppkey % 64 AS INT) AS col_idx, sum(l_quantity) AS value FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1, 2"
PIXEL_N = "SELECT CAST(l_partkey % 64 AS INT) AS row_idx, CAST(l_suppkey % 64 AS INT) AS col_idx, CASE WHEN min(l_linenumber) = 1 THEN 0.0 ELSE sum(l_quantity) END AS value FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY 1, 2"

SPECIES = """SELECT CAST(n_regionkey AS BIGINT) AS grid_id, CAST(o_custkey % 100 AS BIGINT) AS cell_id, concat('p', CAST(l_partkey AS STRING)) AS species_name,
c_mktsegment AS category, l_returnflag AS range_type, l_discount * 100 AS coverage_percent, l_quantity AS intersection_area_km2, l_tax * 10 AS presence_score
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
GRID = "SELECT CAST(r_regionkey AS BIGINT) AS grid_id, r_name AS name, 'cubic' AS grid_type, CAST((r_regionkey + 1) * 1000 AS INT) AS resolution, CAST(r_regionkey * 10 - 30 AS DOUBLE) AS minx, CAST(r_regionkey * 5 AS DOUBLE) AS miny, CAST(r_regionkey * 10 AS DOUBLE) AS maxx, CAST(r_regionkey * 5 + 20 AS DOUBLE) AS maxy FROM {region}"
CELL = "SELECT CAST(n_regionkey AS BIGINT) AS grid_id, CAST(c_custkey % 100 AS BIGINT) AS cell_id, sum(c_acctbal) AS area_km2 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2"
FEATURE = "SELECT CAST(n_regionkey AS BIGINT) AS grid_id, CAST(s_suppkey % 100 AS BIGINT) AS cell_id, 'climate' AS feature_type, concat('f', CAST(s_suppkey % 3 AS STRING)) AS feature_name, s_acctbal AS feature_value FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"

EXPERIMENT = "SELECT c_custkey AS experiment_id, c_name AS name, TIMESTAMP '2024-01-01 00:00:00' AS started_at FROM {customer}"
JOB = "SELECT o_orderkey AS job_id, o_custkey AS experiment_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(o_orderkey % 101 AS DOUBLE) AS progress_percent, o_orderdate AS created_at, CAST(o_orderkey % 5 AS INT) AS retry_count, CAST(o_orderkey % 10 AS INT) AS priority FROM {orders}"
METRIC = "SELECT event_id, CAST(user_id % 20 AS BIGINT) AS experiment_id, concat('stage', CAST(event_id % 5 AS STRING)) AS stage, event_type AS level, ts, value, props FROM {events}"
NODE = "SELECT concat('r', CAST(r_regionkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id, r_name AS name, 0.0 AS progress FROM {region} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, 0.0 FROM {nation} UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), c_name, CAST(c_custkey % 101 AS DOUBLE) FROM {customer}"
POINT = "SELECT c_custkey AS id, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, CAST((c_custkey * 7) % 180 - 90 AS DOUBLE) AS lat, c_acctbal AS value FROM {customer}"
SUPPLIERPOINT = "SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 7) % 180 - 90 AS DOUBLE) AS lat, s_acctbal AS value FROM {supplier}"
#: Four features, some missing, not negative.
SAMPLE = "SELECT c_custkey AS id, CASE WHEN (c_custkey * 31) % 5 = 0 THEN NULL ELSE CAST(c_custkey % 17 AS DOUBLE) END AS f0, CASE WHEN (c_custkey * 31 + 1) % 5 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) END AS f1, CASE WHEN (c_custkey * 31 + 2) % 5 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS DOUBLE) END AS f2, CASE WHEN (c_custkey * 31 + 3) % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS f3 FROM {customer}"
RICHNESS = "SELECT c_custkey AS id, CAST((c_custkey * 7) % 180 - 90 AS DOUBLE) AS latitude, CAST(c_custkey % 360 - 180 AS DOUBLE) AS longitude, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CAST(c_custkey % 53 AS DOUBLE) END AS plants_richness, CAST(c_custkey % 31 AS DOUBLE) AS terrestrial_richness, CAST(c_nationkey AS DOUBLE) AS marine_richness FROM {customer}"
