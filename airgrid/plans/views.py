"""Stand-in views over the star-schema tables, as SQL both engines run.

``{name}`` stands for a base table; ``{series:n}`` style fragments differ by
engine and come from ``_DIALECT``.  Every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # two satellites, quality flags, some missing exponents
    "snapshots": """
        SELECT event_id, ts AS t, CAST(16 + event_id % 2 AS INT) AS sat,
               CAST(user_id % 2 AS INT) AS y, CAST(floor(user_id / 2) AS INT) % 3 AS x,
               CASE WHEN event_type <> 'error' THEN value / 97e0 END AS AOD,
               CASE WHEN event_id % 5 <> 0 THEN 5e-1 + (event_id % 7) / 1e1 END AS AE1,
               CAST(event_id % 4 AS INT) AS DQF, CAST(event_id % 3 AS INT) AS AE_DQF,
               CASE WHEN event_id % 11 = 0 THEN 2 ELSE 4 END AS n_flags
        FROM {events}""",
    # several instruments per site and day, a few negative readings
    "monitors": """
        SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS time,
               25.25e0 + l_suppkey % 24 AS latitude, -119.6e0 + (l_suppkey * 7) % 47 AS longitude,
               l_extendedprice / 997e0 - 2e0 AS value, l_linenumber AS POC,
               concat('Site ', CAST(l_suppkey AS STRING)) AS site_name,
               CASE l_suppkey % 3 WHEN 0 THEN 'Nebraska' WHEN 1 THEN 'Texas' ELSE 'Ohio' END AS state_name
        FROM {lineitem}""",
    # complete regular grid, twenty columns and as many rows as there are parts for, five days; holes in blh
    "met_daily": """
        SELECT DATE '2024-01-01' + d AS time, CAST(floor(p_partkey / 20) AS INT) AS i, CAST(p_partkey % 20 AS INT) AS j,
               25e0 + 25e0 * floor(p_partkey / 20) / (SELECT floor(max(p_partkey) / 20) + 1 FROM {part}) AS lat,
               -120e0 + 2.5e0 * (p_partkey % 20) AS lon,
               p_retailprice / 9.7e0 + d AS t2m,
               CASE WHEN p_partkey % 37 <> 0 THEN p_size * 1e0 END AS blh
        FROM (SELECT p_partkey, p_retailprice, p_size, [five_days] AS d FROM {part}) AS p""",
    # target cells inside the weather grid; x_m, y_m are geostationary metres
    "grid_cells": """
        SELECT CAST(floor(c_custkey / 15) AS INT) AS y, CAST(c_custkey % 15 AS INT) AS x,
               26.3e0 + 21e0 * floor(c_custkey / 15) / (SELECT floor(max(c_custkey) / 15) + 1 FROM {customer}) AS lat,
               -118.7e0 + 3.1e0 * (c_custkey % 15) AS lon,
               -3e6 + 2e5 * (c_custkey % 15) AS x_m,
               4.2e6 - 2e6 * floor(c_custkey / 15) / (SELECT floor(max(c_custkey) / 15) + 1 FROM {customer}) AS y_m
        FROM {customer}""",
    # sparse daily field on the target cells
    "daily_grid": """
        SELECT DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS time,
               CAST(floor(o_custkey / 15) AS INT) AS y, CAST(o_custkey % 15 AS INT) AS x,
               avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 999983e0 END) AS AOD, count(*) AS n_snapshots
        FROM {orders} GROUP BY 1, 2, 3""",
    # years of daily predictions on six cells, three models, gaps
    "pred_grid": """
        SELECT CAST(o_orderdate AS DATE) AS time, CAST(o_custkey % 2 AS INT) AS y,
               CAST(floor(o_custkey / 2) AS INT) % 3 AS x,
               avg(o_totalprice / 9973e0) AS linear, avg(o_totalprice / 9001e0 - 1e0) AS forest,
               avg(CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 11003e0 END) AS trees
        FROM {orders} GROUP BY 1, 2, 3""",
    # wide hold-out table
    "predictions": """
        SELECT l_orderkey, l_linenumber, l_extendedprice / 499e0 AS truth,
               l_extendedprice / 523e0 + 5e1 * l_discount - 3e0 AS linear,
               l_extendedprice / 499e0 * (9e-1 + l_tax) AS forest,
               l_extendedprice / 499e0 + (l_orderkey * 31 + l_linenumber) % 7 - 3e0 AS trees
        FROM {lineitem}""",
    # planted linear signal plus bounded noise
    "features": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS time,
               25.25e0 + l_suppkey % 24 AS lat, -119.6e0 + (l_suppkey * 7) % 47 AS lon,
               l_discount AS AOD, l_tax AS t2m, l_quantity AS blh, CAST(1 + l_orderkey % 5 AS INT) AS n_snapshots,
               5e0 + 4e1 * l_discount + 1e-1 * l_quantity
                   + ((l_orderkey * 7919 + l_linenumber * 104729) % 1000) / 997e0 AS PM25
        FROM {lineitem}""",
    # five aerosol components for the composite mass
    "aerosol": """
        SELECT l_shipdate AS time, CAST(l_suppkey % 5 AS INT) AS lat, CAST(l_partkey % 5 AS INT) AS lon,
               l_quantity / 1e9 AS DUSMASS25, l_tax / 9.89e8 AS SSSMASS25, l_discount / 9.97e8 AS BCSMASS,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 9.973e12 END AS OCSMASS, l_quantity / 2e9 AS SO4SMASS
        FROM {lineitem}""",
    # a region per supplier: an L with a rectangular hole, and a second part beside it
    "region_vertices": """
        SELECT concat('R', CAST(s_suppkey AS STRING)) AS name, k, CASE WHEN k < 7 THEN 0 WHEN k < 12 THEN 1 ELSE 2 END AS part,
               -119e0 + (s_suppkey * 11) % 43 + (1e0 + s_suppkey % 4) * CASE WHEN k IN (1, 2) THEN 2e0 WHEN k IN (3, 4) THEN 1e0
                   WHEN k IN (7, 10, 11) THEN 25e-2 WHEN k IN (8, 9) THEN 15e-1 WHEN k IN (12, 15, 16) THEN 22e-1
                   WHEN k IN (13, 14) THEN 3e0 ELSE 0e0 END AS lon,
               25.7e0 + (s_suppkey * 5) % 21 + (5e-1 + s_suppkey % 3) * CASE WHEN k IN (2, 3) THEN 1e0 WHEN k IN (4, 5) THEN 2e0
                   WHEN k IN (7, 8, 11) THEN 2e-1 WHEN k IN (9, 10) THEN 8e-1 WHEN k IN (14, 15) THEN 17e-1 ELSE 0e0 END AS lat
        FROM (SELECT s_suppkey, [seventeen_vertices] AS k FROM {supplier}) AS s""",
    # folds by model
    "cv_scores": """
        SELECT CASE p_partkey % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'poly' WHEN 2 THEN 'forest' ELSE 'trees' END AS model,
               CAST(floor(p_partkey / 4) AS INT) AS fold, 1e0 - p_size / 1e2 AS r2, -p_size / 1e1 AS neg_mae,
               -p_size / 8e0 AS neg_rmse, p_retailprice / 1e2 AS fit_time
        FROM {part}""",
}

_DIALECT = {
    "spark": {
        "five_days": "explode(array(0, 1, 2, 3, 4))",
        "seventeen_vertices": "explode(sequence(0, 16))",
    },
    "duckdb": {
        "five_days": "unnest([0, 1, 2, 3, 4])",
        "seventeen_vertices": "unnest(range(0, 17))",
    },
}


def _dialect(text: str, engine: str) -> str:
    for key, fragment in _DIALECT[engine].items():
        text = text.replace(f"[{key}]", fragment)
    return text


class Tables:
    """Base tables and stand-in views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which ``{name}`` stands for a base table or a view."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(_dialect(text, "spark"), **{n: getattr(self, n) for n in names})


def with_views(body: str) -> str:
    """DuckDB text: ``body`` with the views it names put in front as CTEs."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = [f"{v} AS ({_dialect(VIEWS[v], 'duckdb')})" for v in used]
    ctes = [re.sub(r"\{(\w+)\}", r"\1", c) for c in ctes]
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ",\n".join(ctes) + "\n" + body
