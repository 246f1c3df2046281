"""How a query is registered, and the views that stand for gauges, forcing, cells and networks on the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The views in DuckDB's SQL; the DataFrames below are the same rows.
VIEWS = {
    "flow_daily": "SELECT c_mktsegment AS basin, CAST(o_orderdate AS DATE) AS d, SUM(o_totalprice)/10000.0 AS q FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2",
    "sim_daily": "SELECT c_mktsegment AS basin, CAST(l_shipdate AS DATE) AS d, SUM(l_extendedprice*(1-l_discount))/10000.0 AS q FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY 1,2",
    "precip_daily": "SELECT c_mktsegment AS basin, CAST(l_shipdate AS DATE) AS d, SUM(l_quantity)/10.0 AS p, 263.15+250*AVG(l_tax) AS t FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey GROUP BY 1,2",
    "obs_event": "SELECT user_id AS site, event_type AS variable, ts, value FROM events",
    "cells": "SELECT p_partkey AS cell_id, p_partkey%40 AS x, p_partkey//40 AS y, p_retailprice AS elev, p_size%17+1 AS cls FROM part",
    "zones": "SELECT n_nationkey AS unit_id, n_regionkey AS gru_id, CAST((n_nationkey%5)*8 AS DOUBLE) AS xmin, CAST((n_nationkey%5+1)*8 AS DOUBLE) AS xmax, CAST((n_nationkey//5)*10 AS DOUBLE) AS ymin, CAST((n_nationkey//5+1)*10 AS DOUBLE) AS ymax FROM nation",
    "network": "SELECT c_custkey AS seg, c_custkey//2 AS down, ABS(c_acctbal) AS length, c_nationkey AS unit_id FROM customer WHERE c_custkey>=1",
    "samples": "SELECT l_orderkey, l_linenumber, l_quantity AS p1, l_discount AS p2, l_tax AS p3, l_extendedprice AS score FROM lineitem",
    "solutions": "SELECT p_partkey AS id, p_retailprice AS f1, CAST(p_size AS DOUBLE) AS f2 FROM part",
    "pairs": "SELECT f.basin, f.d, f.q AS obs, s.q AS sim FROM flow_daily f JOIN sim_daily s ON f.basin=s.basin AND f.d=s.d",
    "inzone": "SELECT c.*, z.unit_id, z.gru_id FROM cells c JOIN zones z ON c.x>=z.xmin AND c.x<z.xmax AND c.y>=z.ymin AND c.y<z.ymax",
    "wb": "SELECT f.basin, f.d, f.q, p.p, p.t FROM flow_daily f JOIN precip_daily p ON f.basin=p.basin AND f.d=p.d",
}


class Views:
    """The stand-in views of one folder of tables, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sales(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("basin"))
        return self.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("d", F.to_date("l_shipdate"))

    @property
    def flow_daily(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("basin"))
        return self.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("basin", F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 10000.0).alias("q"))

    @property
    def sim_daily(self) -> DataFrame:
        return self._sales().groupBy("basin", "d").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10000.0).alias("q"))

    @property
    def precip_daily(self) -> DataFrame:
        return self._sales().groupBy("basin", "d").agg((F.sum("l_quantity") / 10.0).alias("p"), (263.15 + 250 * F.avg("l_tax")).alias("t"))

    @property
    def obs_event(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("site"), F.col("event_type").alias("variable"), "ts", "value")

    @property
    def cells(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS cell_id", "p_partkey%40 AS x", "p_partkey div 40 AS y", "p_retailprice AS elev", "p_size%17+1 AS cls")

    @property
    def zones(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS unit_id", "n_regionkey AS gru_id", "CAST((n_nationkey%5)*8 AS DOUBLE) AS xmin", "CAST((n_nationkey%5+1)*8 AS DOUBLE) AS xmax", "CAST((n_nationkey div 5)*10 AS DOUBLE) AS ymin", "CAST((n_nationkey div 5+1)*10 AS DOUBLE) AS ymax")

    @property
    def network(self) -> DataFrame:
        return self.table("customer").where("c_custkey>=1").selectExpr("c_custkey AS seg", "c_custkey div 2 AS down", "abs(c_acctbal) AS length", "c_nationkey AS unit_id")

    @property
    def samples(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS p1", "l_discount AS p2", "l_tax AS p3", "l_extendedprice AS score")

    @property
    def solutions(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS id", "p_retailprice AS f1", "CAST(p_size AS DOUBLE) AS f2")

    @property
    def pairs(self) -> DataFrame:
        return self.flow_daily.withColumnRenamed("q", "obs").join(self.sim_daily.withColumnRenamed("q", "sim"), ["basin", "d"])

    @property
    def wb(self) -> DataFrame:
        return self.flow_daily.join(self.precip_daily, ["basin", "d"])


def with_views(sql: str) -> str:
    """The statement with the views it uses, and the views these use, as common table expressions before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {m[1] or ''}{ctes}, {sql[m.end():]}" if m else f"WITH {ctes} {sql}"


KINDS = {"s": ("string", "CAST({c} AS VARCHAR)"), "i": ("bigint", "CAST({c} AS BIGINT)"), "f": ("double", "round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0"), "d": ("date", "CAST({c} AS DATE)"), "t": ("timestamp_ntz", "CAST({c} AS TIMESTAMP)"), "b": ("boolean", "CAST({c} AS BOOLEAN)")}


@dataclass
class Query:
    """columns: `name:kind ...`; both sides are cast to the kinds, doubles rounded to 6 decimals
    (a little above, so that both engines round halves alike)."""

    name: str
    columns: str
    build: Callable[[Views], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df, out = self.build(Views(spark, sf_dir)), []
        for c in self.columns.split():
            n, k = c.split(":")
            x = F.col(n).cast(KINDS[k][0])
            out.append((F.round(x + F.lit(1e-9), 6) + F.lit(0.0) if k == "f" else x).alias(n))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"{KINDS[k][1].format(c=n)} AS {n}" for n, k in (c.split(":") for c in self.columns.split()))
        return f"SELECT {cols} FROM ({with_views(self.sql)})"
