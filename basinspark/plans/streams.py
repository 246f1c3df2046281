"""Queries over streams and sources: the given tables through file streams and written files, read to the end."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..scratch import stored
from ..sources import readers as r
from ..streaming import gauges as g
from .base import Query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BASINS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def scratch(v) -> str:
    """A new folder next to the tables that the shared folder holds."""
    return os.path.dirname(stored(v.spark.range(1)).inputFiles()[0]) + "-stream"


def events(v):
    """The events table as a stream; its last row comes again far later, so that every window closes."""
    t = v.table("events")
    path = scratch(v)
    late = t.orderBy(F.desc("event_id")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).withColumn("event_type", F.lit("end"))
    t.write.parquet(f"{path}/in")
    late.write.mode("append").parquet(f"{path}/in")
    return g.stream_source(v.spark, f"{path}/in", t.schema.simpleString()[7:-1].replace(":", " ")), path


def through(v, f, where="event_type <> 'end'", mode="append"):
    s, path = events(v)
    out = g.run_once(f(s), path, mode)
    return out


def closed(df, ts="ts"):
    return df.where(F.col(ts) < F.lit("2026-01-01").cast("timestamp"))


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _csv(v):
    path = scratch(v)
    v.flow_daily.select(F.col("d").alias("Date"), F.col("q").alias("discharge_cms"), "basin").write.partitionBy("basin").option("header", "true").csv(f"{path}/csv")
    return v.spark.read.option("basePath", f"{path}/csv").csv(f"{path}/csv", header=True)


def _pairs_stream(v):
    s, path = events(v)
    s2, _ = events(v)
    a = s.where("event_type <> 'error'").select(F.col("event_id").alias("k"), "ts", "value")
    b = s2.where("event_type <> 'view'").select(F.col("event_id").alias("k"), "ts", (F.col("value") * 2).alias("value"))
    return g.run_once(g.stream_align(a, b, "k", "ts", "1 day", "1 hour"), path)


MONTHS = ", ".join(f"max(CASE WHEN day(d)={i} THEN q END) AS FLOW{i}" for i in range(1, 32))

def _stateful(v):
    """Four files, one a batch; the last row of all comes far later, so that every unit before it is closed."""
    t = v.table("events")
    path = scratch(v)
    t.repartitionByRange(3, "ts", "event_id").write.parquet(f"{path}/in")
    late = t.orderBy(F.desc("event_id")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).withColumn("event_type", F.lit("end"))
    late.write.mode("append").parquet(f"{path}/in")
    s = g.stream_source(v.spark, f"{path}/in", EVENTS, files=1)
    pairs = s.select("event_type", "ts", F.col("value").alias("obs"), (F.col("value") * 1.1 + F.col("user_id") / 100).alias("sim"))
    rows = g.run_updates(g.stream_moments(pairs, ["event_type"], "ts", "60 days", 86_400_000 * 120), path)
    return g.moment_metrics(g.newest(rows.where("event_type <> 'end'"), ["event_type"]))


QUERIES = [
    Query("h01_stream_source", "event_id:i value:f", lambda v: through(v, lambda s: s.where("event_type <> 'end'").select("event_id", "value")), "SELECT event_id, value FROM events"),
    Query("h02_stream_resample", "user_id:i ts:t value:f n:i", lambda v: ntz(closed(through(v, lambda s: g.stream_resample(s, ["user_id"], "ts", "value", "1 day", "2 days"))), "ts"), "SELECT user_id, date_trunc('day', ts) AS ts, avg(value) AS value, count(value) AS n FROM events GROUP BY 1, 2"),
    Query("h03_stream_sliding", "event_type:s ts:t value:f", lambda v: ntz(closed(through(v, lambda s: g.stream_sliding(s.where("event_type <> 'end'").unionByName(s.where("event_type = 'end'")), ["event_type"], "ts", "value", "2 hours", "1 hour", "2 days"))), "ts"), "WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS ts, value FROM events) SELECT event_type, ts, avg(value) AS value FROM w GROUP BY 1, 2"),
    Query("h04_stream_sessions", "user_id:i first:t last:t n:i", lambda v: ntz(closed(through(v, lambda s: g.stream_sessions(s, ["user_id"], "ts", "6 hours", "2 days")), "first"), "first", "last"), "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s"),
    Query("h05_stream_metrics", "event_type:s n:i rmse:f pbias:f", lambda v: through(v, lambda s: g.stream_metrics(s.where("event_type <> 'end'").select("event_type", F.col("value").alias("obs"), (F.col("value") * 1.1 + F.col("user_id") / 100).alias("sim")), ["event_type"]), mode="complete"), "SELECT event_type, count(*) AS n, sqrt(avg(pow(value*0.1::DOUBLE+user_id/100.0::DOUBLE,2))) AS rmse, 100*(sum(value*1.1::DOUBLE+user_id/100.0::DOUBLE)-sum(value))/sum(value) AS pbias FROM events GROUP BY 1"),
    Query("h05_stateful", "event_type:s closed:b n:i rmse:f pbias:f nse:f kge:f", _stateful, "WITH p AS (SELECT event_type, value AS o, value*1.1::DOUBLE+user_id/100.0::DOUBLE AS s FROM events) SELECT event_type, true AS closed, count(*) AS n, sqrt(avg(pow(s-o,2))) AS rmse, 100*(sum(s)-sum(o))/sum(o) AS pbias, 1-sum(pow(s-o,2))/(var_pop(o)*count(*)) AS nse, 1-sqrt(pow(corr(s,o)-1,2)+pow(stddev_pop(s)/stddev_pop(o)-1,2)+pow(avg(s)/avg(o)-1,2)) AS kge FROM p GROUP BY 1"),
    Query("h06_stream_enrich", "event_id:i c_name:s", lambda v: through(v, lambda s: g.stream_enrich(s.where("event_type <> 'end'"), v.table("customer").select(F.col("c_custkey").alias("user_id"), "c_name"), ["user_id"]).select("event_id", "c_name")), "SELECT event_id, c_name FROM events JOIN customer ON c_custkey=user_id"),
    Query("h07_stream_align", "k:i ts:t obs:f sim:f", lambda v: ntz(closed(_pairs_stream(v)), "ts"), "SELECT event_id AS k, ts, value AS obs, value*2 AS sim FROM events WHERE event_type NOT IN ('error', 'view')"),
    Query("h08_stream_dedup", "event_id:i", lambda v: through(v, lambda s: g.stream_dedup(s.where("event_type <> 'end'").unionByName(s.where("event_type <> 'end'")), ["event_id"], "ts", "60 days").select("event_id")), "SELECT event_id FROM events"),
    Query("a01_read_obs", "basin:s d:d q:f", lambda v: _csv(v).select("basin", F.col("Date").cast("date").alias("d"), F.col("discharge_cms").try_cast("double").alias("q")), "SELECT basin, d, q FROM flow_daily"),
    Query("a05_unpivot_monthly", "station:s d:d flow:f", lambda v: r.unpivot_monthly(v.flow_daily.groupBy(F.col("basin").alias("STATION_NUMBER"), F.year("d").alias("YEAR"), F.month("d").alias("MONTH")).agg(*[x for i in range(1, 32) for x in (F.max(F.when(F.dayofmonth("d") == i, F.col("q"))).alias(f"FLOW{i}"), F.lit(None).cast("string").alias(f"SYMBOL{i}"))])), "SELECT basin AS station, d, q AS flow FROM flow_daily"),
    Query("a06_json", "event_id:i k:s", lambda v: v.table("events").select("event_id", F.element_at(F.map_keys(F.from_json("props", "map<string,string>")), 1).alias("k")), "SELECT event_id, json_keys(props)[1] AS k FROM events"),
    Query("a10_forcing", "unit_id:i time:t p:f t:f", lambda v: _forcing(v), "SELECT c.n AS unit_id, CAST(d AS TIMESTAMP) AS time, p, CASE WHEN year(d)>1997 THEN t END AS t FROM precip_daily p JOIN (SELECT basin, row_number() OVER (ORDER BY basin) AS n FROM (SELECT DISTINCT basin FROM precip_daily)) c ON c.basin=p.basin"),
    Query("a12_wide_long", "d:d reach:s value:f", lambda v: r.read_wide(v.flow_daily.groupBy("d").pivot("basin").agg(F.first("q")), "d"), "SELECT d, basin AS reach, q AS value FROM (SELECT DISTINCT d FROM flow_daily) CROSS JOIN (SELECT DISTINCT basin FROM flow_daily) LEFT JOIN flow_daily USING (basin, d)"),
    Query("a13_write_read", "seg:i down:i length:f unit_id:i", lambda v: _round_trip(v), "SELECT seg, down, length, unit_id FROM network"),
    Query("a14_matrix", "d:d " + " ".join(f"{b}:f" for b in BASINS), lambda v: r.unit_matrix(v.flow_daily, "d", "basin", "q", BASINS), "SELECT d, " + ", ".join(f"round(max(CASE WHEN basin='{b}' THEN q END)+1e-12,3) AS {b}" for b in BASINS) + " FROM flow_daily GROUP BY 1"),
]


def _forcing(v):
    path = scratch(v)
    ids = v.precip_daily.select("basin").distinct()
    ids = ids.withColumn("unit_id", F.row_number().over(Window.orderBy("basin")).cast("long"))  # a row a basin
    d = v.precip_daily.join(ids, "basin").select("unit_id", F.col("d").cast("timestamp_ntz").alias("time"), "p", "t")
    d.where("year(time) <= 1997").drop("t").write.parquet(f"{path}/a")
    d.where("year(time) >= 1998").write.parquet(f"{path}/b")
    return r.read_forcing(v.spark, f"{path}/*")


def _round_trip(v):
    path = scratch(v)
    r.write_table(v.network, f"{path}/net", "parquet", ["unit_id"])
    return v.spark.read.parquet(f"{path}/net")
