"""Queries over the user-code surface and a few that join several modules."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import extensions as x
from ..operators import metrics as m
from ..operators import spatial as s
from ..operators import timeseries as t
from .base import Query


def _values(col):
    return lambda d: d.select("basin", "d", F.col(col).alias("value"))


x.register_target("streamflow", x.Target(_values("q"), _values("q"), ["basin", "d"], lambda: [m.kge(), m.nse()]))

QUERIES = [
    Query("b07_periods", "basin:s d:d period:s", lambda v: m.label_periods(v.flow_daily, "d", {"Calib_": ("1996-01-01", "1998-06-30"), "Eval_": ("1998-01-01", "1999-12-31")}), "SELECT basin, d, 'Calib_' AS period FROM flow_daily WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' UNION ALL SELECT basin, d, 'Eval_' FROM flow_daily WHERE d BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"),
    Query("c09_timezone", "event_id:i wall:t back:t", lambda v: v.table("events").select("event_id", t.to_naive_local(F.col("ts"), "Asia/Tokyo").alias("wall")).withColumn("back", t.to_naive_utc(F.col("wall"), "Asia/Tokyo")), "SELECT event_id, ts + INTERVAL 9 HOUR AS wall, ts AS back FROM events"),
    Query("e17_lithology", "unit_id:i kind:s fraction:f dominant:s shannon:f", lambda v: s.lithology(s.cells_in_zones(v.cells, v.zones).join(v.table("part").select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).otherwise(" ").alias("kind")), "cell_id"), ["unit_id"], "kind", "elev"), "WITH a AS (SELECT unit_id, regexp_replace(translate(lower(p_brand), ' -./\\(),', '_____'), '[^a-z0-9_]', '', 'g') AS kind, sum(elev) AS a FROM inzone JOIN part ON p_partkey=cell_id WHERE p_partkey%9<>0 GROUP BY 1, 2), f AS (SELECT *, a/sum(a) OVER (PARTITION BY unit_id) AS f FROM a) SELECT unit_id, kind, f AS fraction, first(kind) OVER (PARTITION BY unit_id ORDER BY a DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dominant, -sum(f*ln(f)) OVER (PARTITION BY unit_id) AS shannon FROM f"),
    Query("e39_class_pairs", "unit_id:i cls:i soil:i slc:i fraction:f", lambda v: s.class_pairs(s.class_fractions(s.cells_in_zones(v.cells, v.zones), ["unit_id"], "cls").withColumn("soil", F.col("dominant") % 4), ["unit_id"], "cls", "soil", "fraction", 0.06), "WITH n AS (SELECT unit_id, cls, count(*) AS n FROM inzone GROUP BY 1, 2), f AS (SELECT *, n/sum(n) OVER (PARTITION BY unit_id) AS f, first(cls) OVER (PARTITION BY unit_id ORDER BY n DESC, cls ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)%4 AS soil FROM n), k AS (SELECT * FROM f WHERE f>0.06) SELECT unit_id, cls, soil, dense_rank() OVER (ORDER BY cls, soil) AS slc, f/sum(f) OVER (PARTITION BY unit_id) AS fraction FROM k"),
    Query("u01_custom_stats", "unit_id:i span:f third:f", lambda v: x.custom_stats(s.cells_in_zones(v.cells, v.zones), ["unit_id"], "elev", {"span": lambda a: a.max() - a.min(), "third": lambda a: np.sort(a.to_numpy())[2]}), "SELECT unit_id, max(elev)-min(elev) AS span, list_sort(list(elev))[3] AS third FROM inzone GROUP BY 1"),
    Query("u02_target", "basin:s kge:f nse:f", lambda v: x.evaluate("streamflow", v.flow_daily, v.sim_daily, ["basin"]), "SELECT basin, 1-sqrt(pow(corr(sim, obs)-1,2)+pow(stddev_samp(sim)/stddev_samp(obs)-1,2)+pow(avg(sim)/avg(obs)-1,2)) AS kge, 1-sum((sim-obs)*(sim-obs))/(var_pop(obs)*count(*)) AS nse FROM pairs GROUP BY basin"),
    Query("u03_per_unit", "basin:s n:i last:f", lambda v: x.per_unit(v.flow_daily, ["basin"], lambda p: p.sort_values("d").tail(1).assign(n=len(p), last=lambda a: a.q)[["basin", "n", "last"]], "basin string, n long, last double"), "SELECT basin, count(*) AS n, arg_max(q, d) AS last FROM flow_daily GROUP BY 1"),
]
