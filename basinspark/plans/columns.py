"""Queries over column functions."""

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import network as n
from .base import Query

CLASSES = {"metal": ["tin", "steel", "nickel", "brass", "copper"], "plated": ["plated"], "large": ["large", "economy"]}
KW = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p_type), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in CLASSES.items()) + " ELSE 'other' END"
TEX = """CASE WHEN t <= 0 THEN NULL
  WHEN s <= 45 AND i <= 40 AND y >= 40 THEN 'clay'
  WHEN s <= 20 AND i >= 40 AND i <= 60 AND y >= 40 AND y <= 60 THEN 'silty_clay'
  WHEN s >= 45 AND s <= 65 AND i <= 20 AND y >= 35 AND y <= 55 THEN 'sandy_clay'
  WHEN s >= 20 AND s <= 45 AND i >= 15 AND i <= 53 AND y >= 27 AND y <= 40 THEN 'clay_loam'
  WHEN s <= 20 AND i >= 40 AND i <= 73 AND y >= 27 AND y <= 40 THEN 'silty_clay_loam'
  WHEN s >= 45 AND s <= 80 AND i <= 28 AND y >= 20 AND y <= 35 THEN 'sandy_clay_loam'
  WHEN s >= 23 AND s <= 52 AND i >= 28 AND i <= 50 AND y >= 7 AND y <= 27 THEN 'loam'
  WHEN s <= 50 AND i >= 50 AND i <= 88 AND y <= 27 THEN 'silty_loam'
  WHEN s >= 50 AND s <= 80 AND i <= 50 AND y <= 20 THEN 'sandy_loam'
  WHEN s <= 20 AND i >= 80 AND y <= 12 THEN 'silt'
  WHEN s >= 70 AND s <= 90 AND i <= 30 AND y <= 15 THEN 'loamy_sand'
  WHEN s >= 85 AND i <= 15 AND y <= 10 THEN 'sand' END"""
TOKEN = "CASE WHEN p_size%7=0 THEN 'NA' WHEN p_size%7=1 THEN ' - ' WHEN p_size%7=2 THEN 'missing' WHEN p_size%7=3 THEN 'x1' ELSE CAST(p_size AS VARCHAR) END"

QUERIES = [
    Query("b01_standardise", "basin:s d:d airtemp:f pptrate:f", lambda v: c.standardise(v.precip_daily, {"airtemp": ("t", "K", "degC"), "pptrate": ("p", "mm/h", "mm/s")}), "SELECT basin, d, t-273.15 AS airtemp, p/3600.0 AS pptrate FROM precip_daily"),
    Query("b02_units", "basin:s d:d cms:f mm:f pa:f", lambda v: v.flow_daily.select("basin", "d", c.convert_units(F.col("q"), "cfs", "m3/s").alias("cms"), c.convert_units(F.col("q"), "in", "mm").alias("mm"), c.convert_units(F.col("q"), "hPa", "Pa").alias("pa")), "SELECT basin, d, q*0.028316846592::DOUBLE AS cms, q*25.4 AS mm, q*100 AS pa FROM flow_daily"),
    Query("b03_area", "basin:s d:d cms:f back:f", lambda v: v.flow_daily.select("basin", "d", c.mmday_to_cms(F.col("q"), F.lit(2600.0)).alias("cms")).withColumn("back", c.cms_to_mmday(F.col("cms"), F.lit(2600.0))), "SELECT basin, d, q*2600.0/86.4 AS cms, q AS back FROM flow_daily"),
    Query("b04_detect_unit", "basin:s unit:s scale:f", lambda v: c.detect_temperature_unit(v.precip_daily, ["basin"], "t").join(c.detect_storage_scale(v.precip_daily, ["basin"], "p"), "basin"), "SELECT basin, CASE WHEN avg(t)>100 THEN 'K' WHEN avg(t) BETWEEN -100 AND 60 THEN 'degC' END AS unit, CASE WHEN max(p)-min(p)>1000 THEN 0.1 WHEN max(p)-min(p)>10 THEN 10 ELSE 1 END AS scale FROM precip_daily GROUP BY basin"),
    Query("b05_infer_scale", "basin:s unit:s rmse:f", lambda v: c.infer_scale(v.pairs, ["basin"], {"mm": 1.0, "cm": 10.0, "in": 25.4}), "WITH e AS (SELECT basin, u, sqrt(avg(pow(sim*f-obs,2))) AS r FROM pairs, (VALUES ('mm',1.0),('cm',10.0),('in',25.4)) AS k(u,f) GROUP BY 1, 2) SELECT basin, u AS unit, r AS rmse FROM e QUALIFY row_number() OVER (PARTITION BY basin ORDER BY r, u)=1"),
    Query("b06_bbox", "cell_id:i", lambda v: c.bbox_filter(v.cells.withColumns({"lat": F.col("y") * 1.0, "lon": F.col("x") * 10.0 - 180}), 20, 150, 5, -150), "SELECT cell_id FROM cells WHERE y BETWEEN 5 AND 20 AND (x*10-180>=150 OR x*10-180<=-150)"),
    Query("b08_spinup_year", "basin:s d:d", lambda v: c.drop_spinup(v.flow_daily, ["basin"], "d", "first_year"), "SELECT basin, d FROM flow_daily QUALIFY year(d) > year(min(d) OVER (PARTITION BY basin))"),
    Query("b08_spinup_percent", "basin:s d:d", lambda v: c.drop_spinup(v.flow_daily, ["basin"], "d", "percent", 20), "SELECT basin, d FROM flow_daily QUALIFY d-min(d) OVER (PARTITION BY basin) >= floor((max(d) OVER (PARTITION BY basin)-min(d) OVER (PARTITION BY basin))*20/100)"),
    Query("b09_clean_numeric", "p_partkey:i value:f", lambda v: v.table("part").select("p_partkey", c.clean_numeric(F.expr(TOKEN.replace("VARCHAR", "STRING"))).alias("value")), "SELECT p_partkey, CASE WHEN p_size%7<4 THEN NULL ELSE p_size END AS value FROM part"),
    Query("b10_qc", "event_id:i value:f", lambda v: c.qc_filter(v.table("events").withColumn("qc", F.col("user_id") % 4), "qc", "<=", 1), "SELECT event_id, value FROM events WHERE user_id%4<=1"),
    Query("b11_clip", "basin:s d:d t:f p:f", lambda v: c.clip_ranges(v.precip_daily, {"t": (268.0, 274.0), "p": (1.0, 20.0)}), "SELECT basin, d, least(greatest(t,268),274) AS t, least(greatest(p,1),20) AS p FROM precip_daily"),
    Query("b11_counts", "basin:s t_below:i t_above:i p_below:i p_above:i", lambda v: c.range_counts(v.precip_daily, ["basin"], {"t": (268.0, 274.0), "p": (1.0, 20.0)}), "SELECT basin, count(*) FILTER (t<268) AS t_below, count(*) FILTER (t>274) AS t_above, count(*) FILTER (p<1) AS p_below, count(*) FILTER (p>20) AS p_above FROM precip_daily GROUP BY basin"),
    Query("b12_validate", "basin:s n:i q_missing:i temperature_bad:i flow_negative:i precipitation_large:i", lambda v: c.validate(v.wb.drop("d"), ["basin"], "t", "q", "p"), "SELECT basin, count(*) AS n, count(*) FILTER (q IS NULL) AS q_missing, count(*) FILTER (t NOT BETWEEN 200 AND 330) AS temperature_bad, count(*) FILTER (q<0) AS flow_negative, count(*) FILTER (p>1000) AS precipitation_large FROM wb GROUP BY basin"),
    Query("b13_parse_ts", "o_orderkey:i ts:t", lambda v: c.parse_ts(v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("ts")), "ts", least=0.95), "SELECT o_orderkey, date_trunc('day', o_orderdate) AS ts FROM orders"),
    Query("b14_round_hour", "event_id:i h:t", lambda v: v.table("events").select("event_id", c.round_hour(F.col("ts")).alias("h")), "SELECT event_id, CASE WHEN ts = date_trunc('hour', ts) + INTERVAL 30 MINUTE AND hour(ts)%2=0 THEN date_trunc('hour', ts) ELSE date_trunc('hour', ts + INTERVAL 30 MINUTE) END AS h FROM events"),
    Query("b15_time_codes", "event_id:i n:i back:t", lambda v: v.table("events").select("event_id", c.encode_time(F.date_trunc("second", "ts")).alias("n")).withColumn("back", c.decode_time(F.col("n"), "s", "1990-01-01")), "SELECT event_id, CAST(epoch(date_trunc('second', ts)-TIMESTAMP '1990-01-01') AS BIGINT) AS n, date_trunc('second', ts) AS back FROM events"),
    Query("b16_clean_name", "p_partkey:i name:s", lambda v: v.table("part").select("p_partkey", c.clean_name(F.concat("p_size", F.lit(" "), "p_type", F.lit(" (50%) & co."))).alias("name")), "SELECT p_partkey, substring('x' || regexp_replace(replace(replace(translate(lower(p_size || ' ' || p_type || ' (50%) & co.'), ' -./\\(),', '_____'), '&', 'and'), '%', 'percent'), '[^a-z0-9_]', '', 'g'), 1, 50) AS name FROM part"),
    Query("b17_keywords", "p_partkey:i cls:s", lambda v: v.table("part").select("p_partkey", c.classify_keywords(F.col("p_type"), CLASSES, "other").alias("cls")), f"SELECT p_partkey, {KW} AS cls FROM part"),
    Query("b18_bins", "p_partkey:i cls:s", lambda v: v.table("part").select("p_partkey", c.classify_bins(F.col("p_retailprice"), [1000.0, 1300.0], ["low", "middle", "high"]).alias("cls")), "SELECT p_partkey, CASE WHEN p_retailprice<1000 THEN 'low' WHEN p_retailprice<1300 THEN 'middle' ELSE 'high' END AS cls FROM part"),
    Query("b19_texture", "p_partkey:i texture:s", lambda v: v.table("part").select("p_partkey", c.usda_texture(F.col("p_size") * 1.0, (F.col("p_partkey") % 37) * 1.0, (F.col("p_partkey") % 23) * 1.0).alias("texture")), f"SELECT p_partkey, {TEX} AS texture FROM (SELECT p_partkey, t, 100*a/t AS s, 100*b/t AS i, 100*e/t AS y FROM (SELECT p_partkey, p_size*1.0::DOUBLE AS a, (p_partkey%37)*1.0::DOUBLE AS b, (p_partkey%23)*1.0::DOUBLE AS e, a+b+e AS t FROM part))"),
    Query("b20_aspect", "cell_id:i sector:i", lambda v: v.cells.select("cell_id", c.aspect_class(F.pmod(F.col("cell_id") * 7.0, F.lit(360.0)), 8, F.col("cls") == 3).alias("sector")), "SELECT cell_id, CASE WHEN cls=3 THEN 0 ELSE floor(((cell_id*7)%360+22.5)%360/45)+1 END AS sector FROM cells"),
    Query("b21_hydrogeology", "cell_id:i k_md:f sy:f response_days:f", lambda v: v.cells.select("cell_id", *[x.alias(n) for n, x in c.hydrogeology(-10 - F.col("cls") / 4.0, F.col("cls") / 40.0).items()]), "SELECT cell_id, pow(10, -10-cls/4.0::DOUBLE)*1e7*86400 AS k_md, 0.2*cls/40.0 AS sy, 1e6/(pow(10, -10-cls/4.0::DOUBLE)*1e7/1e-4*86400) AS response_days FROM cells"),
    Query("b22_soil", "cell_id:i mean:f", lambda v: v.cells.select("cell_id", c.depth_weighted([F.when(F.col("cls") % 3 != i % 3, F.col("elev") * (i + 1)) for i in range(6)]).alias("mean")), "SELECT cell_id, (" + "+".join(f"CASE WHEN cls%3<>{i % 3} THEN elev*{i + 1}*{t} ELSE 0 END" for i, t in enumerate((5, 10, 15, 30, 40, 100))) + ")/200 AS mean FROM cells"),
    Query("b23_scale", "cell_id:i v:f", lambda v: v.cells.select("cell_id", c.apply_scale(F.col("cls").cast("double"), 0.1, 2.0, 5.0, -1.0).alias("v")), "SELECT cell_id, CASE WHEN cls=5 THEN -1 ELSE cls*0.1+2 END AS v FROM cells"),
    Query("b24_dedup", "site:i variable:s ts:t value:f", lambda v: c.dedup(v.obs_event, ["site", "variable"], [F.col("value").desc(), F.col("ts")]), "SELECT site, variable, ts, value FROM obs_event QUALIFY row_number() OVER (PARTITION BY site, variable ORDER BY value DESC, ts)=1"),
    Query("b25_renumber", "cell_id:i new_id:i", lambda v: c.renumber(v.cells, ["cls", "elev", "cell_id"]), "SELECT cell_id, row_number() OVER (ORDER BY cls, elev, cell_id) AS new_id FROM cells"),
    Query("b28_normalise", "id:i n:f back:f", lambda v: v.solutions.select("id", "f1", c.normalise(F.col("f1"), F.lit(900.0), F.lit(1500.0)).alias("n")).withColumn("back", c.denormalise(F.col("n"), F.lit(900.0), F.lit(1500.0))), "SELECT id, greatest(0, least(1, (f1-900)/600)) AS n, 900+greatest(0, least(1, (f1-900)/600))*600 AS back FROM solutions"),
    Query("b22_hydraulics", "cell_id:i sand:f clay:f silt:f porosity:f field_capacity:f wilting_point:f available_water:f log_ksat:f",
          lambda v: v.cells.select("cell_id", *[x.alias(k) for k, x in c.soil_hydraulics([F.when(F.col("cls") % 3 != i % 3, F.col("elev") / 10 + i) for i in range(6)], [F.col("cls") + i for i in range(6)], [F.col("cls") * 2 - i for i in range(6)]).items()]).withColumn("log_ksat", F.log10("ksat")),
          "WITH m AS (SELECT cell_id, (" + "+".join(f"CASE WHEN cls%3<>{i % 3} THEN (elev/10+{i})*{t} ELSE 0 END" for i, t in enumerate((5, 10, 15, 30, 40, 100))) + ")/200 AS sand, (" + "+".join(f"(cls+{i})*{t}" for i, t in enumerate((5, 10, 15, 30, 40, 100))) + ")/200.0 AS clay, (" + "+".join(f"(cls*2-{i})*{t}" for i, t in enumerate((5, 10, 15, 30, 40, 100))) + ")/200.0 AS silt FROM cells), h AS (SELECT *, 0.46-0.0026*clay AS porosity, 0.2576-0.002*sand+0.0036*clay+0.0299*silt AS field_capacity, 0.026+0.005*clay+0.0158*silt AS wilting_point FROM m) SELECT *, field_capacity-wilting_point AS available_water, log10(10*2.54*2.778e-6)+3.0*porosity-8.5 AS log_ksat FROM h"),
    Query("b26_fractions", "unit_id:i cls:i f:f", lambda v: c.clean_fractions(_fractions(v), ["unit_id"], "cls", "f", 0.05), "WITH n AS (SELECT unit_id, cls, count(*)*1.0/sum(count(*)) OVER (PARTITION BY unit_id) AS f FROM inzone GROUP BY 1, 2), z AS (SELECT unit_id, cls, CASE WHEN f<0.05 THEN 0 ELSE f END AS f FROM n) SELECT unit_id, cls, CASE WHEN sum(f) OVER (PARTITION BY unit_id)>0 THEN f/sum(f) OVER (PARTITION BY unit_id) ELSE f END AS f FROM z"),
    Query("b27_network_defaults", "seg:i down:i length:f", lambda v: n.prepare_network(v.network.withColumn("length", F.when(F.col("seg") % 10 != 0, F.col("length"))), [7, 11, 13]), "SELECT seg, CASE WHEN seg IN (7,11,13) THEN 0 ELSE down END AS down, CASE WHEN seg%10=0 OR length=0 THEN 1 ELSE length END AS length FROM network"),
    Query("b08_spinup_until", "basin:s d:d", lambda v: c.drop_spinup(v.flow_daily, ["basin"], "d", "until", "1993-06-30"), "SELECT basin, d FROM flow_daily WHERE d > DATE '1993-06-30'"),
    Query("b08_spinup_one_year", "basin:s d:d", lambda v: c.drop_spinup(v.flow_daily, ["basin"], "d", "one_year"), "SELECT basin, d FROM flow_daily QUALIFY d >= min(d) OVER (PARTITION BY basin) + INTERVAL 1 YEAR"),
    Query("b06_point", "ts:i lat:f lon:f elev:f", lambda v: c.bbox_mean(v.cells.selectExpr("y % 3 AS ts", "y * 0.1D AS lat", "x * 0.25D AS lon", "elev"), ["ts"], ["elev"], 0.34, 5.0, 0.33, 5.02), "SELECT y%3 AS ts, avg(y*0.1) AS lat, avg(x*0.25) AS lon, avg(elev) AS elev FROM cells WHERE y*0.1::DOUBLE BETWEEN 0.285 AND 0.385 AND x*0.25::DOUBLE BETWEEN 4.96 AND 5.06 GROUP BY 1"),
    Query("b06_grown", "ts:i lat:f lon:f elev:f", lambda v: c.bbox_mean(v.cells.selectExpr("y % 3 AS ts", "y * 1.0D AS lat", "x * 0.25D AS lon", "elev"), ["ts"], ["elev"], 2.2, 5.1, 2.15, 5.12), "SELECT y%3 AS ts, avg(y) AS lat, avg(x*0.25) AS lon, avg(elev) AS elev FROM cells WHERE y=2 AND x*0.25::DOUBLE BETWEEN 4.9 AND 5.32 GROUP BY 1"),
    Query("b26_classes", "unit_id:i cls:i f:f", lambda v: c.complete_fractions(_fractions(v), "unit_id", "cls", "f", 20, 0.05), "WITH n AS (SELECT unit_id, cls, count(*)*1.0/sum(count(*)) OVER (PARTITION BY unit_id) AS f FROM inzone GROUP BY 1, 2), z AS (SELECT unit_id, cls, CASE WHEN f<0.05 THEN 0 ELSE f END AS f FROM n), w AS (SELECT unit_id, cls, CASE WHEN sum(f) OVER (PARTITION BY unit_id)>0 THEN f/sum(f) OVER (PARTITION BY unit_id) ELSE f END AS f FROM z), e AS (SELECT DISTINCT unit_id, k AS cls FROM n, (SELECT unnest(range(1,21)) AS k)) SELECT e.unit_id, e.cls, CASE WHEN e.unit_id=(SELECT min(unit_id) FROM n) THEN greatest(coalesce(f,0),1e-5) ELSE coalesce(f,0) END AS f FROM e LEFT JOIN w ON w.unit_id=e.unit_id AND w.cls=e.cls"),
    Query("b26_majority", "cell_id:i cls:i", lambda v: c.fill_majority(v.cells.selectExpr("cell_id", "CASE WHEN cell_id % 7 = 0 THEN 0 WHEN cell_id % 11 = 0 THEN NULL ELSE cls END AS cls"), "cls"), "WITH d AS (SELECT cell_id, CASE WHEN cell_id%7=0 THEN 0 WHEN cell_id%11=0 THEN NULL ELSE cls END AS cls FROM cells) SELECT cell_id, coalesce(nullif(cls,0), (SELECT cls FROM d WHERE cls<>0 GROUP BY 1 ORDER BY count(*) DESC, cls LIMIT 1)) AS cls FROM d"),
]


def _fractions(v):
    from ..operators.spatial import cells_in_zones

    from pyspark.sql import Window as W

    n = cells_in_zones(v.cells, v.zones).groupBy("unit_id", "cls").agg(F.count("*").alias("n"))
    return n.select("unit_id", "cls", (F.col("n") / F.sum("n").over(W.partitionBy("unit_id"))).alias("f"))
