"""Queries over the readers: rows of the given tables are written in each layout and read back."""

import os

from pyspark.sql import functions as F

from ..operators import experiments as x
from ..operators import layers
from ..scratch import stored
from ..sources import readers as r
from .base import Query


def folder(v) -> str:
    """A new folder next to the tables that the shared folder holds."""
    return os.path.dirname(stored(v.spark.range(1)).inputFiles()[0]) + "-layout"


def csv(df, path: str, **options) -> str:
    df.write.options(header="true", **options).csv(path)
    return path


def a_file_a_site(df, site: str, path: str, name: str) -> str:
    """CSV files named after their sites, one each: the series of a site is small, the sites are few."""
    df.repartition(site).write.partitionBy(site).option("header", "true").csv(f"{path}/parts")
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{path}/files"))
    for part in fs.listStatus(hadoop(f"{path}/parts")):
        if part.isDirectory():
            for f in fs.listStatus(part.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), hadoop(f"{path}/files/{name.format(part.getPath().getName().split('=')[1])}"))
    return f"{path}/files"


def noted(v, path: str, header: str) -> None:
    """One more file: a comment above the header."""
    v.spark.createDataFrame([(f"# a note\n{header}\n# another",)], ["value"]).coalesce(1).write.mode("append").text(path)


def text(c, form="yyyy-MM-dd"):
    return F.date_format(c, form)


def obs(v):
    d = v.flow_daily.select("basin", F.col("d").alias("Date"), F.when(F.dayofmonth("d") == 15, "NA").otherwise(F.col("q").cast("string")).alias("discharge_cms"))
    return r.read_obs(v.spark, a_file_a_site(d, "basin", folder(v), "{}.csv"), "streamflow")


def rdb(v):
    names = ["agency_cd", "site_no", "datetime", "tz_cd", "1_00060", "1_00060_cd"]
    rows = v.flow_daily.select(F.lit("AG"), "basin", F.when(F.dayofmonth("d") % 2 == 0, text("d")).otherwise(text("d", "yyyy-MM-dd 06:30")), F.lit("MST"), F.when(F.dayofmonth("d") == 15, "Ice").otherwise(F.col("q").cast("string")), F.lit("A")).toDF(*names)
    form = v.spark.createDataFrame([("5s", "15s", "20d", "6s", "14n", "10s")], names)
    path = csv(rows.unionByName(form), folder(v), sep="\t")
    noted(v, path, "\t".join(names))
    return r.read_rdb(v.spark, path)


def utc(v):
    d = v.table("events").select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ISO 8601 UTC"), F.when(F.col("event_type") == "error", "missing").otherwise(F.col("value").cast("string")).alias("Value"))
    path = csv(d, folder(v))
    noted(v, path, "ISO 8601 UTC,Value")
    return r.read_utc_csv(v.spark, path)


def split_date(v):
    d = v.flow_daily.select(F.year("d").alias("YYYY"), F.month("d").alias("MM"), F.dayofmonth("d").alias("DD"), F.col("q").alias("qobs"), F.col("basin").alias("qc_flag"))
    return r.read_split_date_csv(v.spark, csv(d, folder(v), sep=";"))


def service(v):
    """A document a basin and year; the second block of values and the variables of other names are passed over."""
    point = F.struct(text("d", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.col("q").cast("string").alias("value"), F.array(F.col("basin"), F.lit("A")).alias("qualifiers"))
    d = v.flow_daily.groupBy("basin", F.year("d")).agg(F.collect_list(point).alias("points"))
    name = F.when(F.col("basin") == "AUTOMOBILE", "Discharge").when(F.col("basin") == "BUILDING", "Depth to water").otherwise("Water LEVEL")
    block = F.struct(F.col("points").alias("value"))
    series = F.struct(F.struct(name.alias("variableName"), F.struct(F.lit("ft").alias("unitCode")).alias("unit")).alias("variable"), F.array(block, block).alias("values"))
    return r.flatten_service_json(d.select(F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value"))).alias("j")), "j")


def snow(v):
    d = v.flow_daily.groupBy("d").agg(F.sum("q").alias("q"))
    lines = d.select(F.concat_ws(",", text("d", "dd/MM/yyyy"), F.lit("1"), F.when(F.dayofmonth("d") == 15, "-1").otherwise(F.col("q").cast("string"))).alias("value"))
    head = v.spark.createDataFrame([("words of a station",), ("Date,Depth,A Snow Water Equivalent (mm)",)], ["value"])
    path = folder(v)
    head.coalesce(1).unionByName(lines).write.text(path)
    return r.read_snow_csv(v.spark, path)


def runoff(v):
    d = v.flow_daily.groupBy("d").agg(F.sum("q").alias("q"))
    d = d.select(F.when(F.month("d") > 6, text("d", "dd/MM/yyyy")).otherwise(text("d")).alias("date"), F.when(F.dayofmonth("d") == 15, "none").otherwise(F.col("q").cast("string")).alias("discharge"))
    return r.read_runoff_csv(v.spark, csv(d, folder(v)), 250.0)


def flux(v):
    d = v.flow_daily.select("basin", text("d", "yyyyMMdd").alias("TIMESTAMP"), F.when(F.dayofmonth("d") == 15, "NaN").otherwise(F.col("q").cast("string")).alias("LE_F_MDS"), F.month("d").alias("LE_F_MDS_QC"))
    return r.read_flux(v.spark, a_file_a_site(d, "basin", folder(v), "FLX_{}_DD.csv"), "BUILDING")


def numbered(v):
    c = v.table("customer").select("c_custkey", "c_nationkey")
    d = v.table("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("unit_id"), F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 10000.0).alias("flow"))
    micros = F.unix_micros(F.col("d").cast("timestamp"))
    d = d.select("unit_id", F.dayofyear("d").alias("index"), F.when(F.col("unit_id") % 2 == 0, (micros * 1000).cast("string")).otherwise(text("d", "yyyy-MM-dd HH:mm:ss")).alias("Time"), "flow")
    return r.read_numbered(v.spark, a_file_a_site(d, "unit_id", folder(v), "nex-{}_output.csv"))


def combinations(v):
    """Option lists are short by their nature: here the distinct values of three flag columns."""
    lists = {c: sorted(y[0] for y in v.table(t).select(c).distinct().collect()) for t, c in (("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("customer", "c_mktsegment"))}
    return x.combinations(v.spark, lists)


def closest(v):
    d = v.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("sm_5_a"), F.col("l_discount").alias("sm_20.5_b"), F.col("l_tax").alias("sm_50_c"), F.col("l_extendedprice").alias("st_18_d"))
    return d.select("l_orderkey", "l_linenumber", F.col(f"`{layers.closest_column(d.columns, 18)}`").alias("sm"))


DAILY = "SELECT d, sum(q) AS q FROM flow_daily GROUP BY 1"

QUERIES = [
    Query("a01_obs_csv", "site:s ts:t value:f", obs, "SELECT basin AS site, CAST(d AS TIMESTAMP) AS ts, CASE WHEN day(d)<>15 THEN q END AS value FROM flow_daily"),
    Query("a02_rdb", "site:s ts:t value:f", rdb, "SELECT basin AS site, CASE WHEN day(d)%2=0 THEN CAST(d AS TIMESTAMP) ELSE CAST(d AS TIMESTAMP) + INTERVAL 390 MINUTE END AS ts, CASE WHEN day(d)<>15 THEN q*0.028316846592::DOUBLE END AS value FROM flow_daily"),
    Query("a03_utc_csv", "ts:t value:f", utc, "SELECT timezone('America/Edmonton', timezone('UTC', date_trunc('second', ts))) AS ts, CASE WHEN event_type<>'error' THEN value END AS value FROM events"),
    Query("a04_split_date", "d:d value:f qc_flag:s", split_date, "SELECT d, q AS value, basin AS qc_flag FROM flow_daily"),
    Query("a06_service_json", "ts:t level:f unit:s qualifier:s", service, "SELECT CAST(d AS TIMESTAMP) AS ts, q AS level, 'ft' AS unit, basin||',A' AS qualifier FROM flow_daily WHERE basin<>'AUTOMOBILE'"),
    Query("a07_snow_csv", "d:d swe:f", snow, f"SELECT d, CASE WHEN day(d)<>15 THEN q END AS swe FROM ({DAILY})"),
    Query("a08_runoff_csv", "d:d q:f", runoff, f"SELECT d, q*250*1000/86400 AS q FROM ({DAILY}) WHERE day(d)<>15"),
    Query("a09_flux_csv", "ts:t et:f qc:i", flux, "SELECT CAST(d AS TIMESTAMP) AS ts, CASE WHEN day(d)<>15 THEN q*0.0353::DOUBLE END AS et, month(d) AS qc FROM flow_daily WHERE basin='BUILDING'"),
    Query("a11_numbered_csv", "unit_id:i ts:t flow:f", numbered, "SELECT c_nationkey AS unit_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, sum(o_totalprice)/10000.0 AS flow FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1, 2"),
    Query("d26_combinations", "o_orderstatus:s l_linestatus:s c_mktsegment:s", combinations, "SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT DISTINCT c_mktsegment FROM customer)"),
    Query("g06_closest_column", "l_orderkey:i l_linenumber:i sm:f", closest, "SELECT l_orderkey, l_linenumber, l_discount AS sm FROM lineitem"),
]
