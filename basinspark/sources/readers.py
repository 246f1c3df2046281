"""Readers of gauge, snow, flux and model tables, and sinks. Every reader takes a path that Spark reads and returns long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_numeric, convert_units

# Words in the value column's name by target.
VALUE_WORDS = {"streamflow": ["flow", "discharge", "q_", "streamflow"], "et": ["et", "le"], "sm": ["sm_"], "swe": ["swe", "snow water equivalent"], "tws": ["tws"]}
CFS = ("cfs", "m3/s")


def _named(columns: list[str], words: list[str]) -> str:
    for c in columns:
        if any(w in c.lower() for w in words):
            return c
    raise ValueError(f"no column named like {', '.join(words)} in {', '.join(columns)}")


def _date(c, *formats: str):
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], c.try_cast("timestamp")).cast("timestamp_ntz")


def read_obs(spark: SparkSession, path: str, target: str) -> DataFrame:
    """(site, ts, value) of CSV files with a header; site is the file's name; text that is no number is null."""
    d = spark.read.csv(path, header=True)
    ts, value = _named(d.columns, ["date", "time"]), _named(d.columns, VALUE_WORDS[target])
    return d.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("site"), _date(F.col(ts)).alias("ts"), clean_numeric(F.col(value)).alias("value"))


def read_rdb(spark: SparkSession, path: str, param: str = "00060") -> DataFrame:
    """Tab-separated service files: # comments, a format row below the header; cubic feet become cubic metres."""
    d = spark.read.csv(path, header=True, sep="\t", comment="#")
    value = next((c for c in d.columns if param in c and not c.endswith("_cd")), d.columns[4])
    site = "site_no" if "site_no" in d.columns else d.columns[1]
    rows = d.where(~F.col(site).rlike(r"^\d+s$"))
    return rows.select(F.col(site).alias("site"), _date(F.col("datetime"), "yyyy-MM-dd HH:mm", "yyyy-MM-dd").alias("ts"), convert_units(clean_numeric(F.col(value)), *CFS).alias("value"))


def read_utc_csv(spark: SparkSession, path: str, zone: str = "America/Edmonton") -> DataFrame:
    """Columns `ISO 8601 UTC` and `Value` below # comments; times become wall time of the zone, null where they are no times."""
    d = spark.read.csv(path, header=True, comment="#")
    utc = F.to_utc_timestamp(F.regexp_replace(F.col("`ISO 8601 UTC`"), "(Z|[+]00:00)$", "").try_cast("timestamp_ntz").cast("timestamp"), "UTC")
    return d.select(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")).alias("ts"), clean_numeric(F.col("Value")).alias("value"))


def read_split_date_csv(spark: SparkSession, path: str) -> DataFrame:
    """`;` separated YYYY, MM, DD, qobs, qc_flag below one header line."""
    d = spark.read.csv(path, sep=";", header=True, schema="YYYY int, MM int, DD int, qobs double, qc_flag string", enforceSchema=True)
    return d.select(F.make_date("YYYY", "MM", "DD").alias("d"), F.col("qobs").alias("value"), "qc_flag")


def unpivot_monthly(df: DataFrame) -> DataFrame:
    """(station, d, flow, symbol) from rows of a station and month with FLOW1..FLOW31 and SYMBOL1..SYMBOL31."""
    days = F.array(*[F.struct(F.lit(i).alias("day"), F.col(f"FLOW{i}").cast("double").alias("flow"), F.col(f"SYMBOL{i}").alias("symbol")) for i in range(1, 32)])
    d = df.select(F.col("STATION_NUMBER").alias("station"), F.make_date("YEAR", "MONTH", F.lit(1)).alias("m"), F.explode(days).alias("x"))
    return d.where("x.flow IS NOT NULL AND x.day <= day(last_day(m))").select("station", F.date_add("m", F.col("x.day") - 1).alias("d"), "x.flow", "x.symbol")


SERVICE = "struct<value:struct<timeSeries:array<struct<variable:struct<variableName:string,unit:struct<unitCode:string>>,values:array<struct<value:array<struct<dateTime:string,value:string,qualifiers:array<string>>>>>>>>>"


def flatten_service_json(df: DataFrame, col: str) -> DataFrame:
    """(ts, level, unit, qualifier) of groundwater series: variables named level or depth, the first block of values only."""
    d = df.select(F.explode(F.from_json(col, SERVICE)["value"]["timeSeries"]).alias("s")).where(F.lower("s.variable.variableName").rlike("level|depth"))
    v = d.select("s.variable.unit.unitCode", F.explode(F.get(F.col("s.values"), F.lit(0))["value"]).alias("v"))
    return v.select(_date(F.col("v.dateTime")).alias("ts"), clean_numeric(F.col("v.value")).alias("level"), F.col("unitCode").alias("unit"), F.array_join("v.qualifiers", ",").alias("qualifier"))


def read_snow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily snow water from CSV with a preamble before the line that begins with Date; d/m/Y or ISO dates by their first
    sample. The header is the first such line: it names the columns of every file under the path."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("Date")).first()
    if head is None:
        raise ValueError("no line begins with Date")
    names = [c.strip() for c in head.value.split(",")]
    at = next(i for i, c in enumerate(names) if "Snow Water Equivalent" in c)
    cells = F.split("value", ",")
    d = lines.where(F.col("value").rlike(r"^\s*\d")).select(F.trim(cells[0]).alias("d"), cells[at].alias("v"))
    first = d.first()
    day_first = first is not None and "/" in first.d
    return d.select((F.try_to_timestamp("d", F.lit("d/M/yyyy")) if day_first else F.col("d").try_cast("timestamp")).cast("date").alias("d"), clean_numeric(F.col("v"), 0.0).alias("swe"))


def read_runoff_csv(spark: SparkSession, path: str, area_km2: float) -> DataFrame:
    """Runoff in mm a day as flow: mm * km2 * 1000 / 86400; dates day-first, then ISO; rows without a number are dropped."""
    d = spark.read.csv(path, header=True)
    ts, value = _named(d.columns, ["date"]), _named(d.columns, ["discharge", "m3s", "flow"])
    out = d.select(_date(F.col(ts), "d/M/yyyy", "yyyy-MM-dd").cast("date").alias("d"), (clean_numeric(F.col(value)) * area_km2 * 1000 / 86400).alias("q"))
    return out.dropna()


def read_flux(spark: SparkSession, folder: str, station: str) -> DataFrame:
    """Daily evapotranspiration of the files that name the station: its own column, else latent heat times 0.0353."""
    d = spark.read.option("pathGlobFilter", f"*{station}*").csv(folder, header=True)
    et = next((c for c in d.columns if c.upper().startswith("ET")), None)
    le = next((c for c in d.columns if c == "LE_F_MDS"), None)
    value = F.coalesce(*[x for x in (clean_numeric(F.col(et)) if et else None, clean_numeric(F.col(le)) * 0.0353 if le else None) if x is not None])
    qc = F.col("LE_F_MDS_QC").try_cast("int") if "LE_F_MDS_QC" in d.columns else F.lit(0)
    return d.select(_date(F.col(_named(d.columns, ["timestamp", "date"])), "yyyyMMddHHmm", "yyyyMMdd").alias("ts"), value.alias("et"), qc.alias("qc"))


def read_forcing(spark: SparkSession, path: str) -> DataFrame:
    """Forcing in Parquet, columns of all files united, one row a unit and time."""
    d = spark.read.option("mergeSchema", "true").parquet(path)
    return d.dropDuplicates([c for c in ("unit_id", "cell_id", "time") if c in d.columns])


def read_numbered(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(unit_id, ts, flow) of files `nex-<id>_output.csv`, with or without a header (index, time, flow)."""
    d = spark.read.csv(path, header=header)
    if not header:
        d = d.toDF("index", "time", "flow", *d.columns[3:])
    ts, value = _named(d.columns, ["time", "date"]), _named(d.columns, ["flow", "discharge", "q_"])
    t = F.when(F.col(ts).rlike(r"^\d{15,}$"), F.timestamp_micros((F.col(ts).try_cast("long") / 1000).cast("long"))).otherwise(F.col(ts).try_cast("timestamp"))
    return d.select(F.regexp_extract("_metadata.file_name", r"nex-(\d+)", 1).cast("long").alias("unit_id"), t.cast("timestamp_ntz").alias("ts"), clean_numeric(F.col(value)).alias("flow"))


def read_wide(df: DataFrame, ts: str, ids: list[str] | None = None) -> DataFrame:
    """(ts, reach, value) from one column a reach."""
    ids = ids or [c for c in df.columns if c != ts]
    return df.unpivot(ts, ids, "reach", "value")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path)


def unit_matrix(df: DataFrame, ts: str, unit: str, value: str, units: list) -> DataFrame:
    """One column a unit, rounded to 3 decimals, in time order."""
    p = df.groupBy(ts).pivot(unit, units).agg(F.first(value))
    return p.select(ts, *[F.round(F.col(f"`{u}`"), 3).alias(str(u)) for u in units])
