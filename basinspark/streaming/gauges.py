"""Gauge streams: windows, sessions, duplicates, joins and running metrics in event time.

Watermarks need a timestamp with time zone: NTZ columns are cast first (`event_time`)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def stream_source(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """Files that appear under the path, each read once; the query's checkpoint remembers which."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_resample(df: DataFrame, keys: list[str], ts: str, col: str, freq: str, delay: str) -> DataFrame:
    g = event_time(df, ts).withWatermark(ts, delay).groupBy(*keys, F.window(ts, freq).alias("_w")).agg(F.avg(col).alias(col), F.count(col).alias("n"))
    return g.select(*keys, F.col("_w.start").alias(ts), col, "n")


def stream_sliding(df: DataFrame, keys: list[str], ts: str, col: str, size: str, slide: str, delay: str) -> DataFrame:
    g = event_time(df, ts).withWatermark(ts, delay).groupBy(*keys, F.window(ts, size, slide).alias("_w")).agg(F.avg(col).alias(col))
    return g.select(*keys, F.col("_w.start").alias(ts), col)


def stream_sessions(df: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Runs without a gap as long as `gap`: first and last time and rows."""
    g = event_time(df, ts).withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.drop("_w")


def stream_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Running skill metrics of streamed pairs, kept as moments."""
    from ..operators.metrics import metrics

    return metrics(pairs, keys)


MOMENTS = ["n", "o", "s", "oo", "ss", "os"]  # pairs, sums, squares and products
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UnitMoments(StatefulProcessor):
    """Sums of one unit's pairs, each batch added to what the store holds; a timer closes a unit that has been idle in event time."""

    def __init__(self, keys: list[str], ts: str, idle_ms: int):
        self.keys, self.ts, self.idle_ms = keys, ts, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:]) + ", last long")

    def _row(self, key: tuple, values: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{m: [v] for m, v in zip(MOMENTS, values, strict=False)}, "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues):
        have = tuple(self.sums.get()) if self.sums.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        for pdf in rows:
            d = pdf.dropna(subset=["obs", "sim"])
            o, s = d["obs"].to_numpy(float), d["sim"].to_numpy(float)
            late = int(pdf[self.ts].max().timestamp() * 1000) if len(pdf) else 0
            have = (have[0] + len(d), *(float(a + b) for a, b in zip(have[1:6], (o.sum(), s.sum(), (o * o).sum(), (s * s).sum(), (o * s).sum()), strict=True)), max(have[6], late))
        self.sums.update(have)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(have[6] + self.idle_ms)
        yield self._row(key, have, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        have = tuple(self.sums.get())
        self.sums.clear()
        yield self._row(key, have, True)

    def close(self) -> None:
        pass


def stream_moments(pairs: DataFrame, keys: list[str], ts: str, delay: str, idle_ms: int) -> DataFrame:
    """Running sums (MOMENTS) of streamed pairs (keys, ts, obs, sim) for each unit, in update mode: a row whenever a unit got pairs,
    and a last one (closed) once event time has passed its newest pair by `idle_ms`, when its state is dropped.

    Needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass` = ROCKS. Pairs with a null count as none.
    """
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    d = event_time(pairs, ts).withWatermark(ts, delay).select(*keys, ts, "obs", "sim")
    return d.groupBy(*keys).transformWithStateInPandas(UnitMoments(keys, ts, idle_ms), f"{kinds}, n long, " + ", ".join(f"{m} double" for m in MOMENTS[1:]) + ", closed boolean", outputMode="Update", timeMode="EventTime")


def moment_metrics(d: DataFrame) -> DataFrame:
    """rmse, pbias, nse and kge from sums of pairs; null where a side does not vary or sums to 0."""
    n, none = F.col("n"), lambda c: F.nullif(c, F.lit(0.0))
    vo, vs, cov = F.col("oo") - F.col("o") ** 2 / n, F.col("ss") - F.col("s") ** 2 / n, F.col("os") - F.col("o") * F.col("s") / n
    square = F.greatest(F.lit(0.0), F.col("ss") - 2 * F.col("os") + F.col("oo"))
    parts = [cov / none(F.sqrt(F.greatest(F.lit(0.0), vo * vs))), F.sqrt(F.greatest(F.lit(0.0), vs) / none(F.greatest(F.lit(0.0), vo))), F.col("s") / none(F.col("o"))]
    off = sum(((p - 1) ** 2 for p in parts[1:]), (parts[0] - 1) ** 2)
    return d.withColumns({"rmse": F.sqrt(square / n), "pbias": 100 * (F.col("s") - F.col("o")) / none(F.col("o")), "nse": 1 - square / none(F.greatest(F.lit(0.0), vo)), "kge": 1 - F.sqrt(off)})


def run_updates(df: DataFrame, path: str) -> DataFrame:
    """All that is there now through a stream in update mode; every row that came, with the number of its batch."""
    spark = df.sparkSession
    out, mark = f"{path}/{uuid.uuid4().hex}", f"{path}/mark-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        q = df.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out).drop("b")


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of each unit the row of the last batch, closed ones last."""
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    order = F.struct("batch", F.col("closed").cast("int"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def stream_enrich(df: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Stream rows of known units with the units' columns."""
    return df.join(units, keys)


def stream_align(obs: DataFrame, sim: DataFrame, key: str, ts: str, delay: str, within: str) -> DataFrame:
    """Pairs of two streams of the same key and time, that came within a bound of event time."""
    a = event_time(obs, ts).withWatermark(ts, delay).select(F.col(key).alias("k1"), F.col(ts).alias("t1"), F.col("value").alias("obs"))
    b = event_time(sim, ts).withWatermark(ts, delay).select(F.col(key).alias("k2"), F.col(ts).alias("t2"), F.col("value").alias("sim"))
    j = a.join(b, F.expr(f"k1 = k2 AND t2 = t1 AND t2 BETWEEN t1 - INTERVAL {within} AND t1 + INTERVAL {within}"))
    return j.select(F.col("k1").alias(key), F.col("t1").alias(ts), "obs", "sim")


def stream_dedup(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream, to Parquet under `path`, read back; a complete result replaces the last."""
    spark = df.sparkSession
    out, mark = f"{path}/{uuid.uuid4().hex}", f"{path}/mark-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", mark).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(out)
    else:
        q = w.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)
