"""Readers on small written files, and time-series rules on fixed values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinspark.functions import columns as c
from basinspark.operators import layers, network
from basinspark.operators import timeseries as t
from basinspark.sources import readers as r


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_rdb(spark, tmp_path):
    p = write(tmp_path, "a.rdb", "# note\nagency_cd\tsite_no\tdatetime\ttz_cd\t1_00060\t1_00060_cd\n5s\t15s\t20d\t6s\t14n\t10s\nUSGS\t01\t2020-01-01 00:15\tEST\t100\tA\nUSGS\t01\t2020-01-01 00:30\tEST\tIce\tA\n")
    rows = r.read_rdb(spark, p).orderBy("ts").collect()
    assert [(x.site, x.ts, round(x.value, 6) if x.value else x.value) for x in rows] == [("01", dt.datetime(2020, 1, 1, 0, 15), 2.831685), ("01", dt.datetime(2020, 1, 1, 0, 30), None)]


def test_utc_csv(spark, tmp_path):
    p = write(tmp_path, "w.csv", "# x\nISO 8601 UTC,Value\n2020-07-01T12:00:00Z,3.5\n")
    assert r.read_utc_csv(spark, p).collect()[0] == (dt.datetime(2020, 7, 1, 6), 3.5)


def test_split_date(spark, tmp_path):
    p = write(tmp_path, "v.csv", "YYYY;MM;DD;qobs;qc_flag\n2020;2;29;1.5;0\n")
    assert r.read_split_date_csv(spark, p).collect()[0] == (dt.date(2020, 2, 29), 1.5, "0")


def test_snow(spark, tmp_path):
    p = write(tmp_path, "s.csv", "some words\nDate,Other,X Snow Water Equivalent (in)\n03/01/2020,1,2.5\n04/01/2020,1,-1\n")
    assert sorted(map(tuple, r.read_snow_csv(spark, p).collect()), key=str) == [(dt.date(2020, 1, 3), 2.5), (dt.date(2020, 1, 4), None)]


def test_runoff_flux_obs_numbered(spark, tmp_path):
    p = write(tmp_path, "run.csv", "date,discharge\n31/01/2020,86.4\n2020-02-01,bad\n")
    assert r.read_runoff_csv(spark, p, 10.0).collect() == [(dt.date(2020, 1, 31), 10.0)]
    write(tmp_path, "FLX_CA-Ban_DD.csv", "TIMESTAMP,LE_F_MDS,LE_F_MDS_QC\n20200101,100,1\n")
    assert [round(x.et, 3) for x in r.read_flux(spark, str(tmp_path), "CA-Ban").collect()] == [3.53]
    p = write(tmp_path, "g1.csv", "Date,q_cms\n2020-01-01,NA\n2020-01-02,2\n")
    assert [tuple(x) for x in r.read_obs(spark, p, "streamflow").orderBy("ts").collect()] == [("g1", dt.datetime(2020, 1, 1), None), ("g1", dt.datetime(2020, 1, 2), 2.0)]
    p = write(tmp_path, "nex-17_output.csv", "0,2020-01-01 01:00:00,4.5\n")
    assert [tuple(x) for x in r.read_numbered(spark, p, header=False).collect()] == [(17, dt.datetime(2020, 1, 1, 1), 4.5)]


def test_service_json(spark):
    j = '{"value":{"timeSeries":[{"variable":{"variableName":"Depth to water level","unit":{"unitCode":"ft"}},"values":[{"value":[{"dateTime":"2020-01-01T00:00:00","value":"3.1","qualifiers":["P","e"]}]},{"value":[{"dateTime":"2021-01-01T00:00:00","value":"9","qualifiers":[]}]}]},{"variable":{"variableName":"Flow","unit":{"unitCode":"x"}},"values":[]}]}}'
    rows = r.flatten_service_json(spark.createDataFrame([(j,)], "j string"), "j").collect()
    assert [tuple(x) for x in rows] == [(dt.datetime(2020, 1, 1), 3.1, "ft", "P,e")]


def test_interpolate_fixture(spark):
    v = [None, 1.0, None, None, None, 5.0, *[None] * 6]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, i int, v double")
    got = [x.v for x in t.interpolate(d, ["k"], "i", "v", 2).orderBy("i").collect()]
    assert got == [None, 1, 2, 3, None, 5, 5, 5, None, None, None, None]
    got = [x.v for x in t.interpolate(d, ["k"], "i", "v", both=True).orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 5]


def test_resample_and_nearest_fixture(spark):
    a = dt.datetime(2020, 1, 1, 0, 10)
    d = spark.createDataFrame([(1, a, 1.0), (1, a.replace(hour=3), 2.0)], "k int, ts timestamp_ntz, v double")
    got = t.resample(d.withColumn("s", F.col("v")), ["k"], "ts", "h", {"v": "mean", "s": "sum"}).orderBy("ts").collect()
    assert [(x.v, x.s) for x in got] == [(1.0, 1.0), (None, 0.0), (None, 0.0), (2.0, 2.0)]
    p = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, h), float(h + 1)) for h in (0, 1)], "k int, ts timestamp_ntz, v double")
    q = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 0, 30))], "k int, ts timestamp_ntz")
    assert t.reindex_nearest(p, ["k"], "ts", "v", q).collect()[0].v == 2.0


def test_round_hour_and_names(spark):
    rows = [(dt.datetime(2020, 1, 1, 0, 30),), (dt.datetime(2020, 1, 1, 1, 30),), (dt.datetime(2020, 1, 1, 2, 30, 0, 1000),)]
    got = spark.createDataFrame(rows, "ts timestamp_ntz").select(c.round_hour(F.col("ts")).alias("h")).collect()
    assert [x.h.hour for x in got] == [0, 2, 3]
    got = spark.createDataFrame([("1 A-b (c) & 5%",), ("",), (None,)], "s string").select(c.clean_name(F.col("s")).alias("s")).collect()
    assert [x.s for x in got] == ["x1_a_b_c_and_5percent", "unknown", "unknown"]


def test_network_cycle_and_stray_unit(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 4)], "seg long, down long")
    up = network.upstream(e, spark.createDataFrame([(4,), (1,), (99,)], "seg long")).collect()
    assert sorted(map(tuple, up)) == [(1, 1), (1, 2), (4, 3), (4, 4), (4, 5)]
    assert sorted(map(tuple, network.downstream_order(e).collect())) == [(1, -1), (2, -1), (3, 0), (5, 0)]


def test_closest_column():
    assert layers.closest_column(["sm_5_x", "sm_20_x", "other"], 18) == "sm_20_x"


def test_spline_is_exact_on_cubics_and_smooth():
    x = np.array([0.0, 1.0, 4.0, 5.0, 9.0, 10.0])
    f = lambda t: 2.0 - t + 0.5 * t**2 - 0.03 * t**3
    where = np.arange(-2.0, 14.0)
    for n in (4, 5, 6):
        assert np.allclose(t.cubic_spline(x[:n], f(x[:n]), where), f(where))
    assert np.allclose(t.cubic_spline(x[:3], np.array([0.0, 1.0, 7.0]), np.array([-1.0, 0.5, 2.0, 6.0])), [-1, 0.5, 3, 11])
    y = np.array([1.0, -2.0, 3.0, 0.5, 4.0, 4.0])
    e = 1e-5
    for k in x[1:-1]:  # value, slope and curvature agree on both sides of an inner point
        g = lambda t_: t.cubic_spline(x, y, np.array([t_]))[0]
        assert abs(g(k + e) - g(k - e)) < 1e-3 and abs((g(k + 2 * e) - g(k + e)) - (g(k - e) - g(k - 2 * e))) / e < 1e-2


def test_fill_forcing_spline_and_refusal(spark):
    day = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(13)]
    f = lambda i: 280.0 + i - 0.1 * i**2
    rows = [(1, d, f(i) if i % 3 == 0 else None) for i, d in enumerate(day)] + [(2, day[0], None), (None, day[0], 400.0), (None, day[1], None)]
    d = spark.createDataFrame(rows, "k int, ts timestamp_ntz, airtemp double")
    got = {(r.k, r.ts): r.airtemp for r in t.fill_forcing(d, ["k"], "ts").collect()}
    assert np.allclose([got[1, x] for x in day], [f(i) for i in range(13)])
    assert (got[2, day[0]], got[None, day[0]]) == (273.15, 273.15)
    with pytest.raises(ValueError):
        t.fill_forcing(d.select("k", "ts", F.when(F.col("ts") == day[0], F.lit(None)).otherwise(F.lit(None)).cast("double").alias("windspd")), ["k"], "ts")
    assert t.fill_forcing(d.where("false"), ["k"], "ts").count() == 0


def test_adapt_timestep_single_and_null_key(spark):
    a = dt.datetime(2020, 1, 1)
    rows = [(1, a, 5.0)] + [(None, a + dt.timedelta(days=3 * i), float(i)) for i in range(2)] + [(2, a + dt.timedelta(hours=6 * i), float(i)) for i in range(5)] + [(3, a + dt.timedelta(hours=25 * i), float(i)) for i in range(3)]
    d = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    got = sorted(((r.k or 0, r.ts, round(r.v, 6)) for r in t.adapt_timestep(d, ["k"], "ts", "v", "D").collect()))
    h = lambda n: a + dt.timedelta(hours=n)
    assert got == [(0, a, 0.0), (0, h(24), round(1 / 3, 6)), (0, h(48), round(2 / 3, 6)), (0, h(72), 1.0), (1, a, 5.0), (2, a, 1.5), (2, h(24), 4.0), (3, a, 0.0), (3, h(25), 1.0), (3, h(50), 2.0)]


def test_quantile_class_ties_nulls_empty(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 2.0, 9.0, None)], "v double")
    from basinspark.operators import spatial

    got = sorted(((r.v, r.q) for r in spatial.quantile_class(d, "v", 2, "q").collect()), key=str)
    want = np.quantile([1, 1, 1, 2, 9], 0.5)
    assert got == sorted([(v, None if v is None else int(v >= want)) for (v,) in d.collect()], key=str)
    assert spatial.quantile_class(d.where("false"), "v", 4).count() == 0


def test_merge_small_leaves_nothing_that_could_merge(spark):
    rng = np.random.default_rng(3)
    area = {i: float(rng.integers(1, 12)) for i in range(40)}
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(0, 0)]
    units = spark.createDataFrame(list(area.items()), "unit long, area double")
    got = dict(map(tuple, network.merge_small(units, spark.createDataFrame(edges, "a long, b long"), 10.0).collect()))
    assert sorted(got) == sorted(area)
    total = {g: sum(area[u] for u in area if got[u] == g) for g in got.values()}
    between = {(got[a], got[b]) for a, b in edges if got[a] != got[b]}
    small = {g for g, s in total.items() if s < 10}
    assert not any(a in small or b in small for a, b in between)  # a small group has no neighbour left
    for g in total:  # groups hang together
        members, seen = {u for u in got if got[u] == g}, {g}
        while more := {y for x, y in [*edges, *((b, a) for a, b in edges)] if x in seen and y in members} - seen:
            seen |= more
        assert seen == members
