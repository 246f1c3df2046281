"""Queries over time-series operators."""

from pyspark.sql import functions as F

from ..operators import timeseries as t
from .base import Query

HOURS = "SELECT site, date_trunc('hour', ts) AS ts, avg(value) AS value, count(*) AS n FROM obs_event GROUP BY 1, 2"
SPINE = "SELECT site, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM (SELECT site, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM obs_event GROUP BY site)"
DAYS = f"WITH sp AS ({SPINE}), g AS (SELECT site, date_trunc('day', ts) AS ts, avg(value) AS value, sum(value) AS total, count(*) AS n FROM obs_event GROUP BY 1, 2), r AS (SELECT sp.site, sp.ts, g.value, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM sp LEFT JOIN g ON g.site = sp.site AND g.ts = sp.ts)"
GAPPY = "SELECT basin, d, CASE WHEN day(d) % 7 < 4 AND month(d) % 2 = 0 THEN NULL ELSE q END AS q FROM flow_daily"
ROWS = f"WITH g AS ({GAPPY}), i AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY d) AS i FROM g), l AS (SELECT *, max(CASE WHEN q IS NOT NULL THEN i END) OVER (PARTITION BY basin ORDER BY d) AS li, min(CASE WHEN q IS NOT NULL THEN i END) OVER (PARTITION BY basin ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM i), f AS (SELECT l.basin, l.d, l.q, l.i, li, ni, a.q AS lv, b.q AS nv FROM l LEFT JOIN i a ON a.basin = l.basin AND a.i = li LEFT JOIN i b ON b.basin = l.basin AND b.i = ni)"
WY = "year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END"
FDC = "SELECT basin, q AS flow, 100.0*row_number() OVER (PARTITION BY basin ORDER BY q DESC)/(count(*) OVER (PARTITION BY basin) + 1) AS exceedance FROM flow_daily"
X = "2*pi()*(dayofyear(d)-1)/365"


def gappy(v):
    return v.flow_daily.withColumn("q", F.when((F.dayofmonth("d") % 7 < 4) & (F.month("d") % 2 == 0), None).otherwise(F.col("q")))


def _spells(cond: str, avg: str = "") -> str:
    return f"""WITH c AS (SELECT basin, d, coalesce({cond}, false) AS c, {WY} AS wy FROM (SELECT *, avg(q) OVER (PARTITION BY basin) AS m, median(q) OVER (PARTITION BY basin) AS med FROM flow_daily)),
    g AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY d) - row_number() OVER (PARTITION BY basin, c ORDER BY d) AS g FROM c), r AS (SELECT basin, g, count(*) AS n FROM g WHERE c GROUP BY 1, 2),
    s AS (SELECT basin, count(*) AS spells, avg(n) AS mean_len, median(n) AS median_len, max(n) AS max_len FROM r GROUP BY 1), y AS (SELECT basin, count(DISTINCT wy) AS y FROM c GROUP BY 1)
    SELECT y.basin, coalesce(spells, 0) AS spells, mean_len, median_len, max_len, coalesce(spells, 0)/y AS per_year FROM y LEFT JOIN s ON s.basin = y.basin"""


def _high(v):
    d = v.flow_daily
    return d.join(d.groupBy("basin").agg(F.avg("q").alias("m"), F.median("q").alias("med")), "basin")


SPELL_COLS = "basin:s spells:i mean_len:f median_len:f max_len:i per_year:f"
# Series of three kinds: six hours a step, a day, three days; each is treated by its own first step.
ADAPTED = """WITH s AS (SELECT basin, TIMESTAMP '1992-01-01 00:00:00' + to_hours((d - DATE '1992-01-01') * CASE basin WHEN 'AUTOMOBILE' THEN 6 WHEN 'BUILDING' THEN 72 ELSE 24 END) AS ts, q FROM flow_daily),
n AS (SELECT basin, ts, row_number() OVER (PARTITION BY basin ORDER BY ts) AS i FROM s),
k AS (SELECT basin, epoch(max(ts) FILTER (i=2)) - epoch(min(ts)) AS step FROM n GROUP BY 1),
m AS (SELECT s.*, CASE WHEN step IS NULL OR step BETWEEN 72000 AND 100800 THEN 'as it is' WHEN step < 86400 THEN 'fine' ELSE 'slow' END AS kind FROM s JOIN k ON k.basin=s.basin),
g AS (SELECT basin, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS ts FROM m WHERE kind='slow' GROUP BY basin),
o AS (SELECT g.basin, g.ts, m.q FROM g LEFT JOIN m ON m.basin=g.basin AND m.ts=g.ts),
f AS (SELECT *, last_value(q IGNORE NULLS) OVER a AS lq, last_value(CASE WHEN q IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS lt, first_value(q IGNORE NULLS) OVER b AS nq, first_value(CASE WHEN q IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS nt FROM o
  WINDOW a AS (PARTITION BY basin ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY basin ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT basin, ts, q FROM m WHERE kind='as it is' UNION ALL SELECT basin, date_trunc('day', ts) AS ts, avg(q) AS q FROM m WHERE kind='fine' GROUP BY 1, 2
UNION ALL SELECT basin, ts, CASE WHEN lt IS NULL THEN nq WHEN nt IS NULL OR lt=nt THEN lq ELSE lq+(nq-lq)*(epoch(ts)-epoch(lt))/(epoch(nt)-epoch(lt)) END AS q FROM f"""


def stretched(v):
    hours = F.datediff("d", F.lit("1992-01-01").cast("date")) * F.when(F.col("basin") == "AUTOMOBILE", 6).when(F.col("basin") == "BUILDING", 72).otherwise(24)
    return v.flow_daily.select("basin", (F.lit("1992-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)).alias("ts"), "q")


def sine_sql(column: str) -> str:
    return f"""SELECT basin, m-b1*ms-b2*mc AS level, sqrt(b1*b1+b2*b2) AS amplitude, atan2(-b2,b1)/(2*pi()) AS phase FROM (SELECT *, (sv*cc-cv*sc)/(ss*cc-sc*sc) AS b1, (cv*ss-sv*sc)/(ss*cc-sc*sc) AS b2
  FROM (SELECT basin, avg(v) AS m, covar_pop(s,v) AS sv, covar_pop(c,v) AS cv, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s,c) AS sc, avg(s) AS ms, avg(c) AS mc FROM (SELECT basin, sin({X}) AS s, cos({X}) AS c, {column} AS v FROM precip_daily) GROUP BY 1))"""


def holed(v):
    day = F.dayofmonth("d")
    return v.precip_daily.select("basin", "d", F.when(day % 3 != 0, F.col("p")).alias("pptrate"), F.when((day % 4 != 0) & (F.col("basin") != "BUILDING"), F.col("t")).alias("windspd"), F.when(day % 5 != 0, F.col("t")).alias("airtemp"))


def linear_sql(c: str, default: float) -> str:
    """Linear over the days between the values before and after, held outward."""
    before, after = f"last_value({c} IGNORE NULLS) OVER a", f"first_value({c} IGNORE NULLS) OVER b"
    since, until = f"last_value(CASE WHEN {c} IS NOT NULL THEN d END IGNORE NULLS) OVER a", f"first_value(CASE WHEN {c} IS NOT NULL THEN d END IGNORE NULLS) OVER b"
    return f"coalesce({c}, {before} + ({after} - {before}) * (d - {since}) / ({until} - {since}), {before}, {after}, {default})"


FILTERED = "WITH RECURSIVE r AS (SELECT basin, d, q, row_number() OVER (PARTITION BY basin ORDER BY d) AS k FROM flow_daily), b AS (SELECT basin, d, q, k, q AS b FROM r WHERE k=1 UNION ALL SELECT r.basin, r.d, r.q, r.k, least(r.q, ((1-0.8::DOUBLE)*0.98::DOUBLE*b.b+(1-0.98::DOUBLE)*0.8::DOUBLE*r.q)/(1-0.98::DOUBLE*0.8::DOUBLE)) FROM b JOIN r ON r.basin=b.basin AND r.k=b.k+1)"
# quarters of the flow record, and month files of the second source that begin on the 4th and reach ten days into the next
SPANS = "WITH q AS (SELECT basin, date_trunc('quarter', d)::TIMESTAMP AS k, min(d)::TIMESTAMP AS a, max(d)::TIMESTAMP AS b FROM flow_daily GROUP BY 1, 2), m AS (SELECT basin, date_trunc('month', d)::TIMESTAMP AS k, date_trunc('month', d)::TIMESTAMP+INTERVAL 3 DAYS AS a, date_trunc('month', d)::TIMESTAMP+INTERVAL 40 DAYS AS b FROM precip_daily GROUP BY ALL)"


def _spans(v):
    q = v.flow_daily.groupBy("basin", F.date_trunc("quarter", "d").alias("k")).agg(F.min("d").cast("timestamp_ntz").alias("start"), F.max("d").cast("timestamp_ntz").alias("end"))
    return q, _files(v)


def _files(v):
    m = v.precip_daily.select("basin", F.trunc("d", "month").cast("timestamp_ntz").alias("file")).distinct()
    return m.select("basin", "file", F.expr("file + INTERVAL 3 DAYS").alias("from"), F.expr("file + INTERVAL 40 DAYS").alias("to"))


def _second(v):
    supp = v.precip_daily.where("dayofyear(d) % 3 = 0").select("basin", F.trunc("d", "month").cast("timestamp_ntz").alias("file"), "d", F.col("p").alias("prcp"), (F.col("t") - 273.15).alias("tmean"))
    base = v.wb.select("basin", "d", F.col("p").alias("pptrate"), F.col("t").alias("airtemp"), "q")
    return t.override_from_files(base, _files(v), supp, ["basin"], "d", {"pptrate": "kg m-2 s-1", "airtemp": "K"})


QUERIES = [
    Query("c01_resample_daily", "site:i ts:t value:f total:f n:i", lambda v: t.resample(v.obs_event.selectExpr("site", "ts", "value", "value AS total", "value AS n"), ["site"], "ts", "D", {"value": "mean", "total": "sum", "n": "count"}), DAYS + " SELECT * FROM r"),
    Query("c01_resample_3h", "site:i ts:t hi:f", lambda v: t.resample(v.obs_event.withColumn("hi", F.col("value")), ["site"], "ts", "10800s", {"hi": "max"}).where("hi IS NOT NULL"), "SELECT site, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, max(value) AS hi FROM obs_event GROUP BY 1, 2"),
    Query("c02_interpolate_limit", "basin:s d:d q:f", lambda v: t.interpolate(gappy(v), ["basin"], "d", "q", limit=2), ROWS + " SELECT basin, d, coalesce(q, CASE WHEN li IS NOT NULL AND i-li <= 2 THEN CASE WHEN ni IS NULL THEN lv ELSE lv+(nv-lv)*(i-li)/(ni-li) END END) AS q FROM f"),
    Query("c02_interpolate_time", "basin:s d:d q:f", lambda v: t.interpolate(gappy(v).where("day(d) % 5 <> 0"), ["basin"], "d", "q", limit=24, by="time"), ROWS.replace(GAPPY, f"SELECT * FROM ({GAPPY}) WHERE day(d) % 5 <> 0").replace("a.q AS lv, b.q AS nv", "a.q AS lv, b.q AS nv, a.d AS ld, b.d AS nd") + " SELECT basin, d, coalesce(q, CASE WHEN li IS NOT NULL AND i-li <= 24 THEN CASE WHEN ni IS NULL THEN lv ELSE lv+(nv-lv)*(d-ld)/(nd-ld) END END) AS q FROM f"),
    Query("c02_interpolate_both", "basin:s d:d q:f", lambda v: t.interpolate(gappy(v), ["basin"], "d", "q", both=True), ROWS + " SELECT basin, d, coalesce(q, CASE WHEN li IS NULL THEN nv WHEN ni IS NULL THEN lv ELSE lv+(nv-lv)*(i-li)/(ni-li) END) AS q FROM f"),
    Query("c03_fill_linear", "basin:s d:d q:f", lambda v: t.fill_linear(gappy(v), ["basin"], "d", "q", 0.0), ROWS + " SELECT basin, d, coalesce(q, CASE WHEN li IS NULL THEN nv WHEN ni IS NULL THEN lv ELSE lv+(nv-lv)*(i-li)/(ni-li) END, 0) AS q FROM f"),
    Query("c04_reindex_nearest", "site:i ts:t value:f", lambda v: t.reindex_nearest(t.resample(v.obs_event, ["site"], "ts", "h", {"value": "mean"}).dropna(), ["site"], "ts", "value", t.spine(v.obs_event, ["site"], "ts", "D")),
          f"WITH h AS ({HOURS}), sp AS ({SPINE}), a AS (SELECT sp.site, sp.ts, (SELECT max(h.ts) FROM h WHERE h.site = sp.site AND h.ts <= sp.ts) AS lt, (SELECT min(h.ts) FROM h WHERE h.site = sp.site AND h.ts >= sp.ts) AS nt FROM sp) SELECT a.site, a.ts, h.value FROM a JOIN h ON h.site = a.site AND h.ts = CASE WHEN lt IS NULL THEN nt WHEN nt IS NULL THEN lt WHEN nt-a.ts <= a.ts-lt THEN nt ELSE lt END"),
    Query("c05_gap_report", "basin:s n:i expected:i median_step:f regular_share:f continuous:b", lambda v: t.gap_report(v.flow_daily, ["basin"], "d", 86400), "SELECT basin, count(*) AS n, max(d)-min(d)+1 AS expected, median(s) AS median_step, avg(CASE WHEN abs(s-86400)<=864 THEN 1.0 WHEN s IS NOT NULL THEN 0 END) AS regular_share, max(s) <= 20*86400 AS continuous FROM (SELECT *, (d-lag(d) OVER (PARTITION BY basin ORDER BY d))*86400 AS s FROM flow_daily) GROUP BY basin"),
    Query("c06_to_timestep", "site:i ts:t value:f", lambda v: t.to_timestep(v.obs_event, ["site"], "ts", "value", "D"),
          DAYS + ", i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS i FROM r), l AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY site ORDER BY i) AS li, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM i) SELECT l.site, l.ts, coalesce(l.value, a.value+(b.value-a.value)*(l.i-li)/(ni-li)) AS value FROM l LEFT JOIN i a ON a.site=l.site AND a.i=li LEFT JOIN i b ON b.site=l.site AND b.i=ni"),
    Query("c07_match_cadence", "site:i ts:t value:f", lambda v: t.match_cadence(t.resample(v.obs_event, ["site"], "ts", "D", {"value": "mean"}), v.obs_event, ["site"], "ts", "value"),
          f"WITH sp AS ({SPINE}), st AS (SELECT site, coalesce(median(s) >= 82800, NULL) AS daily FROM (SELECT site, epoch(ts - lag(ts) OVER (PARTITION BY site ORDER BY ts)) AS s FROM sp) GROUP BY site) SELECT o.site, CASE WHEN daily THEN date_trunc('day', ts) ELSE ts END AS ts, avg(value) AS value FROM obs_event o JOIN st ON st.site=o.site GROUP BY 1, 2"),
    Query("c08_shift_daily", "site:i d:d lo:f mean:f hi:f total:f", lambda v: t.shift_daily(v.obs_event, ["site"], "ts", "value", -6), "SELECT site, CAST(ts - INTERVAL 6 HOUR AS DATE) AS d, min(value) AS lo, avg(value) AS mean, max(value) AS hi, sum(value) AS total FROM obs_event GROUP BY 1, 2"),
    Query("c10_interp_join", "basin:s d:d q:f", lambda v: t.interp_join(v.precip_daily.select("basin", "d"), v.flow_daily.where("day(d) % 3 = 0"), ["basin"], "d", "q"),
          "WITH r AS (SELECT * FROM flow_daily WHERE day(d) % 3 = 0), l AS (SELECT p.basin, p.d, (SELECT max(r.d) FROM r WHERE r.basin=p.basin AND r.d<=p.d) AS a, (SELECT min(r.d) FROM r WHERE r.basin=p.basin AND r.d>=p.d) AS b FROM precip_daily p) SELECT l.basin, l.d, CASE WHEN a=b THEN x.q ELSE x.q+(y.q-x.q)*(l.d-a)/(b-a) END AS q FROM l LEFT JOIN r x ON x.basin=l.basin AND x.d=a LEFT JOIN r y ON y.basin=l.basin AND y.d=b"),
    Query("c11_override", "basin:s d:d q:f", lambda v: t.override_forcing(v.sim_daily, v.flow_daily.where("day(d) % 3 = 0 AND year(d) = 1997"), ["basin"], "d", "q"),
          "WITH r AS (SELECT * FROM flow_daily WHERE day(d) % 3 = 0 AND year(d) = 1997), l AS (SELECT p.basin, p.d, p.q, (SELECT max(r.d) FROM r WHERE r.basin=p.basin AND r.d<=p.d) AS a, (SELECT min(r.d) FROM r WHERE r.basin=p.basin AND r.d>=p.d) AS b FROM sim_daily p) SELECT l.basin, l.d, coalesce(CASE WHEN a=b THEN x.q ELSE x.q+(y.q-x.q)*(l.d-a)/(b-a) END, l.q) AS q FROM l LEFT JOIN r x ON x.basin=l.basin AND x.d=a LEFT JOIN r y ON y.basin=l.basin AND y.d=b"),
    Query("c12_year_months", "basin:s ym:s", lambda v: t.year_months(v.flow_daily.groupBy("basin").agg(F.min("d").alias("a"), F.max("d").alias("b")), "a", "b"), "SELECT basin, strftime(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)), '%Y%m') AS ym FROM (SELECT basin, min(d) AS a, CAST(max(d) AS TIMESTAMP) AS b FROM flow_daily GROUP BY basin)"),
    Query("c13_water_year", "basin:s wy:i q:f", lambda v: v.flow_daily.groupBy("basin", t.water_year(F.col("d")).alias("wy")).agg(F.sum("q").alias("q")), f"SELECT basin, {WY} AS wy, sum(q) AS q FROM flow_daily GROUP BY 1, 2"),
    Query("c14_seasonal", "basin:s amplitude_ratio:f phase_months:i", lambda v: t.seasonal_metrics(v.pairs, ["basin"], "d"),
          "WITH m AS (SELECT basin, month(d) AS m, avg(obs) AS o, avg(sim) AS s, count(*) AS n FROM pairs GROUP BY 1, 2), a AS (SELECT basin, (max(s)-min(s))/(max(o)-min(o)) AS r, sum(n) AS n FROM m GROUP BY 1), o AS (SELECT basin, m FROM m QUALIFY row_number() OVER (PARTITION BY basin ORDER BY o DESC, m)=1), s AS (SELECT basin, m FROM m QUALIFY row_number() OVER (PARTITION BY basin ORDER BY s DESC, m)=1) SELECT basin, r AS amplitude_ratio, CASE WHEN abs(o.m-s.m)>6 THEN 12-abs(o.m-s.m) ELSE abs(o.m-s.m) END AS phase_months FROM a JOIN o USING (basin) JOIN s USING (basin) WHERE n > 365"),
    Query("c15_anomaly_corr", "basin:s anomaly_corr:f", lambda v: t.anomaly_corr(v.pairs, ["basin"], "d"),
          "SELECT basin, corr(o, s) AS anomaly_corr FROM (SELECT basin, obs-avg(obs) OVER w AS o, sim-avg(sim) OVER w AS s, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY basin ORDER BY d ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)) WHERE n = 12 GROUP BY basin"),
    Query("c16_trend", "basin:s trend:f", lambda v: t.trend(v.flow_daily, ["basin"], "d", "q"), "SELECT basin, regr_slope(q, (d - DATE '1970-01-01')/365.25) AS trend FROM flow_daily GROUP BY basin"),
    Query("c17_autocorr", "basin:s autocorr:f", lambda v: t.autocorr(v.flow_daily, ["basin"], "d", "q"), "SELECT basin, corr(q, p) AS autocorr FROM (SELECT basin, q, lag(q) OVER (PARTITION BY basin ORDER BY d) AS p FROM flow_daily) WHERE p IS NOT NULL GROUP BY basin"),
    Query("c18_spells_high", SPELL_COLS, lambda v: t.spells(_high(v), ["basin"], "d", F.col("q") > 2 * F.col("med")), _spells("q > 2*med")),
    Query("c18_spells_low", SPELL_COLS, lambda v: t.spells(_high(v), ["basin"], "d", F.col("q") < 0.5 * F.col("m")), _spells("q < 0.5*m")),
    Query("c19_half_flow", "basin:s half_flow_mean:f half_flow_std:f", lambda v: t.half_flow_day(v.flow_daily, ["basin"], "d", "q"), f"WITH c AS (SELECT basin, d, {WY} AS wy, sum(q) OVER (PARTITION BY basin, {WY} ORDER BY d) AS c, sum(q) OVER (PARTITION BY basin, {WY}) AS t FROM flow_daily), f AS (SELECT basin, wy, min(d) AS d FROM c WHERE t > 0 AND c/t > 0.5 GROUP BY 1, 2) SELECT basin, avg(dayofyear(d)) AS half_flow_mean, stddev_pop(dayofyear(d)) AS half_flow_std FROM f GROUP BY 1"),
    Query("c20_fdc", "basin:s flow:f exceedance:f", lambda v: t.fdc(v.flow_daily, ["basin"], "q"), FDC),
    Query("c21_fdc_indices", "basin:s q1:f q5:f q10:f q50:f q85:f q95:f q99:f q10_q50:f q50_q95:f spread:f", lambda v: t.fdc_quantiles(v.flow_daily, ["basin"], "q"),
          f"WITH c AS (SELECT *, lead(flow) OVER w AS f2, lead(exceedance) OVER w AS e2 FROM ({FDC}) WINDOW w AS (PARTITION BY basin ORDER BY exceedance)), q AS (SELECT basin, " + ", ".join(f"max(CASE WHEN exceedance<={p} AND e2>{p} THEN flow+(f2-flow)*({p}-exceedance)/(e2-exceedance) END) AS q{p}" for p in (1, 5, 10, 50, 85, 95, 99)) + " FROM c GROUP BY basin) SELECT *, q10/q50 AS q10_q50, q50/q95 AS q50_q95, (q10-q95)/q50 AS spread FROM q"),
    Query("c22_fdc_slope", "basin:s fdc_slope:f", lambda v: t.fdc_slope(v.flow_daily, ["basin"], "q"), "WITH l AS (SELECT basin, ln(CASE WHEN q<=0 THEN 0.001*avg(q) OVER (PARTITION BY basin) ELSE q END) AS l FROM flow_daily), k AS (SELECT basin, l, row_number() OVER (PARTITION BY basin ORDER BY l)-1 AS k, count(*) OVER (PARTITION BY basin) AS n FROM l) SELECT basin, (max(l) FILTER (k=floor(n*0.66::DOUBLE)) - max(l) FILTER (k=floor(n*0.33::DOUBLE)))/0.33 AS fdc_slope FROM k GROUP BY basin"),
    Query("c23_percentiles", "basin:s p1:f p5:f p50:f p95:f p99:f mean:f std:f", lambda v: t.flow_percentiles(v.flow_daily, ["basin"], "q"), "SELECT basin, quantile_cont(q,0.01) AS p1, quantile_cont(q,0.05) AS p5, quantile_cont(q,0.5) AS p50, quantile_cont(q,0.95) AS p95, quantile_cont(q,0.99) AS p99, avg(q) AS mean, stddev_samp(q) AS std FROM flow_daily GROUP BY basin"),
    Query("c24_water_balance", "basin:s rr_mean:f rr_std:f rr_cv:f aet:f pq_corr:f flow_seasonality:f peak_month:i", lambda v: t.water_balance(v.wb, ["basin"], "d"),
          "WITH y AS (SELECT basin, year(d) AS y, sum(p) AS p, sum(q) AS q FROM wb GROUP BY 1, 2), a AS (SELECT basin, avg(q/p) AS rr_mean, stddev_samp(q/p) AS rr_std, stddev_samp(q/p)/avg(q/p) AS rr_cv, avg(p-q) AS aet FROM y GROUP BY 1), m AS (SELECT basin, month(d) AS m, avg(p) AS p, avg(q) AS q FROM wb GROUP BY 1, 2), f AS (SELECT *, q/sum(q) OVER (PARTITION BY basin) AS f FROM m), b AS (SELECT basin, corr(p,q) AS pq_corr, 0.5*sum(abs(f-1/12.0::DOUBLE)) AS flow_seasonality, arg_max(m, q) AS peak_month FROM f GROUP BY 1) SELECT * FROM a JOIN b USING (basin)"),
    Query("c25_seasonality", "basin:s walsh:f markham:f markham_month:i", lambda v: t.precip_seasonality(v.precip_daily, ["basin"], "d"),
          "WITH m AS (SELECT basin, month(d) AS m, sum(p) AS p FROM precip_daily GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER (PARTITION BY basin) AS t FROM m), s AS (SELECT basin, sum(abs(p-t/12))/max(t) AS walsh, sum(p*sin(radians(30*(m-1)))) AS y, sum(p*cos(radians(30*(m-1)))) AS x, max(t) AS t FROM t GROUP BY 1), k AS (SELECT *, CAST(round(degrees(atan2(y,x))/30)+24 AS BIGINT)%12 AS k FROM s) SELECT basin, walsh, sqrt(x*x+y*y)/t AS markham, CASE WHEN k=0 THEN 12 ELSE k END AS markham_month FROM k"),
    Query("c26_sine_fit", "basin:s level:f amplitude:f phase:f", lambda v: t.sine_fit(v.precip_daily, ["basin"], "d", "p"),
          f"WITH x AS (SELECT basin, sin({X}) AS s, cos({X}) AS c, p AS v FROM precip_daily), a AS (SELECT basin, avg(v) AS m, covar_pop(s,v) AS sv, covar_pop(c,v) AS cv, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s,c) AS sc, avg(s) AS ms, avg(c) AS mc FROM x GROUP BY 1), b AS (SELECT *, (sv*cc-cv*sc)/(ss*cc-sc*sc) AS b1, (cv*ss-sv*sc)/(ss*cc-sc*sc) AS b2 FROM a) SELECT basin, m-b1*ms-b2*mc AS level, sqrt(b1*b1+b2*b2) AS amplitude, atan2(-b2,b1)/(2*pi()) - floor(atan2(-b2,b1)/(2*pi())) AS phase FROM b"),
    Query("c27_budyko", "basin:s w:f", lambda v: t.budyko_w(v.wb.groupBy("basin", F.year("d").alias("y")).agg((F.sum("t") / 100 / F.sum("p")).alias("x"), (F.sum("q") / F.sum("p") / 10).alias("e")), ["basin"], "x", "e"),
          "WITH y AS (SELECT basin, year(d) AS y, sum(t)/100/sum(p) AS x, sum(q)/sum(p)/10 AS e FROM wb GROUP BY 1, 2), g AS (SELECT basin, x, e, unnest(range(101, 1001))/100.0::DOUBLE AS w FROM y WHERE x>0 AND e>0), r AS (SELECT basin, w, avg(pow(1+x-pow(1+pow(x,w),1/w)-e,2)) AS err FROM g GROUP BY 1, 2) SELECT basin, w FROM r QUALIFY row_number() OVER (PARTITION BY basin ORDER BY round(err,12), w)=1"),
    Query("c27_budyko_residual", "basin:s w:f predicted:f residual:f", lambda v: t.budyko_residual(v.wb.groupBy("basin", F.year("d").alias("y")).agg((F.sum("t") / 100 / F.sum("p")).alias("x"), (F.sum("q") / F.sum("p") / 10).alias("e")), ["basin"], "x", "e"),
          "WITH y AS (SELECT basin, year(d) AS y, sum(t)/100/sum(p) AS x, sum(q)/sum(p)/10 AS e FROM wb GROUP BY 1, 2), g AS (SELECT basin, x, e, unnest(range(101, 1001))/100.0::DOUBLE AS w FROM y WHERE x>0 AND e>0), r AS (SELECT basin, w, avg(pow(1+x-pow(1+pow(x,w),1/w)-e,2)) AS err FROM g GROUP BY 1, 2), b AS (SELECT basin, w FROM r QUALIFY row_number() OVER (PARTITION BY basin ORDER BY round(err,12), w)=1), m AS (SELECT basin, avg(x) AS x, avg(e) AS e FROM y GROUP BY 1) SELECT basin, w, 1+x-pow(1+pow(x,w),1/w) AS predicted, e-(1+x-pow(1+pow(x,w),1/w)) AS residual FROM b JOIN m USING (basin)"),
    Query("c26_clipped", "basin:s level:f amplitude:f phase:f", lambda v: t.sine_fit_clipped(v.precip_daily, ["basin"], "d", "p"), None),
    Query("c26_clipped_index", "basin:s seasonality:f", lambda v: t.seasonality_index_clipped(v.precip_daily, ["basin"], "d"), None),
    Query("c28_baseflow", "basin:s bfi:f", lambda v: t.baseflow(v.flow_daily, ["basin"], "d", "q"),
          "WITH RECURSIVE o AS (SELECT basin, q, row_number() OVER (PARTITION BY basin ORDER BY d) AS i FROM flow_daily), r AS (SELECT basin, i, q AS b FROM o WHERE i=1 UNION ALL SELECT o.basin, o.i, least(o.q, (0.2*0.98*r.b+0.02*0.8*o.q)/(1-0.98*0.8)) FROM r JOIN o ON o.basin=r.basin AND o.i=r.i+1) SELECT r.basin, sum(b)/sum(o.q) AS bfi FROM r JOIN o ON o.basin=r.basin AND o.i=r.i GROUP BY r.basin"),
    *[Query(f"c29_pet_{m}", "basin:s d:d pet:f", lambda v, m=m: t.pet(v.precip_daily.withColumn("t", F.col("t") - 273.15), "d", "t", 51.0, m), f"WITH a AS (SELECT basin, d, t-273.15 AS t, 0.409*sin(2*pi()*dayofyear(d)/365-1.39) AS dec, dayofyear(d) AS j, radians(51.0) AS phi FROM precip_daily), w AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi)*tan(dec)))) AS ws FROM a), r AS (SELECT *, 24*60/pi()*0.0820*(1+0.033*cos(2*pi()*j/365))*(ws*sin(phi)*sin(dec)+cos(phi)*cos(dec)*sin(ws)) AS ra FROM w) SELECT basin, d, greatest(0, {e}) AS pet FROM r")
      for m, e in (("oudin", "CASE WHEN t > -5 THEN 0.408*ra*(t+5)/100 ELSE 0 END"), ("hamon", "0.1651*(ws*24/pi()/12)*(216.7*6.108*exp(17.27*t/(t+237.3))/(t+273.3))"), ("hargreaves", "0.0023*0.408*ra*(t+17.8)*sqrt(10)"))],
    Query("c30_snow", "basin:s d:d swe:f", lambda v: t.snow_bucket(v.precip_daily, ["basin"], "d", "p", "t"), "WITH s AS (SELECT basin, d, sum(CASE WHEN t<273.15 THEN p ELSE -3.0*(t-273.15) END) OVER (PARTITION BY basin ORDER BY d) AS w FROM precip_daily) SELECT basin, d, w-least(0, min(w) OVER (PARTITION BY basin ORDER BY d)) AS swe FROM s"),
    Query("c31_growing_season", "basin:s months:i first_month:i last_month:i peak_month:i amplitude:f variation:f", lambda v: t.growing_season(v.precip_daily, ["basin"], "d", "t"), "WITH m AS (SELECT basin, month(d) AS m, avg(t) AS v FROM precip_daily GROUP BY 1, 2), b AS (SELECT *, min(v) OVER w AS a, max(v) OVER w AS z FROM m WINDOW w AS (PARTITION BY basin)) SELECT basin, count(*) FILTER (v>=a+0.5*(z-a)) AS months, min(m) FILTER (v>=a+0.5*(z-a)) AS first_month, max(m) FILTER (v>=a+0.5*(z-a)) AS last_month, arg_max(m, v) AS peak_month, max(v)-min(v) AS amplitude, stddev_pop(v)/avg(v) AS variation FROM b GROUP BY basin"),
    Query("c32_sequences", "basin:s d:d " + " ".join(f"{c}{i}:f" for c in "pt" for i in range(1, 6)) + " y:f", lambda v: t.sequences(v.wb, ["basin"], "d", ["p", "t"], "q", 5).selectExpr("basin", "d", *[f"x_{c}[{i - 1}] AS {c}{i}" for c in "pt" for i in range(1, 6)], "y"), "WITH z AS (SELECT basin, d, greatest(-10, least(10, (p-avg(p) OVER w)/stddev_pop(p) OVER w)) AS p, greatest(-10, least(10, (t-avg(t) OVER w)/stddev_pop(t) OVER w)) AS t, greatest(-10, least(10, (q-avg(q) OVER w)/stddev_pop(q) OVER w)) AS q FROM wb WINDOW w AS (PARTITION BY basin)) SELECT basin, d, " + ", ".join(f"lag({c}, {6 - i}) OVER o AS {c}{i}" for c in "pt" for i in range(1, 6)) + ", q AS y FROM z WINDOW o AS (PARTITION BY basin ORDER BY d) QUALIFY row_number() OVER o > 5"),
    Query("c33_thin", "basin:s d:d q:f", lambda v: t.thin(v.flow_daily, ["basin"], "d", "q", 500), "SELECT basin, d, q FROM flow_daily QUALIFY (row_number() OVER (PARTITION BY basin ORDER BY d)-1) % greatest(1, ceil(count(*) OVER (PARTITION BY basin)/500.0)) = 0"),
    Query("c34_assemble", "basin:s d:d p:f t:f q:f", lambda v: t.assemble({"a": v.precip_daily, "b": v.flow_daily}, ["basin"], "d"), "WITH b AS (SELECT basin, greatest(a1, a2) AS a, least(b1, b2) AS b FROM (SELECT basin, min(d) AS a1, max(d) AS b1 FROM precip_daily GROUP BY 1) JOIN (SELECT basin, min(d) AS a2, max(d) AS b2 FROM flow_daily GROUP BY 1) USING (basin)), s AS (SELECT basin, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM b) SELECT s.basin, s.d, p, t, q FROM s LEFT JOIN precip_daily p ON p.basin=s.basin AND p.d=s.d LEFT JOIN flow_daily f ON f.basin=s.basin AND f.d=s.d"),
    Query("c35_nearest_join", "site:i ts:t value:f", lambda v: t.nearest_join(v.obs_event.where("variable = 'click'").select("site", "ts").distinct(), v.obs_event.where("variable = 'view'").groupBy("site", "ts").agg(F.max("value").alias("value")), ["site"], "ts", "value", 6 * 3600),
          "WITH l AS (SELECT DISTINCT site, ts FROM obs_event WHERE variable='click'), r AS (SELECT site, ts, max(value) AS value FROM obs_event WHERE variable='view' GROUP BY 1, 2), c AS (SELECT l.site, l.ts, r.value, row_number() OVER (PARTITION BY l.site, l.ts ORDER BY abs(epoch_us(r.ts)-epoch_us(l.ts)), r.ts) AS k, abs(epoch_us(r.ts)-epoch_us(l.ts))/1e6 AS off FROM l JOIN r ON r.site=l.site) SELECT site, ts, value FROM c WHERE k=1 AND off<=6*3600"),
    Query("c06_adapt_timestep", "basin:s ts:t q:f", lambda v: t.adapt_timestep(stretched(v), ["basin"], "ts", "q", "D"), ADAPTED),
    Query("c26_seasonality_index", "basin:s seasonality:f", lambda v: t.seasonality_index(v.precip_daily, ["basin"], "d"),
          f"SELECT p.basin, p.amplitude/p.level*cos(2*pi()*(p.phase-t.phase)) AS seasonality FROM ({sine_sql('p')}) p JOIN ({sine_sql('t')}) t ON t.basin=p.basin"),
    Query("c03_fill_policy", "basin:s d:d pptrate:f windspd:f airtemp:f", lambda v: t.fill_forcing(holed(v), ["basin"], "d"),
          f"WITH h AS (SELECT basin, d, CASE WHEN day(d)%3<>0 THEN p END AS pptrate, CASE WHEN day(d)%4<>0 AND basin<>'BUILDING' THEN t END AS windspd, CASE WHEN day(d)%5<>0 THEN t END AS airtemp FROM precip_daily) SELECT basin, d, coalesce(pptrate, 0) AS pptrate, {linear_sql('windspd', 2.0)} AS windspd, {linear_sql('airtemp', 273.15)} AS airtemp FROM h WINDOW a AS (PARTITION BY basin ORDER BY d ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY basin ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    Query("c11_file_overlap", "basin:s quarter:t month:t", lambda v: t.overlap_join(*_spans(v), ["basin"]).select("basin", F.col("start").alias("quarter"), F.col("from").alias("month")), f"{SPANS} SELECT a.basin, a.a AS quarter, b.a AS month FROM q a JOIN m b ON a.basin=b.basin AND a.a<=b.b AND b.a<=a.b"),
    Query("c11_second_source", "basin:s d:d pptrate:f airtemp:f q:f", _second, f"{SPANS}, f AS (SELECT DISTINCT m.basin, m.k FROM m JOIN (SELECT basin, min(d) AS a, max(d) AS b FROM flow_daily GROUP BY 1) r ON r.basin=m.basin AND m.a<=r.b AND r.a<=m.b), su AS (SELECT p.* FROM precip_daily p JOIN f ON f.basin=p.basin AND f.k=date_trunc('month', d) WHERE dayofyear(d)%3=0), b AS (SELECT wb.basin, wb.d, wb.p, wb.t, wb.q, l.d AS ld, l.p AS lp, l.t AS lt FROM wb ASOF LEFT JOIN su l ON l.basin=wb.basin AND wb.d>=l.d), c AS (SELECT b.*, n.d AS nd, n.p AS np, n.t AS nt FROM b ASOF LEFT JOIN su n ON n.basin=b.basin AND b.d<=n.d), w AS (SELECT *, CASE WHEN ld=nd THEN 0.0 ELSE (d-ld)::DOUBLE/(nd-ld) END AS w FROM c) SELECT basin, d, coalesce((lp+(np-lp)*w)/3600, p) AS pptrate, coalesce(lt-273.15+(nt-lt)*w+273.15, t) AS airtemp, q FROM w"),
    Query("c24_indices", "basin:s aet_mean:f aet_std:f aridity_mean:f aridity_std:f evaporative_mean:f ratio_min:f ratio_max:f ratio_range:f min_month:i max_month:i", lambda v: t.water_indices(v.wb.withColumn("pet", F.col("t") / 100), ["basin"], "d"),
          "WITH y AS (SELECT basin, year(d) AS k, sum(p) AS p, sum(q) AS q, sum(t/100) AS e FROM wb GROUP BY 1, 2), a AS (SELECT basin, avg(p-q) AS aet_mean, stddev_samp(p-q) AS aet_std, avg(e/p) AS aridity_mean, stddev_samp(e/p) AS aridity_std, avg((p-q)/p) AS evaporative_mean FROM y WHERE p>0 GROUP BY 1), ym AS (SELECT basin, month(d) AS m, sum(p) AS p, sum(q) AS q FROM wb GROUP BY basin, year(d), month(d)), m AS (SELECT basin, m, avg(q)/avg(p) AS r FROM ym GROUP BY 1, 2), b AS (SELECT basin, min(r) AS ratio_min, max(r) AS ratio_max, max(r)-min(r) AS ratio_range, first(m ORDER BY r, m) AS min_month, first(m ORDER BY r DESC, m) AS max_month FROM m GROUP BY 1) SELECT a.*, b.* EXCLUDE (basin) FROM a JOIN b ON a.basin=b.basin"),
    Query("c28_baseflow_seasons", "basin:s season:s bfi:f", lambda v: t.baseflow(v.flow_daily, ["basin"], "d", "q", seasonal=True), f"{FILTERED} SELECT basin, CASE WHEN month(d) IN (12,1,2) THEN 'DJF' WHEN month(d) IN (3,4,5) THEN 'MAM' WHEN month(d) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season, sum(b)/sum(q) AS bfi FROM b GROUP BY 1, 2"),
    Query("c28_baseflow_rows", "basin:s d:d base:f", lambda v: t.baseflow_rows(v.flow_daily, ["basin"], "d", "q"), f"{FILTERED} SELECT basin, d, b AS base FROM b"),
    Query("c33_thin_by_size", "user_type:s ts:t value:f", lambda v: t.thin_by_size(v.table("events").select(F.col("event_type").alias("user_type"), "ts", "value"), ["user_type"], "ts", "value", 40, 250, 150),
          "WITH n AS (SELECT event_type AS user_type, ts, value, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT user_type, CASE WHEN n>250 THEN date_trunc('week', ts)::TIMESTAMP WHEN n>150 THEN date_trunc('day', ts)::TIMESTAMP ELSE ts END AS ts, avg(value) AS value FROM n GROUP BY 1, 2) SELECT user_type, ts, value FROM m QUALIFY (row_number() OVER (PARTITION BY user_type ORDER BY ts)-1) % greatest(1, ceil(count(*) OVER (PARTITION BY user_type)/40.0)) = 0"),
]
