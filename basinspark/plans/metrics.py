"""Queries over skill metrics."""

from ..operators import metrics as m
from .base import Query

DENOM = "nullif(var_pop(obs)*count(*), 0)"
CV = "(stddev_samp(sim)/avg(sim))/(stddev_samp(obs)/avg(obs))"
R = "corr(sim, obs)"
MET = f"""count(*) AS n, 1-sum((sim-obs)*(sim-obs))/{DENOM} AS nse,
1-sum((sim-obs)*(sim-obs))/nullif(sum(obs*obs)-2*avg(sim)*sum(obs)+count(*)*avg(sim)*avg(sim), 0) AS nse_simref,
1-sqrt(pow({R}-1,2)+pow(stddev_samp(sim)/stddev_samp(obs)-1,2)+pow(avg(sim)/avg(obs)-1,2)) AS kge,
1-sqrt(pow({R}-1,2)+pow({CV}-1,2)+pow(avg(sim)/avg(obs)-1,2)) AS kge_prime,
sqrt(avg((sim-obs)*(sim-obs))) AS rmse, avg((sim-obs)*(sim-obs)) AS mse, avg(abs(sim-obs)) AS mae,
100*(sum(sim)-sum(obs))/sum(obs) AS pbias, avg(sim)-avg(obs) AS bias, 100*(avg(sim)-avg(obs))/(avg(obs)+1e-9) AS bias_pct,
{R} AS r, stddev_samp(sim)/stddev_samp(obs) AS alpha, avg(sim)/avg(obs) AS beta"""
COLS = "n:i nse:f nse_simref:f kge:f kge_prime:f rmse:f mse:f mae:f pbias:f bias:f bias_pct:f r:f alpha:f beta:f"
PERIODS = {"Calib_": ("1995-01-01", "1997-12-31"), "Eval_": ("1998-01-01", "2001-12-31")}
RANK = "rank() OVER (PARTITION BY basin ORDER BY {c}) + (count(*) OVER (PARTITION BY basin, {c}) - 1)/2.0"

QUERIES = [
    Query("skill_metrics", "basin:s period:s " + COLS, lambda v: m.metrics(m.label_periods(v.pairs, "d", PERIODS), ["basin", "period"]),
          f"SELECT basin, period, {MET} FROM (SELECT *, 'Calib_' AS period FROM pairs WHERE d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' UNION ALL SELECT *, 'Eval_' FROM pairs WHERE d BETWEEN DATE '1998-01-01' AND DATE '2001-12-31') GROUP BY basin, period"),
    Query("d01_align", "basin:s d:d obs:f sim:f", lambda v: m.align(v.flow_daily, v.sim_daily, ["basin", "d"]), "SELECT basin, d, obs, sim FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL"),
    Query("d01_align_positive", "basin:s d:d obs:f sim:f", lambda v: m.align(v.flow_daily, v.sim_daily, ["basin", "d"], positive_only=True, least=10), "SELECT basin, d, obs, sim FROM pairs WHERE obs > 0 AND sim > 0 QUALIFY count(*) OVER (PARTITION BY basin) >= 10"),
    Query("d02_transform", "basin:s d:d obs:f sim:f", lambda v: m.power_transform(v.pairs, -1.0, ["basin"]), "SELECT basin, d, pow(obs + e, -1) AS obs, pow(sim + e, -1) AS sim FROM pairs JOIN (SELECT basin, avg(obs)/100 AS e FROM pairs GROUP BY basin) USING (basin)"),
    Query("d03_nse", "basin:s nse:f", lambda v: v.pairs.groupBy("basin").agg(m.nse()), f"SELECT basin, 1-sum((sim-obs)*(sim-obs))/{DENOM} AS nse FROM pairs GROUP BY basin"),
    Query("d04_nse_simref", "basin:s nse_simref:f", lambda v: v.pairs.groupBy("basin").agg(m.nse_simref()), "SELECT basin, 1-sum((sim-obs)*(sim-obs))/sum((obs-ms)*(obs-ms)) AS nse_simref FROM (SELECT *, avg(sim) OVER (PARTITION BY basin) AS ms FROM pairs) GROUP BY basin"),
    Query("d05_kge", "basin:s kge:f", lambda v: v.pairs.groupBy("basin").agg(m.kge()), f"SELECT basin, 1-sqrt(pow({R}-1,2)+pow(stddev_samp(sim)/stddev_samp(obs)-1,2)+pow(avg(sim)/avg(obs)-1,2)) AS kge FROM pairs GROUP BY basin"),
    Query("d06_kge_prime", "basin:s kge_prime:f", lambda v: v.pairs.groupBy("basin").agg(m.kge_prime()), f"SELECT basin, 1-sqrt(pow({R}-1,2)+pow({CV}-1,2)+pow(avg(sim)/avg(obs)-1,2)) AS kge_prime FROM pairs GROUP BY basin"),
    Query("d07_kge_np", "basin:s kge_np:f", lambda v: m.kge_np(v.pairs, ["basin"]),
          f"""WITH r AS (SELECT basin, corr(ro, rs) AS r, avg(sim)/avg(obs) AS b FROM (SELECT *, {RANK.format(c='obs')} AS ro, {RANK.format(c='sim')} AS rs FROM pairs) GROUP BY basin),
          o AS (SELECT basin, row_number() OVER (PARTITION BY basin ORDER BY obs) AS k, obs/sum(obs) OVER (PARTITION BY basin) AS x FROM pairs), s AS (SELECT basin, row_number() OVER (PARTITION BY basin ORDER BY sim) AS k, sim/sum(sim) OVER (PARTITION BY basin) AS y FROM pairs),
          a AS (SELECT basin, 1-0.5*sum(abs(y-x)) AS a FROM o JOIN s USING (basin, k) GROUP BY basin)
          SELECT basin, 1-sqrt(pow(a-1,2)+pow(b-1,2)+pow(r-1,2)) AS kge_np FROM r JOIN a USING (basin)"""),
    Query("d08_errors", "basin:s rmse:f mse:f mae:f", lambda v: v.pairs.groupBy("basin").agg(*m.errors()), "SELECT basin, sqrt(avg(pow(sim-obs,2))) AS rmse, avg(pow(sim-obs,2)) AS mse, avg(abs(sim-obs)) AS mae FROM pairs GROUP BY basin"),
    Query("d09_bias", "basin:s pbias:f bias:f bias_pct:f r:f alpha:f beta:f", lambda v: v.pairs.groupBy("basin").agg(*m.bias_suite()), f"SELECT basin, pbias, bias, bias_pct, r, alpha, beta FROM (SELECT basin, {MET} FROM pairs GROUP BY basin)"),
    Query("d10_metric_suite", "basin:s yr:i " + COLS, lambda v: m.metrics(v.pairs.selectExpr("*", "year(d) AS yr"), ["basin", "yr"]), f"SELECT basin, year(d) AS yr, {MET} FROM pairs GROUP BY 1, 2"),
    Query("d11_contingency", "basin:s pod:f far:f csi:f accuracy:f", lambda v: m.contingency(v.pairs, ["basin"], 20.0),
          "SELECT basin, h/nullif(h+x,0) AS pod, f/nullif(h+f,0) AS far, h/nullif(h+x+f,0) AS csi, (h+z)/nullif(n,0) AS accuracy FROM (SELECT basin, count(*) FILTER (obs>20 AND sim>20)*1.0 AS h, count(*) FILTER (obs>20 AND sim<=20)*1.0 AS x, count(*) FILTER (obs<=20 AND sim>20)*1.0 AS f, count(*) FILTER (obs<=20 AND sim<=20)*1.0 AS z, count(*)*1.0 AS n FROM pairs GROUP BY basin)"),
    Query("d12_peak_error", "basin:s peak_days:i peak_shift:i peak_pct:f", lambda v: m.peak_error(v.pairs, ["basin"], "d"),
          "WITH o AS (SELECT basin, d, obs FROM pairs QUALIFY row_number() OVER (PARTITION BY basin ORDER BY obs DESC, d)=1), s AS (SELECT basin, d, sim FROM pairs QUALIFY row_number() OVER (PARTITION BY basin ORDER BY sim DESC, d)=1) SELECT o.basin, abs(s.d-o.d) AS peak_days, s.d-o.d AS peak_shift, 100*abs(sim-obs)/obs AS peak_pct FROM o JOIN s ON o.basin=s.basin"),
    Query("d13_conditional_bias", "basin:s high_bias:f low_bias:f wet_bias:f dry_bias:f", lambda v: m.conditional_bias(v.pairs, ["basin"]),
          "WITH q AS (SELECT basin, quantile_cont(obs, 0.1) AS a, quantile_cont(obs, 0.5) AS b, quantile_cont(obs, 0.9) AS c FROM pairs GROUP BY basin) SELECT basin, 100*avg(sim-obs) FILTER (obs>=c)/avg(obs) FILTER (obs>=c) AS high_bias, 100*avg(sim-obs) FILTER (obs<=a)/avg(obs) FILTER (obs<=a) AS low_bias, 100*avg(sim-obs) FILTER (obs>=b)/avg(obs) FILTER (obs>=b) AS wet_bias, 100*avg(sim-obs) FILTER (obs<b)/avg(obs) FILTER (obs<b) AS dry_bias FROM pairs JOIN q USING (basin) GROUP BY basin"),
    Query("d14_range", "basin:s range_ratio:f range_bias:f", lambda v: m.range_metrics(v.pairs, ["basin"]), "SELECT basin, r AS range_ratio, (r-1)*100 AS range_bias FROM (SELECT basin, (max(sim)-min(sim))/nullif(max(obs)-min(obs),0) AS r FROM pairs GROUP BY basin)"),
    Query("d15_pair_report", "basin:s n_obs:i n_sim:i n_both:i mean_ratio:f overlap_pct:f median_obs:f std_sim:f flagged:b", lambda v: m.pair_report(v.flow_daily, v.sim_daily, ["basin"], "d"),
          "WITH o AS (SELECT basin, count(q) AS n_obs, avg(q) AS mo, median(q) AS median_obs, avg(CASE WHEN q=0 THEN 1.0 ELSE 0 END) AS zo FROM flow_daily GROUP BY basin), s AS (SELECT basin, count(q) AS n_sim, avg(q) AS ms, stddev_samp(q) AS std_sim, avg(CASE WHEN q=0 THEN 1.0 ELSE 0 END) AS zs FROM sim_daily GROUP BY basin), b AS (SELECT basin, count(*) AS n_both, corr(obs,sim) AS r FROM pairs GROUP BY basin) SELECT basin, n_obs, n_sim, n_both, ms/mo AS mean_ratio, 100*n_both/least(n_obs,n_sim) AS overlap_pct, median_obs, std_sim, (ms/mo<0.01 OR ms/mo>100 OR coalesce(r<-0.5,false) OR zo>0.8 OR zs>0.8) AS flagged FROM o JOIN s USING (basin) JOIN b USING (basin)"),
]
