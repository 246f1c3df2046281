"""Queries over benchmarks, experiments, layers and sets."""

from pyspark.sql import functions as F

from ..operators import benchmarks as b
from ..operators import experiments as x
from ..operators import layers as la
from ..operators import sets as st
from .base import Query

CAL = "y AS (SELECT basin, list_sort(list(DISTINCT year(d))) AS y FROM wb GROUP BY 1), c AS (SELECT wb.*, year(d) < y[len(y)//2+1] AS cal FROM wb JOIN y ON y.basin=wb.basin)"
RR = f"{CAL}, rr AS (SELECT basin, sum(q)/sum(p) AS rr FROM c WHERE cal GROUP BY 1)"
NAMES = ["bm_mean", "bm_median", "bm_annual_mean", "bm_monthly_mean", "bm_daily_mean", "bm_monthly_median"]
BM = f"""{CAL}, a AS (SELECT basin, avg(q) AS bm_mean, median(q) AS bm_median FROM c WHERE cal GROUP BY 1), yy AS (SELECT basin, year(d) AS k, avg(q) AS bm_annual_mean FROM c WHERE cal GROUP BY 1, 2), mm AS (SELECT basin, month(d) AS k, avg(q) AS bm_monthly_mean, median(q) AS bm_monthly_median FROM c WHERE cal GROUP BY 1, 2), dd AS (SELECT basin, dayofyear(d) AS k, avg(q) AS bm_daily_mean FROM c WHERE cal GROUP BY 1, 2),
f AS (SELECT c.*, bm_mean, bm_median, bm_annual_mean, bm_monthly_mean, bm_daily_mean, bm_monthly_median FROM c LEFT JOIN a ON a.basin=c.basin LEFT JOIN yy ON yy.basin=c.basin AND yy.k=year(d) LEFT JOIN mm ON mm.basin=c.basin AND mm.k=month(d) LEFT JOIN dd ON dd.basin=c.basin AND dd.k=dayofyear(d))"""
LONG = "u AS (" + " UNION ALL ".join(f"SELECT basin, cal, '{n}' AS benchmark, q AS obs, {n} AS sim FROM f WHERE {n} IS NOT NULL" for n in NAMES) + "), sc AS (SELECT basin, benchmark, cal, count(*) AS n, sqrt(avg(pow(sim-obs,2))) AS rmse, 1-sum(pow(sim-obs,2))/nullif(var_pop(obs)*count(*), 0) AS nse, CASE WHEN min(sim)<max(sim) THEN 1-sqrt(pow(corr(sim,obs)-1,2)+pow(stddev_samp(sim)/nullif(stddev_samp(obs),0)-1,2)+pow(avg(sim)/nullif(avg(obs),0)-1,2)) END AS kge FROM u GROUP BY 1, 2, 3), t AS (SELECT basin, benchmark FROM sc WHERE cal AND kge IS NOT NULL QUALIFY row_number() OVER (PARTITION BY basin ORDER BY kge DESC, benchmark)<={k})"
UU = "uu AS (" + " UNION ALL ".join(f"SELECT basin, d, '{n}' AS benchmark, {n} AS v FROM f" for n in NAMES) + ")"
# fronts by steps: who is dominated by a row of front r has front r + 1 at least
FRONTS = "WITH RECURSIVE e AS (SELECT a.id, b.id AS over FROM {s} a JOIN {s} b ON {d}), r AS (SELECT id, 0 AS front FROM {s} UNION SELECT e.id, front+1 FROM r JOIN e ON e.over=r.id) SELECT id, max(front) AS front FROM r GROUP BY 1"
P3 = "(SELECT 'p1' AS parameter, p1 AS v, score AS s, l_orderkey, l_linenumber FROM samples UNION ALL SELECT 'p2', p2, score, l_orderkey, l_linenumber FROM samples UNION ALL SELECT 'p3', p3, score, l_orderkey, l_linenumber FROM samples)"
RANK = "rank() OVER (PARTITION BY parameter ORDER BY {c}) + (count(*) OVER (PARTITION BY parameter, {c}) - 1)/2.0"
TOTAL = f"""WITH k AS (SELECT parameter, v, avg(s) AS y FROM {P3} WHERE s IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, lead(v) OVER w AS v2, lead(y) OVER w AS y2 FROM k WINDOW w AS (PARTITION BY parameter ORDER BY v)), bo AS (SELECT parameter, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM k GROUP BY 1),
pt AS (SELECT parameter, i, s, lo+(hi-lo)*(('0x'||substr(md5(parameter||':'||i||':'||s),1,8))::BIGINT/4294967296.0::DOUBLE) AS x FROM bo, (SELECT unnest(range(1,1025)) AS i), (SELECT unnest(['A','B']) AS s)),
g AS (SELECT pt.parameter, i, pt.s, CASE WHEN v2>v THEN y+(y2-y)*(x-v)/(v2-v) ELSE y END/3 AS g FROM pt JOIN l ON l.parameter=pt.parameter AND v<=x AND (x<v2 OR v2 IS NULL)),
ab AS (SELECT parameter, i, max(CASE WHEN s='A' THEN g END) AS a, max(CASE WHEN s='B' THEN g END) AS b FROM g GROUP BY 1, 2), t AS (SELECT i, sum(a) AS fa, sum(b) AS fb FROM ab GROUP BY 1), vv AS (SELECT var_pop(f) AS v FROM (SELECT fa AS f FROM t UNION ALL SELECT fb FROM t)) SELECT parameter, avg(pow(a-b,2))/2/(SELECT v FROM vv) AS st FROM ab GROUP BY 1"""
MI = "{n}d AS (SELECT *, count(*) OVER g AS n, min(obs) OVER g AS lx, max(obs) OVER g AS hx, min(sim) OVER g AS ly, max(sim) OVER g AS hy FROM {t} WINDOW g AS (PARTITION BY basin, rep)), {n}b AS (SELECT basin, rep, n, CASE WHEN hx>lx THEN least(floor((obs-lx)/(hx-lx)*8),7) ELSE 0 END AS bx, CASE WHEN hy>ly THEN least(floor((sim-ly)/(hy-ly)*8),7) ELSE 0 END AS bz FROM {n}d WHERE n>=15), {n}c AS (SELECT basin, rep, n, bx, bz, count(*)::DOUBLE AS c FROM {n}b GROUP BY ALL), {n} AS (SELECT basin, rep, sum(c/n*ln(c*n/(cx*cy))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY basin, rep, bx) AS cx, sum(c) OVER (PARTITION BY basin, rep, bz) AS cy FROM {n}c) GROUP BY 1, 2)"
SHUFFLED = f"""WITH r AS (SELECT basin, obs, sim, rep, row_number() OVER (PARTITION BY basin, rep ORDER BY md5(d::VARCHAR)) AS i, row_number() OVER (PARTITION BY basin, rep ORDER BY md5(rep||':'||d::VARCHAR)) AS j FROM pairs, (SELECT unnest(range(1,11)) AS rep) WHERE obs IS NOT NULL AND sim IS NOT NULL), sh AS (SELECT a.basin, a.rep, a.obs, b.sim FROM r a JOIN r b ON a.basin=b.basin AND a.rep=b.rep AND a.i=b.j), one AS (SELECT basin, 0 AS rep, obs, sim FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL), {MI.format(n='ms', t='sh')}, {MI.format(n='mo', t='one')}, ed AS (SELECT basin, quantile_cont(mi, 0.95) AS edge FROM ms GROUP BY 1) SELECT mo.basin, mi, edge, mi>edge AS significant FROM mo JOIN ed ON ed.basin=mo.basin"""
CUM = "list_transform(range(1, len(a)+1), lambda i: list_sum(a[1:i]))"
LAYERS = "SELECT vec_id, list_transform(embedding[1:6], lambda v: abs(v::DOUBLE)+0.05) AS a, list_transform(embedding[7:12], lambda v: abs(v::DOUBLE)*4) AS s FROM embeddings"


def cal(v):
    return b.split_mid_year(v.wb, ["basin"], "d")


def layers(v):
    return v.table("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda k: F.abs(k.cast("double")) + 0.05).alias("a"), F.transform(F.slice("embedding", 7, 6), lambda k: F.abs(k.cast("double")) * 4).alias("s"))


QUERIES = [
    Query("d16_benchmark_input", "basin:s d:d q:f p:f t:f", lambda v: b.benchmark_input(v.flow_daily, v.precip_daily, ["basin"], "d"), "SELECT basin, d, q, p, t FROM wb"),
    Query("d17_split", "basin:s d:d cal:b", cal, f"WITH {CAL} SELECT basin, d, cal FROM c"),
    Query("d18_flow_benchmarks", "basin:s d:d " + " ".join(f"{n}:f" for n in NAMES), lambda v: b.flow_benchmarks(cal(v), ["basin"], "d"), f"WITH {BM} SELECT * FROM f"),
    Query("d19_ratio_benchmarks", "basin:s d:d rr_all:f rr_annual:f rr_monthly:f rr_daily:f rr_step:f", lambda v: b.ratio_benchmarks(cal(v), ["basin"], "d"), f"WITH {RR} SELECT c.basin, d, rr*avg(p) OVER (PARTITION BY c.basin) AS rr_all, rr*avg(p) OVER (PARTITION BY c.basin, year(d)) AS rr_annual, rr*avg(p) OVER (PARTITION BY c.basin, month(d)) AS rr_monthly, rr*avg(p) OVER (PARTITION BY c.basin, dayofyear(d)) AS rr_daily, rr*p AS rr_step FROM c JOIN rr ON rr.basin=c.basin"),
    Query("d20_monthly_ratio", "basin:s d:d mrr_monthly:f mrr_daily:f mrr_step:f", lambda v: b.monthly_ratio_benchmarks(cal(v), ["basin"], "d"), f"WITH {CAL}, rr AS (SELECT basin, month(d) AS m, sum(q)/sum(p) AS rr FROM c WHERE cal GROUP BY 1, 2) SELECT c.basin, d, rr*avg(p) OVER (PARTITION BY c.basin, month(d)) AS mrr_monthly, rr*avg(p) OVER (PARTITION BY c.basin, dayofyear(d)) AS mrr_daily, rr*p AS mrr_step FROM c LEFT JOIN rr ON rr.basin=c.basin AND rr.m=month(d)"),
    Query("d21_precip_benchmarks", "basin:s d:d scaled:f lag:i width:i adjusted:f smoothed:f", lambda v: b.precip_benchmarks(cal(v), ["basin"], "d", 3, 3),
          f"WITH {RR}, z AS (SELECT c.*, rr*p AS scaled FROM c JOIN rr ON rr.basin=c.basin), l AS (SELECT *, " + ", ".join(f"lag(scaled, {i}) OVER w AS l{i}, avg(scaled) OVER (PARTITION BY basin ORDER BY d ROWS BETWEEN {i} PRECEDING AND CURRENT ROW) AS w{i}" for i in range(4)) + " FROM z WINDOW w AS (PARTITION BY basin ORDER BY d)), e AS (SELECT basin, " + ", ".join(f"avg(pow({k}{i}-q,2)) FILTER (cal) AS {k}{i}" for k in "lw" for i in range(4)) + " FROM l GROUP BY 1), k AS (SELECT basin, list_position([l0,l1,l2,l3], least(l0,l1,l2,l3))-1 AS lag, list_position([w0,w1,w2,w3], least(w0,w1,w2,w3))-1 AS width FROM e) SELECT l.basin, d, scaled, lag, width, [l0,l1,l2,l3][lag+1] AS adjusted, [w0,w1,w2,w3][width+1] AS smoothed FROM l JOIN k ON k.basin=l.basin"),
    Query("d22_scores", "basin:s benchmark:s cal:b n:i rmse:f nse:f kge:f", lambda v: b.benchmark_scores(b.flow_benchmarks(cal(v), ["basin"], "d"), ["basin"], NAMES), f"WITH {BM}, {LONG.format(k=5)} SELECT * FROM sc"),
    Query("d23_envelope", "basin:s d:d lo:f hi:f", lambda v: (lambda f: b.envelope(f, b.benchmark_scores(f, ["basin"], NAMES), ["basin"], "d", NAMES, 2))(b.flow_benchmarks(cal(v), ["basin"], "d")), f"WITH {BM}, {LONG.format(k=2)}, {UU} SELECT uu.basin, d, min(v) AS lo, max(v) AS hi FROM uu JOIN t ON t.basin=uu.basin AND t.benchmark=uu.benchmark GROUP BY 1, 2"),
    Query("d23_duration", "basin:s point:i lo:f q25:f median:f q75:f hi:f", lambda v: (lambda f: b.duration_envelope(f, b.benchmark_scores(f, ["basin"], NAMES), ["basin"], NAMES, 5))(b.flow_benchmarks(cal(v), ["basin"], "d")),
          f"WITH {BM}, {LONG.format(k=5)}, {UU}, r AS (SELECT uu.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY uu.basin, uu.benchmark) AS n, lead(v) OVER w AS nv FROM uu JOIN t ON t.basin=uu.basin AND t.benchmark=uu.benchmark WHERE v IS NOT NULL WINDOW w AS (PARTITION BY uu.basin, uu.benchmark ORDER BY v DESC)), xx AS (SELECT unnest(range(1000)) AS point), zz AS (SELECT r.basin, point, v+(coalesce(nv,v)-v)*(greatest(1.0::DOUBLE, point/999.0::DOUBLE*n)-i) AS z FROM r JOIN xx ON i=least(n, floor(greatest(1.0::DOUBLE, point/999.0::DOUBLE*n)))) SELECT basin, point, min(z) AS lo, quantile_cont(z,0.25) AS q25, median(z) AS median, quantile_cont(z,0.75) AS q75, max(z) AS hi FROM zz GROUP BY 1, 2"),
    Query("d23_summary", "basin:s benchmark:s mean:f std:f cv:f q25:f q50:f q75:f", lambda v: b.benchmark_summary(b.flow_benchmarks(cal(v), ["basin"], "d"), ["basin"], NAMES), f"WITH {BM}, {UU} SELECT basin, benchmark, avg(v) AS mean, stddev_samp(v) AS std, stddev_samp(v)/nullif(avg(v),0) AS cv, quantile_cont(v,0.25) AS q25, median(v) AS q50, quantile_cont(v,0.75) AS q75 FROM uu WHERE v IS NOT NULL GROUP BY 1, 2"),
    Query("d24_decisions", "decision:s option:s mean:f n:i", lambda v: x.decision_impact(v.table("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), "SELECT 'l_returnflag' AS decision, l_returnflag AS option, avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, avg(l_extendedprice), count(*) FROM lineitem GROUP BY 2"),
    Query("d25_best_rows", "metric:s id:i f1:f f2:f", lambda v: x.best_rows(v.solutions, ["id", "f1", "f2"], {"f1": False, "f2": True}), "(SELECT 'f1' AS metric, * FROM solutions ORDER BY f1 DESC, id LIMIT 1) UNION ALL (SELECT 'f2', * FROM solutions ORDER BY f2, id LIMIT 1)"),
    Query("d27_spearman", "parameter:s spearman:f", lambda v: x.spearman_sensitivity(v.samples, ["p1", "p2", "p3"], "score"), f"WITH r AS (SELECT parameter, {RANK.format(c='v')} AS a, {RANK.format(c='s')} AS b FROM {P3}) SELECT parameter, abs(corr(a, b)) AS spearman FROM r GROUP BY 1"),
    Query("d28_rbd_fast", "parameter:s s1:f", lambda v: x.rbd_fast(v.samples.withColumn("l_score", F.col("score")), ["p1", "p2", "p3"], "score", ["l_orderkey", "l_linenumber", "l_score"], 4),
          f"WITH a AS (SELECT parameter, s AS y, count(*) OVER (PARTITION BY parameter) AS n, row_number() OVER (PARTITION BY parameter ORDER BY v, l_orderkey, l_linenumber, s)-1 AS i FROM {P3}), j AS (SELECT *, CASE WHEN i%2=0 THEN i//2 ELSE n-1-i//2 END AS j FROM a), p AS (SELECT parameter, max(n) AS n, var_pop(y) AS vy, " + "+".join(f"pow(sum(y*cos(2*pi()*{k}*j/n)),2)+pow(sum(y*sin(2*pi()*{k}*j/n)),2)" for k in range(1, 5)) + " AS p FROM j GROUP BY 1), s AS (SELECT parameter, 2*p/(n*n::DOUBLE)/vy AS s, 8.0::DOUBLE/n AS l FROM p) SELECT parameter, s-l/(1-l)*(1-s) AS s1 FROM s"),
    Query("d29_total_order", "parameter:s st:f", lambda v: x.total_order(v.samples, ["p1", "p2", "p3"], "score"), TOTAL),
    Query("d30_mutual_information", "basin:s mi:f", lambda v: x.mutual_information(v.pairs, ["basin"], "obs", "sim", 8),
          "WITH b AS (SELECT basin, min(obs) AS a1, max(obs) AS b1, min(sim) AS a2, max(sim) AS b2, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*)>=15), j AS (SELECT p.basin, least(floor((obs-a1)/(b1-a1)*8),7) AS x, least(floor((sim-a2)/(b2-a2)*8),7) AS y, n, count(*) AS c FROM pairs p JOIN b ON b.basin=p.basin GROUP BY 1, 2, 3, 4), k AS (SELECT *, sum(c) OVER (PARTITION BY basin, x) AS cx, sum(c) OVER (PARTITION BY basin, y) AS cy FROM j) SELECT basin, sum(c/n*ln(c*n/(cx*cy))) AS mi FROM k GROUP BY 1"),
    Query("d31_significance", "basin:s mi:f edge:f significant:b", lambda v: x.mi_significance(v.pairs, ["basin"], "obs", "sim", ["d"], 10, 8), SHUFFLED),
    Query("d32_pareto", "id:i f1:f f2:f", lambda v: x.pareto_front(v.solutions, "f1", "f2"), "SELECT * FROM solutions a WHERE NOT EXISTS (SELECT 1 FROM solutions b WHERE b.f1>=a.f1 AND b.f2>=a.f2 AND (b.f1>a.f1 OR b.f2>a.f2))"),
    Query("d32_pareto_ranks", "id:i front:i", lambda v: x.pareto_ranks(v.solutions, ["f1", "f2"], 500), FRONTS.format(d="b.f1>=a.f1 AND b.f2>=a.f2 AND (b.f1>a.f1 OR b.f2>a.f2)", s="solutions")),
    Query("d32_three_objectives", "id:i front:i", lambda v: x.pareto_ranks(v.solutions.withColumn("f3", F.col("id") * 37 % 101), ["f1", "f2", "f3"]), FRONTS.format(d="b.f1>=a.f1 AND b.f2>=a.f2 AND b.f3>=a.f3 AND (b.f1>a.f1 OR b.f2>a.f2 OR b.f3>a.f3)", s="(SELECT *, id*37%101 AS f3 FROM solutions)")),
    Query("d33_crowding", "id:i crowding:f boundary:b", lambda v: x.crowding_distance(v.solutions.withColumn("g", F.col("id") % 5), ["g"], "id", ["f1", "f2"]).selectExpr("id", "CASE WHEN crowding < 1e300 THEN crowding END AS crowding", "crowding >= 1e300 AS boundary"), "WITH s AS (SELECT id, id%5 AS g, f1, f2 FROM solutions), c AS (SELECT id, (lead(f1) OVER (PARTITION BY g ORDER BY f1, id)-lag(f1) OVER (PARTITION BY g ORDER BY f1, id))/(max(f1) OVER (PARTITION BY g)-min(f1) OVER (PARTITION BY g)) AS a, (lead(f2) OVER (PARTITION BY g ORDER BY f2, id)-lag(f2) OVER (PARTITION BY g ORDER BY f2, id))/(max(f2) OVER (PARTITION BY g)-min(f2) OVER (PARTITION BY g)) AS b FROM s) SELECT id, a+b AS crowding, a IS NULL OR b IS NULL AS boundary FROM c"),
    Query("d34_composite", "id:i composite:f", lambda v: x.composite_best(v.solutions.selectExpr("id", "f1 / 2000 AS nse", "f2 / 50 AS kge"), "id", "nse", "kge"), "SELECT id, (f1/2000+1)/2+(f2/50+1)/2 AS composite FROM solutions ORDER BY 2 DESC, 1 LIMIT 1"),
    Query("d34_knee", "id:i distance:f", lambda v: x.knee_point(x.pareto_front(v.solutions, "f1", "f2"), "id", "f1", "f2"), "WITH p AS (SELECT * FROM solutions a WHERE NOT EXISTS (SELECT 1 FROM solutions b WHERE b.f1>=a.f1 AND b.f2>=a.f2 AND (b.f1>a.f1 OR b.f2>a.f2))), b AS (SELECT min(f1) AS a1, max(f1) AS b1, min(f2) AS a2, max(f2) AS b2 FROM p) SELECT id, sqrt(pow(1-CASE WHEN b1>a1 THEN (f1-a1)/(b1-a1) ELSE 1 END,2)+pow(1-CASE WHEN b2>a2 THEN (f2-a2)/(b2-a2) ELSE 1 END,2)) AS distance FROM p, b ORDER BY 2, 1 LIMIT 1"),
    Query("d35_diversity", "label:i mean_distance:f", lambda v: x.mean_pairwise_distance(v.table("embeddings"), ["label"], "embedding"), "SELECT a.label, avg(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))) FILTER (a.vec_id < b.vec_id) AS mean_distance FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label"),
    Query("d36_history", "g:i best:f mean:f std:f valid:i running_best:f change_pct:f stagnation:i", lambda v: x.history(v.samples.withColumn("g", F.col("l_orderkey") % 40), "g", "score"), "WITH a AS (SELECT l_orderkey%40 AS g, max(score) AS best, avg(score) AS mean, stddev_pop(score) AS std, count(score) AS valid FROM samples GROUP BY 1), r AS (SELECT *, max(best) OVER (ORDER BY g) AS running_best FROM a), c AS (SELECT *, lag(running_best) OVER (ORDER BY g) AS p FROM r), i AS (SELECT *, sum(CASE WHEN running_best>p THEN 1 ELSE 0 END) OVER (ORDER BY g) AS i FROM c) SELECT g, best, mean, std, valid, running_best, 100*(running_best-p)/abs(p) AS change_pct, row_number() OVER (PARTITION BY i ORDER BY g)-1 AS stagnation FROM i"),
    Query("d37_runtime", "event_type:s lo:f hi:f mean:f std:f p50:f p95:f p99:f success:f", lambda v: x.runtime_summary(v.table("events").withColumn("ok", F.col("user_id") % 9 != 0), ["event_type"], "value", "ok"), "WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS std, max(value) FILTER (i=floor(n*0.5)) AS p50, max(value) FILTER (i=floor(n*0.95::DOUBLE)) AS p95, max(value) FILTER (i=floor(n*0.99::DOUBLE)) AS p99, avg(CASE WHEN user_id%9<>0 THEN 1.0::DOUBLE ELSE 0 END) AS success FROM i GROUP BY 1"),
    Query("d38_uncertainty", "parameter:s mean:f std:f p5:f p95:f cv:f", lambda v: x.uncertainty(v.samples, ["p1", "p2", "p3"]), f"SELECT parameter, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v,0.05) AS p5, quantile_cont(v,0.95) AS p95, stddev_pop(v)/abs(avg(v)) AS cv FROM {P3} GROUP BY 1"),
    Query("d39_forcing_summary", "basin:s variable:s mean:f std:f", lambda v: x.forcing_summary(v.precip_daily, ["basin"], ["p", "t"]), "SELECT basin, 'p' AS variable, avg(p) AS mean, stddev_pop(p) AS std FROM precip_daily GROUP BY 1 UNION ALL SELECT basin, 't', avg(t), stddev_pop(t) FROM precip_daily GROUP BY 1"),
    Query("d40_rollup", "n_regionkey:i c_nationkey:i level:i total:f weighted:f plain:f", lambda v: x.area_rollup(v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("area", F.abs("c_acctbal")), "n_regionkey", "c_nationkey", "c_custkey", "area"), "SELECT n_regionkey, c_nationkey, grouping(n_regionkey, c_nationkey) AS level, sum(abs(c_acctbal)) AS total, sum(c_custkey*abs(c_acctbal))/sum(abs(c_acctbal)) AS weighted, avg(c_custkey) AS plain FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)"),
    Query("d41_total_flow", "d:d q:f n:i", lambda v: x.total_flow(v.flow_daily, "d", "q"), "SELECT d, sum(q) AS q, count(*) AS n FROM flow_daily GROUP BY 1"),
    Query("g01_nearest_layer", "vec_id:i layer:i", lambda v: layers(v).select("vec_id", la.nearest_layer(F.col("a"), 0.5).alias("layer")), f"WITH l AS ({LAYERS}), c AS (SELECT vec_id, a, {CUM} AS c FROM l), m AS (SELECT vec_id, list_transform(range(1, len(a)+1), lambda i: abs(c[i]-a[i]/2-0.5)) AS m FROM c) SELECT vec_id, list_position(m, list_min(m))-1 AS layer FROM m"),
    Query("g02_rootzone", "vec_id:i mean:f", lambda v: layers(v).select("vec_id", la.rootzone_mean(F.col("s"), F.col("a"), 0.6).alias("mean")), f"WITH l AS ({LAYERS}), c AS (SELECT vec_id, s, {CUM} AS c FROM l), f AS (SELECT vec_id, s, list_filter(range(1, len(c)+1), lambda i: c[i]<=0.6::DOUBLE) AS k FROM c) SELECT vec_id, CASE WHEN len(k)>0 THEN list_sum(list_transform(k, lambda i: s[i]))/len(k) ELSE s[1] END AS mean FROM f"),
    Query("g03_water_table", "vec_id:i depth:f", lambda v: layers(v).select("vec_id", la.water_table(F.col("s"), F.col("a"), 0.8).alias("depth")), f"WITH l AS ({LAYERS}), c AS (SELECT vec_id, s, {CUM} AS c FROM l) SELECT vec_id, coalesce(list_max(list_transform(list_filter(range(1, len(c)+1), lambda i: s[i]>=0.8::DOUBLE), lambda i: c[i])), list_max(c)) AS depth FROM c"),
    Query("g04_components", "l_orderkey:i l_linenumber:i total:f", lambda v: la.sum_components(v.samples, ["p1", "p2", "p9"], "total"), "SELECT l_orderkey, l_linenumber, p1+p2 AS total FROM samples"),
    Query("g05_snow_cover", "cell_id:i sca:f", lambda v: v.cells.select("cell_id", la.snow_cover(F.when(F.col("cls") > 8, F.col("cls") / 17.0), F.col("elev") - 1100).alias("sca")), "SELECT cell_id, CASE WHEN cls>8 THEN cls/17.0::DOUBLE WHEN elev-1100>1 THEN 1 ELSE 0 END AS sca FROM cells"),
    Query("g07_rescale", "vec_id:i " + " ".join(f"r{i}:f" for i in range(6)), lambda v: layers(v).select("vec_id", la.rescale_depths(F.col("a"), 1.5, 0.7).alias("r")).selectExpr("vec_id", *[f"r[{i}] AS r{i}" for i in range(6)]), f"WITH l AS ({LAYERS}), w AS (SELECT vec_id, a, (exp(0)+exp(0.14)+exp(0.28)+exp(0.42)+exp(0.56)+exp(0.7))/6 AS m FROM l) SELECT vec_id, " + ", ".join(f"a[{i + 1}]*1.5*exp(0.7*{i}/5)/m AS r{i}" for i in range(6)) + " FROM w"),
    Query("f01_union", "basin:s d:d q:f p:f", lambda v: st.union_all([v.flow_daily, v.precip_daily.drop("t")]), "SELECT basin, d, q, NULL AS p FROM flow_daily UNION ALL SELECT basin, d, NULL, p FROM precip_daily"),
    Query("f02_common", "basin:s d:d", lambda v: st.common_keys([v.flow_daily, v.sim_daily, v.precip_daily], ["basin", "d"]), "SELECT basin, d FROM flow_daily INTERSECT SELECT basin, d FROM sim_daily"),
    Query("f03_missing", "basin:s d:d", lambda v: st.missing_keys(v.sim_daily, v.flow_daily, ["basin", "d"]), "SELECT basin, d FROM sim_daily EXCEPT SELECT basin, d FROM flow_daily"),
    Query("f04_sort", "seg:i unit_id:i length:f", lambda v: st.sort_units(v.network, ["unit_id", F.col("length").desc()]), "SELECT seg, unit_id, length FROM network"),
    Query("f05_top_k", "seg:i length:f", lambda v: st.top_k(v.network, [F.col("length").desc(), "seg"], 100), "SELECT seg, length FROM network ORDER BY length DESC, seg LIMIT 100"),
    Query("f06_consistent", "k:i a:i b:i", lambda v: st.inconsistent_keys({"a": v.table("customer").select(F.col("c_custkey").alias("k")), "b": v.table("orders").select(F.col("o_custkey").alias("k"))}, "k"), "SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT c_custkey AS k, count(*) AS a FROM customer GROUP BY 1) x FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1) y USING (k) WHERE coalesce(a,0)<>1 OR coalesce(b,0)<>1"),
    Query("a15_upsert", "basin:s d:d q:f p:f", lambda v: st.upsert(v.sim_daily, v.flow_daily.join(v.precip_daily.select("basin", "d", "p"), ["basin", "d"]), ["basin", "d"]), "SELECT coalesce(s.basin, w.basin) AS basin, coalesce(s.d, w.d) AS d, coalesce(w.q, s.q) AS q, w.p FROM sim_daily s FULL JOIN wb w ON w.basin=s.basin AND w.d=s.d"),
]
