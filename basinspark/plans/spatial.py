"""Queries over cells, zones and river networks."""

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import network as n
from ..operators import sets
from ..operators import spatial as s
from .base import Query

TOUCH = "touch AS (SELECT c.*, z.unit_id, z.xmin, z.xmax, z.ymin, z.ymax FROM cells c JOIN zones z ON c.x+0.5>z.xmin AND c.x-0.5<z.xmax AND c.y+0.5>z.ymin AND c.y-0.5<z.ymax)"
W = f"WITH {TOUCH}, ar AS (SELECT unit_id, cell_id, elev, (least(x+0.5,xmax)-greatest(x-0.5,xmin))*(least(y+0.5,ymax)-greatest(y-0.5,ymin)) AS area FROM touch), w AS (SELECT *, area/sum(area) OVER (PARTITION BY unit_id) AS w FROM ar)"
NET = "SELECT *, floor(length)%5 AS ord, (seg%13)/10.0::DOUBLE AS slope FROM network"


def inzone(v):
    return s.cells_in_zones(v.cells, v.zones)


# chains of eight with a loop back in every fifth, from which a sound reach hangs, and ids without neighbours
LOOPED = "looped AS (SELECT seg, CASE WHEN seg%8=7 THEN -1 WHEN seg%8=4 AND seg//8%5=1 THEN seg-2 WHEN seg%8=0 AND seg//8%7=3 THEN -1 WHEN seg%8=6 THEN -1 ELSE seg+1 END AS down FROM network UNION SELECT seg, seg+1 FROM network WHERE seg%8=4 AND seg//8%5=1)"


COVERS = "c AS (SELECT unit_id, 'a' AS dataset, CASE cls%4 WHEN 0 THEN 'crop' WHEN 1 THEN 'wood' WHEN 2 THEN 'town' ELSE 'bog' END AS kind, cls/20.0::DOUBLE AS f FROM inzone UNION ALL SELECT unit_id, 'b', CASE cls%3 WHEN 0 THEN 'crop' WHEN 1 THEN 'wood' ELSE 'sea' END, cls/30.0::DOUBLE FROM inzone WHERE cls>4)"


def _covers(v):
    d = inzone(v)
    a = d.selectExpr("unit_id", "'a' AS dataset", "CASE cls % 4 WHEN 0 THEN 'crop' WHEN 1 THEN 'wood' WHEN 2 THEN 'town' ELSE 'bog' END AS kind", "cls / 20.0D AS f")
    return a.unionByName(d.where("cls > 4").selectExpr("unit_id", "'b' AS dataset", "CASE cls % 3 WHEN 0 THEN 'crop' WHEN 1 THEN 'wood' ELSE 'sea' END AS kind", "cls / 30.0D AS f"))


def _rocks(v):
    return inzone(v).withColumn("rock", F.expr("CASE cls % 5 WHEN 0 THEN 'Sandstone' WHEN 1 THEN 'GRANITE, grey' WHEN 2 THEN 'gneiss' WHEN 3 THEN 'Limestone' ELSE 'water' END"))


def _hrus(v):
    return inzone(v).select(F.col("cell_id").alias("hru"), F.col("unit_id").alias("gru"), F.col("elev").alias("area"))


COAST = """WITH RECURSIVE z AS (SELECT * FROM zones WHERE unit_id%2=0), o AS (SELECT * FROM cells WHERE elev%7<5 AND cell_id NOT IN (SELECT cell_id FROM cells JOIN z ON x>=xmin AND x<xmax AND y>=ymin AND y<ymax)),
nz AS (SELECT cell_id, x, y, unit_id AS nearest FROM o, z QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY pow((xmin+xmax)/2-x,2)+pow((ymin+ymax)/2-y,2), unit_id)=1),
ne AS (SELECT a.cell_id AS a, b.cell_id AS b FROM nz a JOIN nz b ON a.nearest=b.nearest AND abs(a.x-b.x)+abs(a.y-b.y)=1), re AS (SELECT cell_id AS a, cell_id AS b FROM nz UNION SELECT re.a, ne.b FROM re JOIN ne ON re.b=ne.a),
pi AS (SELECT a AS cell_id, min(b) AS piece, count(*) AS n FROM re GROUP BY 1), k AS (SELECT DISTINCT nearest, piece FROM pi JOIN nz ON nz.cell_id=pi.cell_id WHERE n*0.04>0.1),
kk AS (SELECT *, row_number() OVER (ORDER BY nearest, piece)+(SELECT max(unit_id) FROM z) AS unit_id FROM k), al AS (SELECT pi.cell_id, nz.nearest, kk.unit_id FROM pi JOIN nz ON nz.cell_id=pi.cell_id JOIN kk ON kk.piece=pi.piece AND kk.nearest=nz.nearest)"""


def looped(v):
    k = "seg % 8 = 4 AND seg div 8 % 5 = 1"
    d = v.network.selectExpr("seg", f"CASE WHEN seg % 8 = 7 THEN -1 WHEN {k} THEN seg - 2 WHEN seg % 8 = 0 AND seg div 8 % 7 = 3 THEN -1 WHEN seg % 8 = 6 THEN -1 ELSE seg + 1 END AS down")
    return d.unionByName(v.network.where(k).selectExpr("seg", "seg + 1 AS down"))


def net(v):
    return v.network.withColumn("ord", F.floor("length") % 5).withColumn("slope", (F.col("seg") % 13) / 10.0)


def _aspect(v):
    return inzone(v).withColumn("deg", F.pmod(F.col("cell_id") * 7.0, F.lit(360.0)))


QUERIES = [
    Query("e01_grid", "cell_id:i xmin:f xmax:f ymin:f ymax:f", lambda v: s.grid_cells(v.cells.select(F.col("y").alias("i")).distinct().withColumn("lat", F.col("i") * 0.5), v.cells.select(F.col("x").alias("j")).distinct().withColumn("lon", F.col("j") * 0.25)), "WITH a AS (SELECT DISTINCT y AS i, y*0.5 AS lat FROM cells), b AS (SELECT DISTINCT x AS j, x*0.25 AS lon FROM cells) SELECT j*(SELECT count(*) FROM a)+i AS cell_id, lon-0.125 AS xmin, lon+0.125 AS xmax, lat-0.25 AS ymin, lat+0.25 AS ymax FROM a, b"),
    Query("e02_overlap", "unit_id:i cell_id:i area:f w:f", lambda v: s.overlap_weights(v.cells, v.zones), f"{W} SELECT unit_id, cell_id, area, w FROM w"),
    Query("e03_remap", "unit_id:i k:i elev:f", lambda v: s.remap(v.cells.select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "elev").withColumn("elev", F.when((F.col("cell_id") + F.col("k")) % 5 != 0, F.col("elev") * F.col("k"))), s.overlap_weights(v.cells, v.zones), "k", ["elev"], -9999.0), f"{W} SELECT unit_id, k, coalesce(sum(w*elev*k) FILTER ((cell_id+k)%5<>0)/sum(w) FILTER ((cell_id+k)%5<>0), -9999) AS elev FROM w, (VALUES (1),(2),(3)) t(k) GROUP BY 1, 2"),
    Query("e04_lapse", "unit_id:i t:f", lambda v: s.lapse_correct(v.zones.select("unit_id", F.lit(280.0).alias("t")), s.overlap_weights(v.cells, v.zones).join(v.cells.select("cell_id", F.col("elev").alias("forcing_elev")), "cell_id").withColumn("unit_elev", F.lit(1200.0)), "t"), f"{W} SELECT unit_id, 280+sum(w*0.0065*(elev-1200)) AS t FROM w GROUP BY 1"),
    Query("e05_missing_units", "unit_id:i", lambda v: sets.known_units(inzone(v), v.zones.where("unit_id < 10"), "unit_id")[1], "SELECT DISTINCT unit_id FROM inzone WHERE unit_id>=10"),
    Query("e05_known_units", "cell_id:i", lambda v: sets.known_units(inzone(v), v.zones.where("unit_id < 10"), "unit_id")[0], "SELECT cell_id FROM inzone WHERE unit_id<10"),
    Query("e06_zonal", "unit_id:i n:i lo:f mean:f hi:f std:f median:f", lambda v: s.zonal_stats(inzone(v), ["unit_id"], "elev"), "SELECT unit_id, count(*) AS n, min(elev) AS lo, avg(elev) AS mean, max(elev) AS hi, stddev_pop(elev) AS std, median(elev) AS median FROM inzone GROUP BY 1"),
    Query("e07_circular", "unit_id:i circ_mean:f circ_std:f", lambda v: s.circ_stats(_aspect(v), ["unit_id"], "deg"), "WITH a AS (SELECT unit_id, avg(sin(radians((cell_id*7)%360))) AS s, avg(cos(radians((cell_id*7)%360))) AS c FROM inzone GROUP BY 1) SELECT unit_id, CASE WHEN atan2(s,c)<0 THEN degrees(atan2(s,c))+360 ELSE degrees(atan2(s,c)) END AS circ_mean, degrees(sqrt(-2*ln(sqrt(s*s+c*c)))) AS circ_std FROM a"),
    Query("e08_in_zone", "cell_id:i unit_id:i", inzone, "SELECT cell_id, unit_id FROM inzone"),
    Query("e09_touching", "cell_id:i unit_id:i", lambda v: s.cells_touching_zones(v.cells, v.zones), f"WITH {TOUCH} SELECT cell_id, unit_id FROM touch"),
    Query("e10_histogram", "unit_id:i c1:i c2:i c3:i c17:i total:i", lambda v: s.zonal_histogram(inzone(v), ["unit_id"], "cls", [1, 2, 3, 17], "c"), "SELECT unit_id, count(*) FILTER (cls=1) AS c1, count(*) FILTER (cls=2) AS c2, count(*) FILTER (cls=3) AS c3, count(*) FILTER (cls=17) AS c17, count(*) AS total FROM inzone GROUP BY 1"),
    Query("e11_majority_soil", "unit_id:i majority:i", lambda v: s.majority_class(inzone(v).groupBy("unit_id", "cls").agg(F.count("*").alias("n")), ["unit_id"], "cls", "n", "soil"), "WITH n AS (SELECT unit_id, cls, count(*) AS n FROM inzone GROUP BY 1, 2), b AS (SELECT unit_id, cls FROM n WHERE cls BETWEEN 1 AND 12 QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, cls)=1) SELECT DISTINCT n.unit_id, coalesce(b.cls, 6) AS majority FROM n LEFT JOIN b ON b.unit_id=n.unit_id"),
    Query("e11_majority_land", "unit_id:i majority:i", lambda v: s.majority_class(inzone(v).groupBy("unit_id", "cls").agg(F.count("*").alias("n")), ["unit_id"], "cls", "n", "land"), "WITH n AS (SELECT unit_id, cls, count(*) AS n FROM inzone GROUP BY 1, 2) SELECT unit_id, cls AS majority FROM n QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY cls=17, n DESC, cls)=1"),
    Query("e12_fractions", "unit_id:i cls:i fraction:f dominant:i shannon:f", lambda v: s.class_fractions(inzone(v), ["unit_id"], "cls"), "WITH n AS (SELECT unit_id, cls, count(*) AS n FROM inzone GROUP BY 1, 2), f AS (SELECT *, n/sum(n) OVER (PARTITION BY unit_id) AS f FROM n), d AS (SELECT unit_id, cls AS dominant FROM n QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, cls)=1) SELECT f.unit_id, cls, f AS fraction, dominant, -sum(f*ln(f)) OVER (PARTITION BY f.unit_id) AS shannon FROM f JOIN d ON d.unit_id=f.unit_id"),
    Query("e13_irrigation", "unit_id:i cropland:f irrigated:f intensity:f", lambda v: s.irrigation(inzone(v), ["unit_id"], "cls"), "SELECT unit_id, c AS cropland, i AS irrigated, CASE WHEN c>0 THEN i/c END AS intensity FROM (SELECT unit_id, avg(CASE WHEN cls IN (1,2,3) THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(CASE WHEN cls IN (2,3) THEN 1.0::DOUBLE ELSE 0 END) AS i FROM inzone GROUP BY 1)"),
    Query("e14_diversity", "unit_id:i shannon:f simpson:f classes:i", lambda v: s.diversity(inzone(v), ["unit_id"], "cls"), "WITH f AS (SELECT unit_id, cls, count(*)/sum(count(*)) OVER (PARTITION BY unit_id) AS f FROM inzone GROUP BY 1, 2) SELECT unit_id, -sum(f*ln(f)) AS shannon, 1-sum(f*f) AS simpson, count(*) AS classes FROM f GROUP BY 1"),
    Query("e15_heights", "unit_id:i n:i skew:f kurt:f p5:f p25:f p50:f p75:f p95:f tall_share:f", lambda v: s.height_distribution(inzone(v), ["unit_id"], "elev", 1200.0), "WITH m AS (SELECT unit_id, elev, elev-avg(elev) OVER (PARTITION BY unit_id) AS x FROM inzone) SELECT unit_id, count(*) AS n, avg(x*x*x)/pow(avg(x*x),1.5) AS skew, avg(x*x*x*x)/pow(avg(x*x),2)-3 AS kurt, "
          + ", ".join(f"quantile_cont(elev,{p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + ", avg(CASE WHEN elev>=1200 THEN 1.0::DOUBLE ELSE 0 END) AS tall_share FROM m GROUP BY 1 HAVING count(*)>10"),
    Query("e16_weighted", "unit_id:i w_mean:f w_std:f lo:f hi:f", lambda v: s.weighted_stats(inzone(v), ["unit_id"], "elev", "cls"), "WITH m AS (SELECT unit_id, sum(elev*cls)/sum(cls) AS m FROM inzone GROUP BY 1) SELECT i.unit_id, max(m) AS w_mean, sqrt(sum(cls*(elev-m)*(elev-m))/sum(cls)) AS w_std, min(elev) AS lo, max(elev) AS hi FROM inzone i JOIN m ON m.unit_id=i.unit_id GROUP BY 1"),
    Query("e18_line_density", "unit_id:i n:i total:f density:f", lambda v: s.line_density(v.network, v.zones.withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), "unit_id", "length"), "SELECT z.unit_id, count(seg) AS n, coalesce(sum(length),0) AS total, coalesce(sum(length),0)/max((xmax-xmin)*(ymax-ymin)) AS density FROM zones z LEFT JOIN network n ON n.unit_id=z.unit_id GROUP BY 1"),
    Query("e19_lakes", "unit_id:i n:i total_area:f median:f mean_depth:f largest:i", lambda v: s.lake_stats(inzone(v), ["unit_id"], "elev", "cls", "cell_id"), "SELECT unit_id, count(*) AS n, sum(elev) AS total_area, median(elev) AS median, sum(elev*cls)/sum(elev) AS mean_depth, first(cell_id ORDER BY elev DESC, cell_id) AS largest FROM inzone GROUP BY 1"),
    Query("e20_rivers", "unit_id:i n:i total:f order_min:i order_max:i w_slope:f", lambda v: n.river_stats(net(v), ["unit_id"], "length", "ord", "slope"), f"SELECT unit_id, count(*) AS n, sum(length) AS total, min(ord) AS order_min, max(ord) AS order_max, sum(length*slope)/sum(length) AS w_slope FROM ({NET}) GROUP BY 1"),
    Query("e21_morphometry", "unit_id:i ord:i n:i total:f share:f bifurcation:f", lambda v: n.morphometry(net(v), ["unit_id"], "length", "ord"), f"WITH n AS (SELECT unit_id, ord, count(*) AS n, sum(length) AS total FROM ({NET}) GROUP BY 1, 2) SELECT *, n/sum(n) OVER (PARTITION BY unit_id) AS share, CASE WHEN lead(ord) OVER w=ord+1 THEN n/lead(n) OVER w END AS bifurcation FROM n WINDOW w AS (PARTITION BY unit_id ORDER BY ord)"),
    Query("e23_upstream", "outlet:i seg:i", lambda v: n.upstream(v.network, v.network.where("seg IN (5, 9, 700)").select("seg")), "WITH RECURSIVE u AS (SELECT seg AS outlet, seg FROM network WHERE seg IN (5, 9, 700) UNION SELECT outlet, n.seg FROM u JOIN network n ON n.down=u.seg) SELECT * FROM u"),
    Query("e22_nearest_segment", "cell_id:i seg:i distance:f", lambda v: s.nearest_segment(v.cells.select("cell_id", "x", "y"), v.network.selectExpr("seg", "seg % 40 AS x1", "seg div 40 AS y1", "seg % 40 + down % 3 AS x2", "seg div 40 + seg % 2 AS y2")), "WITH l AS (SELECT seg, seg%40 AS x1, seg//40 AS y1, down%3 AS dx, seg%2 AS dy FROM network), t AS (SELECT cell_id, x, y, l.*, CASE WHEN dx=0 AND dy=0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x-x1)*dx+(y-y1)*dy)::DOUBLE/(dx*dx+dy*dy))) END AS t FROM cells, l), d AS (SELECT cell_id, seg, pow(x1+t*dx-x, 2)+pow(y1+t*dy-y, 2) AS d2 FROM t) SELECT cell_id, seg, sqrt(d2) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY d2, seg)=1"),
    Query("e22_default_segment", "seg:i", lambda v: n.default_segment(v.network), "SELECT coalesce(min(CASE WHEN down=0 THEN seg END), min(seg)) AS seg FROM network"),
    Query("e24_subset", "seg:i length:f", lambda v: n.subset(v.network, n.upstream(v.network, v.network.where("seg = 5").select("seg")), "seg").select("seg", "length"), "WITH RECURSIVE u AS (SELECT seg FROM network WHERE seg=5 UNION SELECT n.seg FROM u JOIN network n ON n.down=u.seg) SELECT seg, length FROM network WHERE seg IN (SELECT seg FROM u)"),
    Query("e25_order", "seg:i level:i", lambda v: n.downstream_order(v.network), "WITH RECURSIVE r AS (SELECT seg, 0 AS level FROM network WHERE seg NOT IN (SELECT down FROM network) UNION SELECT n.down, level+1 FROM r JOIN network n ON n.seg=r.seg WHERE n.down IN (SELECT seg FROM network)) SELECT seg, max(level) AS level FROM r GROUP BY 1"),
    Query("e25_cycles", "seg:i level:i position:i", lambda v: n.positions(looped(v)), f"WITH RECURSIVE {LOOPED}, k AS (SELECT seg, down FROM looped WHERE down<>seg-2), r AS (SELECT seg, 0 AS level FROM k WHERE seg NOT IN (SELECT down FROM k) UNION SELECT k.down, level+1 FROM r JOIN k ON k.seg=r.seg WHERE k.down IN (SELECT seg FROM looped)), o AS (SELECT seg, max(level) AS level FROM r GROUP BY 1), i AS (SELECT seg FROM looped WHERE down>0 UNION SELECT down FROM looped WHERE down>0) SELECT seg, level, row_number() OVER (ORDER BY seg IN (SELECT seg FROM i), level, seg) AS position FROM o"),
    Query("e25_long_river", "seg:i level:i", lambda v: n.downstream_order(v.table("orders").select(F.col("o_orderkey").alias("seg"), (F.col("o_orderkey") - 1).alias("down"))), "SELECT seg, seg-first_value(seg) OVER (PARTITION BY seg-k ORDER BY seg) AS up, max(seg) OVER (PARTITION BY seg-k)-seg AS level FROM (SELECT o_orderkey AS seg, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)"),
    Query("e23_long_river", "outlet:i seg:i", lambda v: n.upstream(v.table("orders").select(F.col("o_orderkey").alias("seg"), (F.col("o_orderkey") - 1).alias("down")), v.table("orders").where("o_orderkey % 1000 = 7").select(F.col("o_orderkey").alias("seg"))), "WITH k AS (SELECT o_orderkey AS seg, o_orderkey-row_number() OVER (ORDER BY o_orderkey) AS run FROM orders), g AS (SELECT o_orderkey-1 AS seg FROM orders UNION SELECT o_orderkey FROM orders) SELECT o.seg AS outlet, k.seg FROM k o JOIN k ON k.run=o.run AND k.seg>=o.seg WHERE o.seg%1000=7"),
    Query("e26_unit_edges", "unit:i down_unit:i", lambda v: n.unit_edges(v.network), "SELECT DISTINCT a.unit_id AS unit, b.unit_id AS down_unit FROM network a JOIN network b ON a.down=b.seg WHERE a.unit_id<>b.unit_id"),
    Query("e27_down_neighbour", "seg:i down:i", lambda v: n.down_neighbour(v.network.select("seg", "unit_id", "length"), "unit_id", "seg", "length"), "SELECT seg, coalesce(lead(seg) OVER (PARTITION BY unit_id ORDER BY length DESC, seg), 0) AS down FROM network"),
    Query("e28_topology", "unit_id:i seg:i down:i area:f", lambda v: n.topology(v.network, v.zones.withColumn("area", F.lit(80.0))), "SELECT unit_id, seg, down, 80 AS area FROM network WHERE unit_id IN (SELECT unit_id FROM zones) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seg)=1"),
    Query("e29_spread", "seg:i by_area:f equal:f", lambda v: n.spread(v.zones.select("unit_id", (F.col("unit_id") * 10.0).alias("v")), v.network, "unit_id", "v", "length"), "SELECT seg, unit_id*10.0*length/sum(length) OVER (PARTITION BY unit_id) AS by_area, unit_id*10.0::DOUBLE/count(*) OVER (PARTITION BY unit_id) AS equal FROM network"),
    Query("e30_map_units", "unit_id:i block:i", lambda v: n.map_units(v.zones, "unit_id", 4), "SELECT unit_id, least(3, (row_number() OVER (ORDER BY unit_id)-1)//greatest(1,(SELECT count(*) FROM zones)//4)) AS block FROM zones"),
    Query("e31_outlet", "outlet:i", lambda v: n.outlet(v.network.select("seg", F.col("length").alias("q")), v.network.select("seg", "down")), "SELECT seg AS outlet FROM network ORDER BY length DESC, seg LIMIT 1"),
    Query("e32_discretise", "unit_id:i band:i cls:i area:i mean_value:f", lambda v: s.discretise(inzone(v), ["unit_id"], "elev", 100.0, ["cls"]), "WITH b AS (SELECT min(elev) AS a, max(elev) AS z FROM inzone), d AS (SELECT unit_id, cls, elev, least(floor((elev-a)/100), greatest(0, ceil((z-a)/100)-1)) AS band FROM inzone, b) SELECT unit_id, band, cls, count(*) AS area, avg(elev) AS mean_value FROM d GROUP BY 1, 2, 3"),
    Query("e33_terrain", "cell_id:i slope:f aspect:f", lambda v: s.terrain(v.cells),
          "WITH g AS (SELECT *, (coalesce(lead(elev) OVER r, elev)-coalesce(lag(elev) OVER r, elev))/nullif(coalesce(lead(x) OVER r, x)-coalesce(lag(x) OVER r, x),0) AS dx, (coalesce(lead(elev) OVER c, elev)-coalesce(lag(elev) OVER c, elev))/nullif(coalesce(lead(y) OVER c, y)-coalesce(lag(y) OVER c, y),0) AS dy FROM cells WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)), h AS (SELECT cell_id, coalesce(dx,0) AS dx, coalesce(dy,0) AS dy FROM g) SELECT cell_id, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope, CASE WHEN dx=0 AND dy=0 THEN 180 WHEN atan2(-dx,-dy)<0 THEN degrees(atan2(-dx,-dy))+360 ELSE degrees(atan2(-dx,-dy)) END AS aspect FROM h"),
    Query("e34_cell_mode", "user_id:i mode:i", lambda v: s.cell_mode(v.table("events").select("user_id", (F.col("event_id") % 7).alias("k")), "user_id", "k"), "SELECT user_id, k AS mode FROM (SELECT user_id, event_id%7 AS k, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k)=1"),
    Query("e35_mask_union", "cell_id:i", lambda v: sets.mask_union([v.cells.where("cls > 12"), v.cells.where("elev > 1500")], "cell_id"), "SELECT cell_id FROM cells WHERE cls>12 UNION SELECT cell_id FROM cells WHERE elev>1500"),
    Query("e36_elbow", "threshold:f", lambda v: s.elbow(v.cells.groupBy((F.col("cls") * 10.0).alias("t")).agg(F.avg("elev").alias("q")), "t", "q"), "WITH a AS (SELECT cls*10.0 AS t, log10(avg(elev)+1) AS y FROM cells GROUP BY 1), b AS (SELECT t, abs(lead(y) OVER w-2*y+lag(y) OVER w) AS c, lead(t) OVER w AS n FROM a WINDOW w AS (ORDER BY t)) SELECT n AS threshold FROM b WHERE c IS NOT NULL ORDER BY c DESC, t LIMIT 1"),
    Query("e37_merge_small", "unit:i merged:i", lambda v: n.merge_small(v.network.groupBy(F.col("unit_id").alias("unit")).agg(F.sum("length").alias("area")), n.unit_edges(v.network).select(F.col("unit").alias("a"), F.col("down_unit").alias("b")), 280_000.0)),
    Query("e38_nearest", "cell_id:i unit_id:i distance:f", lambda v: s.nearest_zone(v.cells.select("cell_id", "x", "y"), v.zones), "SELECT cell_id, unit_id, sqrt(d) AS distance FROM (SELECT cell_id, unit_id, pow((xmin+xmax)/2-x,2)+pow((ymin+ymax)/2-y,2) AS d FROM cells, zones) QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY d, unit_id)=1"),
    Query("e38_allocate", "cell_id:i nearest:i unit_id:i", lambda v: s.allocate(v.cells.where("elev % 7 < 5"), v.zones.where("unit_id % 2 = 0"), 0.04), f"{COAST} SELECT cell_id, nearest, unit_id FROM al"),
    Query("e38_coast", "unit_id:i area:f seg:i coastal:b", lambda v: (lambda z: s.with_coast(z.withColumn("area", F.lit(80.0)).withColumn("seg", F.col("unit_id") + 1), s.allocate(v.cells.where("elev % 7 < 5"), z, 0.04), 0.04))(v.zones.where("unit_id % 2 = 0")), f"{COAST} SELECT unit_id, 80.0 AS area, unit_id+1 AS seg, false AS coastal FROM z UNION ALL SELECT unit_id, count(*)*0.04::DOUBLE, 0, true FROM al GROUP BY 1"),
    Query("e40_point_unit", "cell_id:i xmin:f ymax:f down:i", lambda v: s.point_unit(v.cells, 0.25), "SELECT cell_id, x-0.25 AS xmin, y+0.25 AS ymax, 0 AS down FROM cells"),
    Query("e30_replicate", "unit_id:i hru:i", lambda v: n.replicate_units(v.zones, 3), "SELECT unit_id, hru FROM zones, (SELECT unnest([1, 2, 3]) AS hru)"),
    Query("e32_quantile_aspect", "unit_id:i quantile:i sector:i area:i mean_value:f", lambda v: s.discretise(s.quantile_class(inzone(v), "elev", 4).withColumn("sector", c.aspect_class(F.pmod(F.col("cell_id") * 7.0, F.lit(360.0)))), ["unit_id"], "elev", 1e9, ["quantile", "sector"]),
          "WITH b AS (SELECT quantile_cont(elev, [0.25, 0.5, 0.75]) AS b FROM inzone), d AS (SELECT unit_id, elev, CASE WHEN elev>=b[3] THEN 3 WHEN elev>=b[2] THEN 2 WHEN elev>=b[1] THEN 1 ELSE 0 END AS quantile, floor(((cell_id*7)%360+22.5)%360/45)+1 AS sector FROM inzone, b) SELECT unit_id, quantile, sector, count(*) AS area, avg(elev) AS mean_value FROM d GROUP BY 1, 2, 3"),
    Query("e33_horn", "cell_id:i slope:f aspect:f", lambda v: s.terrain_horn(v.cells),
          "WITH r AS (SELECT c.cell_id, c.x, c.y, coalesce(e.elev,c.elev)-coalesce(w.elev,c.elev) AS df, coalesce(w.elev,c.elev)+2*c.elev+coalesce(e.elev,c.elev) AS sm FROM cells c LEFT JOIN cells w ON w.x=c.x-1 AND w.y=c.y LEFT JOIN cells e ON e.x=c.x+1 AND e.y=c.y), g AS (SELECT r.cell_id, (coalesce(b.df,r.df)+2*r.df+coalesce(a.df,r.df))/8 AS dx, (coalesce(a.sm,r.sm)-coalesce(b.sm,r.sm))/8 AS dy FROM r LEFT JOIN r b ON b.x=r.x AND b.y=r.y-1 LEFT JOIN r a ON a.x=r.x AND a.y=r.y+1) SELECT cell_id, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope, CASE WHEN dx=0 AND dy=0 THEN 180 WHEN atan2(-dx,-dy)<0 THEN degrees(atan2(-dx,-dy))+360 ELSE degrees(atan2(-dx,-dy)) END AS aspect FROM g"),
    Query("e20_sinuosity", "unit_id:i n:i w_sinuosity:f", lambda v: n.river_stats(net(v).withColumn("chord", F.col("length") / (1 + F.col("seg") % 3) * F.when(F.col("seg") % 11 == 0, 0).otherwise(1)), ["unit_id"], "length", "ord", "slope", "chord"),
          f"SELECT unit_id, count(*) AS n, sum(CASE WHEN seg%11<>0 AND length>0 THEN length*(1+seg%3) END)/sum(CASE WHEN seg%11<>0 AND length>0 THEN length END) AS w_sinuosity FROM ({NET}) GROUP BY 1"),
    Query("e21_mean_slope", "unit_id:i ord:i mean_slope:f", lambda v: n.morphometry(net(v), ["unit_id"], "length", "ord", "slope"), f"SELECT unit_id, ord, avg(slope) AS mean_slope FROM ({NET}) GROUP BY 1, 2"),
    Query("e14_composite", "unit_id:i kind:s composite:f shannon:f simpson:f anthropogenic:f natural_share:f", lambda v: s.composite_cover(_covers(v), "unit_id", "dataset", "kind", "f", ["crop", "town"]), f"WITH {COVERS}, o AS (SELECT unit_id, dataset, kind, avg(f) AS f FROM c GROUP BY 1, 2, 3), g AS (SELECT unit_id, kind, avg(f) AS composite FROM o GROUP BY 1, 2), p AS (SELECT *, composite/sum(composite) OVER u AS p, sum(CASE WHEN kind IN ('crop','town') THEN composite ELSE 0 END) OVER u AS anthropogenic, sum(composite) OVER u AS tot FROM g WINDOW u AS (PARTITION BY unit_id)) SELECT unit_id, kind, composite, -sum(p*ln(p)) OVER u AS shannon, 1-sum(p*p) OVER u AS simpson, anthropogenic, tot-anthropogenic AS natural_share FROM p WINDOW u AS (PARTITION BY unit_id)"),
    Query("e17_categories", "unit_id:i category:s fraction:f", lambda v: s.lithology_categories(_rocks(v), ["unit_id"], "rock", "elev", {"sedimentary": ["sand", "lime"], "igneous": ["granite", "SAND"], "metamorphic": ["gneiss"]}), "WITH r AS (SELECT unit_id, elev, CASE cls%5 WHEN 0 THEN 'Sandstone' WHEN 1 THEN 'GRANITE, grey' WHEN 2 THEN 'gneiss' WHEN 3 THEN 'Limestone' ELSE 'water' END AS rock FROM inzone), c AS (SELECT unit_id, elev, CASE WHEN rock IN ('Sandstone','Limestone') THEN 'sedimentary' WHEN rock='gneiss' THEN 'metamorphic' WHEN rock<>'water' THEN 'igneous' END AS category FROM r) SELECT unit_id, category, sum(elev)/sum(sum(elev)) OVER (PARTITION BY unit_id) AS fraction FROM c WHERE category IS NOT NULL GROUP BY 1, 2"),
    Query("e19_lake_indices", "unit_id:i lakes:i percent:f density:f volume:f residence:f", lambda v: s.lake_indices(inzone(v).where("cls < 6").withColumns({"vol": F.col("elev") * 1e6, "res": F.when(F.col("cls") > 1, F.col("cls") * 1.5)}), "unit_id", "elev", "vol", "res", v.zones.withColumn("a", F.lit(80000.0)), "a"), "SELECT z.unit_id, count(i.cell_id) AS lakes, 100*coalesce(sum(elev),0)/80000 AS percent, count(i.cell_id)/80000.0::DOUBLE AS density, coalesce(sum(elev*1e6)/1e9,0) AS volume, sum(elev*cls*1.5) FILTER (cls>1)/sum(elev) FILTER (cls>1) AS residence FROM zones z LEFT JOIN (SELECT * FROM inzone WHERE cls<6) i ON i.unit_id=z.unit_id GROUP BY 1"),
    Query("e21_shape", "unit_id:i elongation:f form_factor:f circularity:f headwaters:i headwater_density:f", lambda v: n.basin_shape(v.zones.selectExpr("unit_id", "(xmax-xmin)*(ymax-ymin) AS a", "sqrt(pow(xmax-xmin,2)+pow(ymax-ymin,2)) AS l", "2*(xmax-xmin+ymax-ymin) AS p"), net(v), "unit_id", "a", "l", "p", "ord"), f"SELECT z.unit_id, 2*sqrt(80/pi())/sqrt(164) AS elongation, 80/164.0::DOUBLE AS form_factor, 4*pi()*80/pow(36,2) AS circularity, count(s.seg) AS headwaters, count(s.seg)/80.0::DOUBLE AS headwater_density FROM zones z LEFT JOIN (SELECT * FROM ({NET}) WHERE ord=1) s ON s.unit_id=z.unit_id GROUP BY 1"),
    Query("e28_routing", "unit:i seg:i area:f", lambda v: n.routing_table(_hrus(v), v.network), "SELECT i.unit_id AS unit, min(n.seg) AS seg, max(i.a) AS area FROM (SELECT unit_id, sum(elev) AS a FROM inzone GROUP BY 1) i JOIN network n ON n.unit_id=i.unit_id GROUP BY 1"),
    Query("e28_single", "unit:i seg:i area:f", lambda v: n.routing_table(_hrus(v).withColumn("gru", F.lit(-5)), v.network), "SELECT -5 AS unit, (SELECT min(seg) FROM network) AS seg, sum(elev) AS area FROM inzone"),
    Query("e28_lumped", "unit:i seg:i area:f", lambda v: n.routing_table(_hrus(v), v.network, lumped=v.network.select("seg", (F.col("seg") % 10 / 100).alias("fraction"))), "SELECT seg AS unit, seg, (seg%10)/100.0::DOUBLE*(SELECT sum(elev) FROM inzone) AS area FROM network"),
    Query("e36_few", "threshold:f", lambda v: s.elbow(v.cells.where("cls IN (3, 8)").groupBy((F.col("cls") * 10.0).alias("t")).agg(F.avg("elev").alias("q")), "t", "q"), "SELECT median(t) AS threshold FROM (SELECT DISTINCT cls*10.0::DOUBLE AS t FROM cells WHERE cls IN (3, 8))"),
]
