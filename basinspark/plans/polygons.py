"""Queries over polygons: boxes of the zones cut by a diagonal, boxes without a quarter, and a curvilinear grid."""

from pyspark.sql import functions as F

from ..operators import polygons as p
from .base import Query

TOUCH = "t AS (SELECT cell_id, x, y, unit_id, xmin, ymin, greatest(x-0.5,xmin) AS a, least(x+0.5,xmax) AS b, greatest(y-0.5,ymin) AS c, least(y+0.5,ymax) AS d, (ymax-ymin)/(xmax-xmin) AS m FROM cells JOIN zones ON x+0.5>xmin AND x-0.5<xmax AND y+0.5>ymin AND y-0.5<ymax)"
# what of a cell lies below the rising diagonal: the integral of the line cut off at the cell's lower and upper side
POS = "CASE WHEN {u}>=0 THEN (b-a)*({u}+{v})/2 WHEN {v}<=0 THEN 0 ELSE (b-a)*pow({v},2)/(2*({v}-{u})) END"
BELOW = f"{TOUCH}, u AS (SELECT *, ymin+m*(a-xmin)-c AS u, ymin+m*(b-xmin)-c AS v, ymin+m*(a-xmin)-d AS u2, ymin+m*(b-xmin)-d AS v2 FROM t), lo AS (SELECT *, {POS.format(u='u', v='v')}-({POS.format(u='u2', v='v2')}) AS below FROM u), tri AS (SELECT unit_id, cell_id, CASE WHEN unit_id%2=0 THEN below ELSE (b-a)*(d-c)-below END AS area FROM lo)"
ELL = "SELECT unit_id, cell_id, (b-a)*(d-c)-greatest(0,b-greatest(a,xmin+4))*greatest(0,d-greatest(c,ymin+5)) AS area FROM t"
GRID = "g AS (SELECT y AS i, x AS j, y*0.5+x*0.01 AS lat, x*0.25+y*0.02 AS lon FROM cells)"


def _vertex(x, y):
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def triangles(v):
    """The half of each box below its diagonal for even units, above it for odd ones, which runs clockwise."""
    low, high = _vertex("xmin", "ymin"), _vertex("xmax", "ymax")
    return v.zones.withColumn("ring", F.when(F.col("unit_id") % 2 == 0, F.array(low, _vertex("xmax", "ymin"), high, low)).otherwise(F.array(low, _vertex("xmin", "ymax"), high)))


def ells(v):
    """Each box with its upper right quarter (4 by 5) as a hole."""
    b = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    whole = v.zones.select("unit_id", F.lit(False).alias("hole"), p.box_ring(*b).alias("ring"))
    return whole.unionByName(v.zones.select("unit_id", F.lit(True).alias("hole"), p.box_ring(b[0] + 4, b[1] + 5, b[2], b[3]).alias("ring")))


def grid(v):
    return v.cells.selectExpr("y AS i", "x AS j", "y * 0.5D + x * 0.01D AS lat", "x * 0.25D + y * 0.02D AS lon")


def quads(v, extrapolate):
    d = p.curvilinear_cells(grid(v), extrapolate)
    return d.select("cell_id", F.abs(p.ring_area(F.col("ring"))).alias("area"), *[F.col("ring")[k][c].alias(f"{c}{k}") for k in (1, 2, 3) for c in "xy"])


def _quads_sql(extrapolate):
    side = lambda k, n, l, c: f"coalesce({n}.{c}, " + (f"2*{k}.{c}-{l}.{c}, " if extrapolate else "") + f"{k}.{c})"
    b = ", ".join(f"{side('a', 'n', 'l', c)} AS b{c}" for c in ("lon", "lat"))
    rest = ", ".join(f"{side('h', 'n', 'l', c)} AS c{c}" for c in ("blon", "blat")) + ", " + ", ".join(f"{side('h', 'n', 'l', c)} AS e{c}" for c in ("lon", "lat"))
    return (f"WITH {GRID}, h AS (SELECT a.*, {b} FROM g a LEFT JOIN g n ON n.i=a.i AND n.j=a.j+1 LEFT JOIN g l ON l.i=a.i AND l.j=a.j-1), r AS (SELECT h.*, {rest} FROM h LEFT JOIN h n ON n.j=h.j AND n.i=h.i+1 LEFT JOIN h l ON l.j=h.j AND l.i=h.i-1) "
            "SELECT i*(SELECT max(j)+1 FROM g)+j AS cell_id, abs((lon*blat-blon*lat)+(blon*cblat-cblon*blat)+(cblon*elat-elon*cblat)+(elon*lat-lon*elat))/2 AS area, blon AS x1, blat AS y1, cblon AS x2, cblat AS y2, elon AS x3, elat AS y3 FROM r")  # fmt: skip


QUERIES = [
    Query("e02_polygon", "unit_id:i cell_id:i area:f w:f", lambda v: p.polygon_weights(p.cell_rings(v.cells), triangles(v)), f"WITH {BELOW} SELECT *, area/sum(area) OVER (PARTITION BY unit_id) AS w FROM tri WHERE area>1e-9"),
    Query("e02_polygon_holes", "unit_id:i cell_id:i area:f w:f", lambda v: p.polygon_weights(p.cell_rings(v.cells), ells(v), hole="hole"), f"WITH {TOUCH}, e AS ({ELL}) SELECT *, area/sum(area) OVER (PARTITION BY unit_id) AS w FROM e WHERE area>1e-9"),
    Query("e02_two_polygons", "unit_id:i other:i area:f", lambda v: p.shared_areas(triangles(v), v.zones.select(F.col("unit_id").alias("other"), p.box_ring(F.col("xmin") + 2, F.col("ymin"), F.col("xmax") + 2, F.col("ymax")).alias("ring")), "unit_id", "other"),
          "SELECT unit_id, other, area FROM (SELECT z.unit_id, o.unit_id AS other, CASE WHEN z.unit_id=o.unit_id THEN CASE WHEN z.unit_id%2=0 THEN 37.5 ELSE 22.5 END ELSE CASE WHEN z.unit_id%2=0 THEN 2.5 ELSE 17.5 END END AS area FROM zones z JOIN zones o ON o.unit_id=z.unit_id OR (o.ymin=z.ymin AND o.xmin=z.xmin-8))"),
    Query("e08_polygon", "cell_id:i unit_id:i", lambda v: p.points_in_polygons(v.cells, triangles(v), "unit_id"), "SELECT cell_id, unit_id FROM (SELECT *, ymin+(ymax-ymin)*((x-xmin)/(xmax-xmin)) AS l FROM cells JOIN zones ON x>=xmin AND x<xmax AND y>=ymin AND y<ymax) WHERE CASE WHEN unit_id%2=0 THEN y<l ELSE y>=l END"),
    Query("e08_first_polygon", "cell_id:i unit_id:i", lambda v: p.polygon_of_point(v.cells.select("cell_id", "x", "y"), ells(v).unionByName(triangles(v).select((F.col("unit_id") + 100).alias("unit_id"), F.lit(False).alias("hole"), "ring")), "unit_id", hole="hole", required=False),
          "WITH d AS (SELECT cell_id, unit_id, x-xmin AS u, y-ymin AS w FROM cells JOIN zones ON x>=xmin AND x<xmax AND y>=ymin AND y<ymax) SELECT c.cell_id, CASE WHEN NOT (u>=4 AND w>=5) THEN unit_id WHEN CASE WHEN unit_id%2=0 THEN w<10*(u/8) ELSE w>=10*(u/8) END THEN unit_id+100 END AS unit_id FROM cells c LEFT JOIN d ON d.cell_id=c.cell_id"),
    Query("e09_polygon", "cell_id:i unit_id:i", lambda v: p.cells_touching_polygons(v.cells, triangles(v)), f"WITH {BELOW} SELECT cell_id, unit_id FROM tri WHERE area>1e-9"),
    Query("e01_curvilinear", "cell_id:i area:f " + " ".join(f"{c}{k}:f" for k in (1, 2, 3) for c in "xy"), lambda v: quads(v, False), _quads_sql(False)),
    Query("e01_curvilinear_edges", "cell_id:i area:f " + " ".join(f"{c}{k}:f" for k in (1, 2, 3) for c in "xy"), lambda v: quads(v, True), _quads_sql(True)),
]
