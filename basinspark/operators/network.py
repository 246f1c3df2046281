"""River networks as edge tables: closures, order, outlets, morphometry, topology."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import renumber
from ..scratch import dropped, stored


def edges_from_columns(df: DataFrame, seg: str, upstream: list[str]) -> DataFrame:
    """(seg, down) from a table that lists upstream segments in columns; 0, negative and null entries are none."""
    d = df.select(F.col(seg).alias("down"), F.explode(F.array(*upstream)).alias("seg"))
    return d.where("seg > 0").select("seg", "down")


def _steps(edges: DataFrame) -> DataFrame:
    """(u, v): distinct edges without loops and nulls."""
    return edges.select(F.col("seg").alias("u"), F.col("down").alias("v")).where("u <> v").distinct()


def _twice(steps: DataFrame) -> DataFrame:
    """(u, v) for walks of twice the length."""
    return steps.select("u", F.col("v").alias("_m")).join(steps.select(F.col("u").alias("_m"), "v"), "_m").select("u", "v").distinct()


def _along(to: DataFrame, block: int) -> DataFrame:
    """(u, v): v as far down from u as the path stays in u's range of ids, a step beyond it. to: (u, v), one row a u; a range has about `block` rows."""

    def walk(batches):
        rows = pd.concat([pd.DataFrame({"u": [], "v": []}), *batches]).sort_values("u")
        if len(rows):
            rows = rows.astype(kinds)
            u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
            at = np.searchsorted(u, v).clip(max=len(u) - 1)
            last = np.where(u[at] == v, at, np.arange(len(u)))
            for _ in range(len(u).bit_length()):  # twice as far each time; on a cycle to some node of it
                last = last[last]
            yield pd.DataFrame({"u": u, "v": v[last]})

    kinds = {f.name: {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}.get(f.dataType.simpleString(), "object") for f in to.schema}
    return to.repartitionByRange(max(1, math.ceil(to.count() / block)), "u").mapInPandas(walk, to.schema)


def _ends(to: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(u, v): the first node v down from u that has no row itself; and (u) some nodes of every cycle, whose rows are left out. to: (u, v), one row a u.

    Paths inside a range of ids are followed in one task; between ranges only the nodes where paths enter one are followed on, by doubling.
    """
    cycles = None
    while True:
        near = stored(_along(to, block))
        hop = stored(near.select(F.col("v").alias("u")).distinct().join(near, "u"))
        n, length = hop.count(), 1
        while True:
            on = hop.join(hop.select(F.col("u").alias("v"), F.col("v").alias("_w")), "v", "left")
            endless = on.where("_w IS NOT NULL").select(F.col("v").alias("u")).distinct()
            if endless.isEmpty():
                far = near.join(hop.select(F.col("u").alias("v"), F.col("v").alias("_w")), "v", "left")
                return stored(far.select("u", F.coalesce("_w", "v").alias("v"))), to.select("u").limit(0) if cycles is None else cycles
            if length > n:
                cycles = stored(endless)
                to = stored(to.join(cycles, "u", "left_anti"))
                break
            last, hop, length = hop, stored(on.select("u", F.coalesce("_w", "v").alias("v"))), length * 2
            dropped(last)


def _closure(step: DataFrame, start: DataFrame, tree: bool) -> DataFrame:
    """(outlet, seg) of all that steps (u, v) lead from to the start's. In a tree nobody is found twice; a cycle shows by more rounds than nodes allow."""
    seen, walks, n, length = start, step, step.count(), 1
    while True:
        more = seen.join(walks, F.col("seg") == F.col("v")).select("outlet", F.col("u").alias("seg"))
        more = stored(more if tree else more.distinct().join(seen, ["outlet", "seg"], "left_anti"))
        if more.isEmpty():
            return seen
        if tree and length > n:
            return _closure(step, start, False)
        seen, walks, length = seen.unionByName(more), stored(_twice(walks)), length * 2


def upstream(edges: DataFrame, outlets: DataFrame, block: int = 500_000) -> DataFrame:
    """(outlet, seg): each outlet (column seg) that is in the graph with all its ancestors and itself; cycles are safe.

    A node that flows to one other only, and is no outlet, stands behind the first node down from it that is an outlet or flows to several
    (or is one of a cycle). Ancestors are sought among these nodes only, by doubling: round k knows who is fewer than 2^k steps above an
    outlet and where walks of 2^k steps lead, and ends once nobody is added. Each round writes what it adds. Who stands behind
    them is joined last and not written, so that what is written grows with the graph and its outlets' pairs, not with the result.
    """
    raw = stored(edges.select(F.col("seg").alias("u"), F.col("down").alias("v")).where("u <> v"))
    nodes = raw.select(F.col("u").alias("seg")).unionByName(raw.select(F.col("v").alias("seg")))
    asked = stored(nodes.join(outlets.select("seg").distinct(), "seg", "left_semi").distinct())
    out = stored(raw.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("_b")))
    several = stored(out.where("v <> _b").select("u"))
    behind, cycles = _ends(out.where("v = _b").select("u", "v").join(asked.select(F.col("seg").alias("u")), "u", "left_anti"), block)
    marked = asked.select(F.col("seg").alias("u")).unionByName(several).unionByName(cycles).distinct()
    step = raw.join(marked, "u", "left_semi").distinct().join(behind.select(F.col("u").alias("v"), F.col("v").alias("_w")), "v", "left")
    step = stored(step.select("u", F.coalesce("_w", "v").alias("v")).where("u <> v").distinct())
    seen = _closure(step, stored(asked.select(F.col("seg").alias("outlet"), "seg")), several.isEmpty() and cycles.isEmpty())
    return seen.unionByName(seen.join(behind.select(F.col("v").alias("seg"), F.col("u").alias("_s")), "seg").select("outlet", F.col("_s").alias("seg")))


def subset(df: DataFrame, ids: DataFrame, key: str, id_col: str = "seg") -> DataFrame:
    """Rows of df whose key is among the ids, each once."""
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi").select(*df.columns)


def _levels(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, level): most edges from any ancestor; and, if there are cycles, (u, v) of walks that never end. By doubling."""
    nodes = step.select(F.col("u").alias("node")).unionByName(step.select(F.col("v").alias("node"))).distinct()
    level = stored(nodes.withColumn("level", F.lit(0)))
    n, length, walks = level.count(), 1, step
    while length <= n:
        if walks.isEmpty():
            return level, None
        came = walks.join(level, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg((F.max("level") + length).alias("far"))
        level = stored(level.join(came, "node", "left").select("node", F.greatest("level", F.coalesce("far", F.lit(0))).alias("level")))
        walks, length = stored(_twice(walks)), length * 2
    return (level, None) if walks.isEmpty() else (level, walks)


def cut_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) edges without cycles, and (node, level) over them, the longest distance from a headwater.

    A cycle is cut where it enters its lowest id. (All nodes of a cycle have the same descendants, so that their
    number singles none out.) What lies on cycles is what endless walks both lead to and come from; who reaches
    whom is spelled out for these few nodes only.
    """
    step = stored(_steps(edges))
    while True:
        level, endless = _levels(step)
        if endless is None:
            return step, level
        core = stored(endless.select(F.col("u").alias("n")).intersect(endless.select(F.col("v").alias("n"))))
        inner = step.join(core.select(F.col("n").alias("u")), "u", "left_semi").join(core.select(F.col("n").alias("v")), "v", "left_semi")
        reach = upstream(inner.select(F.col("u").alias("seg"), F.col("v").alias("down")), core.select(F.col("n").alias("seg"))).select(F.col("outlet").alias("x"), F.col("seg").alias("y"))
        same = reach.join(reach.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"])  # x and y reach each other
        low = stored(same.groupBy("x").agg(F.min("y").alias("low")))
        into = low.select(F.col("x").alias("u"), F.col("low").alias("v"))  # edges from a cycle's nodes to its lowest id
        step = stored(step.join(into, ["u", "v"], "left_anti"))


def downstream_order(edges: DataFrame) -> DataFrame:
    """(seg, level): longest distance from a headwater; 0 for headwaters and for ids without neighbours. Cycles are cut as `cut_cycles` says."""
    e = edges.select("seg", "down").distinct()
    ids = e.select("seg").distinct()
    _, level = cut_cycles(e.join(ids.select(F.col("seg").alias("down")), "down", "left_semi"))
    return ids.join(level.select(F.col("node").alias("seg"), "level"), "seg", "left").select("seg", F.coalesce("level", F.lit(0)).alias("level"))


def positions(edges: DataFrame) -> DataFrame:
    """(seg, level, position): ids without neighbours come first, then from headwaters down, equals by id; position counts from 1."""
    e = stored(edges.select("seg", "down").distinct())
    linked = _steps(e.where("down > 0"))
    linked = linked.select(F.col("u").alias("seg")).unionByName(linked.select(F.col("v").alias("seg"))).distinct().withColumn("_in", F.lit(1))
    d = downstream_order(e).join(linked, "seg", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    return renumber(d, ["_in", "level", "seg"], "position").select("seg", "level", "position")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge: the smallest node that links lead to.

    In a round every group hangs itself on the smallest group next to it, the chains of this are flattened by
    doubling, and the edges shrink to those between groups that are left; each round is written.
    """
    e = stored(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    of = stored(e.select(F.col("x").alias("node")).unionByName(e.select(F.col("y").alias("node"))).distinct().withColumn("component", F.col("node")))
    e = stored(e.where("x <> y"))
    while not e.isEmpty():
        to = stored(e.groupBy("x").agg(F.min("y").alias("to")))
        while True:
            deeper = to.join(to.select(F.col("x").alias("to"), F.col("to").alias("_next")), "to", "left")
            if deeper.where("_next IS NOT NULL").isEmpty():
                break
            to = stored(deeper.select("x", F.coalesce("_next", "to").alias("to")))
        new = lambda d, c: d.join(to.select(F.col("x").alias("_x"), F.col("to").alias("_t")), F.col(c) == F.col("_x"), "left").withColumn(c, F.coalesce("_t", c)).drop("_x", "_t")
        of = stored(new(of, "component"))
        e = stored(new(new(e, "x"), "y").where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    return of


def unit_edges(segments: DataFrame) -> DataFrame:
    """(unit, down_unit): units whose segments drain into another unit's; self-loops are left out."""
    d = segments.select(F.col("seg").alias("down"), F.col("unit_id").alias("down_unit"))
    return segments.join(d, "down").where("unit_id <> down_unit").select(F.col("unit_id").alias("unit"), "down_unit").distinct()


def down_neighbour(df: DataFrame, group: str, unit: str, elev: str) -> DataFrame:
    """Within a group the next lower unit, the last 0."""
    return df.withColumn("down", F.coalesce(F.lead(unit).over(W.partitionBy(group).orderBy(F.col(elev).desc(), unit)), F.lit(0)))


def outlet(flows: DataFrame, segments: DataFrame, seg: str = "seg", down: str = "down", flow: str = "q") -> DataFrame:
    """One row: the segment that drains nowhere (down -1), else that of greatest mean flow, else the last id."""
    mean = flows.groupBy(seg).agg(F.avg(flow).alias("_m"))
    d = segments.join(mean, seg, "left")
    return d.agg(F.coalesce(F.min(F.when(F.col(down) == -1, F.col(seg))), F.max(F.when(F.col("_m").isNotNull(), F.struct("_m", (-F.col(seg)).alias("k"))))["k"] * -1, F.max(seg)).alias("outlet"))


def river_stats(segments: DataFrame, keys: list[str], length: str, order: str, slope: str, chord: str | None = None) -> DataFrame:
    """Count, length, orders and length-weighted slope; with the straight distance `chord` the length-weighted sinuosity (length / chord, where it is above 0)."""
    wound = [] if chord is None else [(F.sum(F.when(F.col(chord) > 0, F.col(length) ** 2 / F.col(chord))) / F.sum(F.when(F.col(chord) > 0, F.col(length)))).alias("w_sinuosity")]
    return segments.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(length).alias("total"), F.min(order).alias("order_min"), F.max(order).alias("order_max"), (F.sum(F.col(length) * F.col(slope)) / F.sum(length)).alias("w_slope"), *wound)


def morphometry(segments: DataFrame, keys: list[str], length: str, order: str, slope: str | None = None) -> DataFrame:
    """By stream order: count, length, share, and the bifurcation ratio to the next order; with a slope column its mean."""
    steep = [] if slope is None else [F.avg(slope).alias("mean_slope")]
    n = segments.groupBy(*keys, order).agg(F.count("*").alias("n"), F.sum(length).alias("total"), *steep)
    w = W.partitionBy(*keys)
    nxt = F.lead("n").over(w.orderBy(order))
    follows = F.lead(order).over(w.orderBy(order)) == F.col(order) + 1
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("bifurcation", F.when(follows, F.col("n") / nxt))


def basin_shape(units: DataFrame, segments: DataFrame, key: str, area: str, length: str, perimeter: str, order: str) -> DataFrame:
    """Of each unit elongation (diameter of the circle of its area over its length), form factor (area over length squared), circularity
    (4 pi area over perimeter squared), and its headwaters (segments of order 1), as a number and by area."""
    a, n = F.col(area), F.coalesce("_n", F.lit(0))
    head = segments.where(F.col(order) == 1).groupBy(key).agg(F.count("*").alias("_n"))
    size = F.nullif(F.col(length).cast("double"), F.lit(0.0))
    return units.join(head, key, "left").select(key, (2 * F.sqrt(a / math.pi) / size).alias("elongation"), (a / size**2).alias("form_factor"), (4 * math.pi * a / F.nullif(F.col(perimeter).cast("double"), F.lit(0.0)) ** 2).alias("circularity"), n.alias("headwaters"), (n / F.nullif(a.cast("double"), F.lit(0.0))).alias("headwater_density"))


def prepare_network(df: DataFrame, outlets: list[int], seg: str = "seg", down: str = "down", length: str = "length", slope: str = "slope") -> DataFrame:
    """Length null or 0 becomes 1, slope 0.001 (if there is such a column); the segments listed flow out of the network (0)."""
    defaults = {c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(v)) for c, v in ((length, 1.0), (slope, 0.001)) if c in df.columns}
    return df.withColumns({**defaults, down: F.when(F.col(seg).isin(outlets), 0).otherwise(F.col(down))})


def default_segment(df: DataFrame, seg: str = "seg", down: str = "down") -> DataFrame:
    """Where no pour point is given: the outlet (down = 0) of lowest id, else the segment of lowest id."""
    return df.agg(F.coalesce(F.min(F.when(F.col(down) == 0, F.col(seg))), F.min(seg)).alias(seg))


def topology(segments: DataFrame, units: DataFrame, unit: str = "unit_id", area: str = "area") -> DataFrame:
    """Routing table: each unit with the segment it drains to (its most downstream, here lowest id) and its area."""
    to = segments.groupBy(unit).agg(F.min("seg").alias("seg"))
    d = segments.select("seg", "down")
    return units.join(to, unit).join(d, "seg").select(unit, "seg", "down", area)


def routing_table(hrus: DataFrame, segments: DataFrame, hru: str = "hru", gru: str = "gru", area: str = "area", seg: str = "seg", seg_unit: str = "unit_id", lumped: DataFrame | None = None) -> DataFrame:
    """(unit, seg, area): what drains to which segment of the routing model.

    As a rule each GRU, with the summed area of its HRUs, drains to its segment (of lowest id). A single GRU that no segment
    names drains to the lowest segment of all. With `lumped` (seg, fraction) there is one basin: each segment gets its fraction of the total area, the unit being the segment itself.
    """
    total = hrus.groupBy(F.col(gru).alias("unit")).agg(F.sum(area).alias("area"))
    if lumped is not None:
        whole = total.agg(F.sum("area").alias("_a"))
        return lumped.crossJoin(F.broadcast(whole)).select(F.col(seg).alias("unit"), F.col(seg).alias("seg"), (F.col("fraction") * F.col("_a")).alias("area"))
    own = segments.groupBy(F.col(seg_unit).alias("unit")).agg(F.min(seg).alias("_own"))
    only = total.agg((F.count("*") == 1).alias("_one")).crossJoin(segments.agg(F.min(seg).alias("_any")))
    d = total.join(own, "unit", "left").crossJoin(F.broadcast(only))
    return d.select("unit", F.coalesce("_own", F.when(F.col("_one"), F.col("_any"))).alias("seg"), "area").where("seg IS NOT NULL")


def spread(totals: DataFrame, units: DataFrame, key: str, value: str, area: str) -> DataFrame:
    """A lumped value dealt to units by area, and evenly."""
    w = W.partitionBy(key)
    u = units.withColumn("w_area", F.col(area) / F.sum(area).over(w)).withColumn("w_equal", 1 / F.count("*").over(w))
    return u.join(totals, key).withColumn("by_area", F.col(value) * F.col("w_area")).withColumn("equal", F.col(value) * F.col("w_equal"))


def map_units(df: DataFrame, order: str, k: int) -> DataFrame:
    """Units in order, dealt to k blocks of n // k (the last takes the rest); for n < k each unit stands for itself."""
    n = df.agg(F.count("*").alias("_n"))
    d = renumber(df, [order], "_number").withColumn("_at", F.col("_number") - 1).crossJoin(F.broadcast(n))
    return d.withColumn("block", F.least(F.lit(k - 1), F.floor(F.col("_at") / F.greatest(F.lit(1), F.floor(F.col("_n") / k)))).cast("int")).drop("_number", "_at", "_n")


def replicate_units(df: DataFrame, k: int, name: str = "hru") -> DataFrame:
    """Every row once for each of the k units 1..k: a catchment's series stands for all of them."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(k)) if k > 0 else F.array().cast("array<int>")))


def merge_small(units: DataFrame, adjacency: DataFrame, least: float) -> DataFrame:
    """(unit, merged): units (unit, area) below `least` join their largest neighbour (a, b), round after round.

    In a round only units that no smaller-id small neighbour is joining move, so that two never swap; areas are
    summed and the adjacency is renamed.
    """
    state = stored(units.select("unit", F.col("unit").alias("merged"), F.col("area").cast("double").alias("area")))
    adj = stored(adjacency.select("a", "b").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    while True:
        size = state.groupBy("merged").agg(F.sum("area").alias("area"))
        small = size.where(F.col("area") < least)
        near = adj.join(small.select(F.col("merged").alias("a")), "a").join(size.select(F.col("merged").alias("b"), F.col("area").alias("s")), "b")
        to = near.groupBy("a").agg((-F.max(F.struct("s", (-F.col("b")).alias("k")))["k"]).alias("to"))
        # a target that moves itself this round stays unless it is the lower id of the two
        both = to.join(to.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").where("next IS NULL OR (next = a AND a > to)").select("a", "to")
        moves = stored(both)
        if moves.isEmpty():
            break
        state = stored(state.join(moves, F.col("merged") == F.col("a"), "left").select("unit", F.coalesce("to", "merged").alias("merged"), "area"))
        rename = lambda d, c: d.join(moves.select(F.col("a").alias("_a"), F.col("to").alias("_t")), F.col(c) == F.col("_a"), "left").withColumn(c, F.coalesce("_t", c)).drop("_a", "_t")
        adj = stored(rename(rename(adj, "a"), "b").where("a <> b").distinct())
    return state.select("unit", "merged")
