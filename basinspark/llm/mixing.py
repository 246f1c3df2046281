"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, stored, table

FAN_IN = 256  # items that one task of the reduction tree rounds against each other
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target) of each source of rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share `share` times all sizes; a
    target stops at `most` times its source's size and the excess is shared again by weight. So there is one
    level, target = level * weight, for all sources below their stop: sources ordered by stop / weight are
    filled until the level of the rest fits. The windows run over one row a source.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("stop", most * F.col("source_size"))
    order = W.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("level", (share * F.sum("source_size").over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct((F.col("stop") / F.col("w")).alias("at"), "level"))).over(W.partitionBy(F.lit(0)))["level"]
    return s.select("source", "n_docs", "source_size", F.least(F.col("stop"), F.coalesce(level, F.lit(0.0)) * F.col("w")).cast("double").alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities after rounding one against the next: all but one at most are 0 or 1.

    Words move between the two open items, forth or back as far as one becomes 0 or 1, at odds that keep
    each item's expectation; the sum of size * p never changes.
    """
    out, held = p.astype(float).copy(), -1
    for i in range(len(p)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - out[a]), size[b] * out[b])  # words from b to a
        down = min(size[a] * out[a], size[b] * (1 - out[b]))
        move = up if u[i] * (up + down) < down else -down
        for j, d in ((a, move), (b, -move)):
            q = out[j] + d / size[j]
            out[j] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        held = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else -1
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """id, size, source_size, target, taken, copies of every row.

    size is the number of words. A source's documents are all wanted target / source_size times; the whole
    part is given to each, the fraction is rounded: documents are dealt by a hash into lots of about `fan_in` of
    one source, each lot leaves one open fraction at most, and these meet in lots again until each source
    has one, which is drawn. So a source's words differ from its target by less than one document, however
    large it is. Draws are hashes of id and seed: reruns agree. A null or empty text has size 0 and is never
    taken; a null source is a source; repeated rows are items of their own; other columns are not carried.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    targets = stored(source_targets(rows, weights, share, most))
    n_sources = targets.count()
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(bounded_broadcast(targets.withColumnRenamed("source", "s"), n_sources, 20_000), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("copies", F.floor(want + 1e-9)).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), want - F.col("copies"))).otherwise(0.0))
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n_docs") / fan_in)))
    schema = rows.schema

    def round_lots(level: int):
        return lambda items: round_lot(items, level)

    def round_lot(items: pd.DataFrame, level: int) -> pd.DataFrame:
        order = pd.util.hash_array(items["id"].astype(str).to_numpy(object), hash_key=f"{seed % 10**6:06d}{level:010d}")
        at = np.lexsort((items["size"].to_numpy(), order))
        items = items.iloc[at].reset_index(drop=True)
        q = pivotal(items["size"].to_numpy(float), items["p"].to_numpy(float), order[at].astype(np.float64) * 2.0**-64)
        one = q >= 1
        return items.assign(copies=items["copies"] + one, p=np.where(one, 0.0, q))

    done, level = [], 0
    lots = targets.agg(F.max(F.ceil(F.col("n_docs") / fan_in))).first()[0] or 1
    rows = stored(rows.groupBy("source", "lot").applyInPandas(round_lots(0), schema))
    while lots > 1:
        level, lots = level + 1, -(-lots // fan_in)
        done.append(rows.where("p = 0"))
        left = rows.where("p > 0").withColumn("lot", F.floor(F.col("lot") / fan_in))
        rows = stored(left.groupBy("source", "lot").applyInPandas(round_lots(level), schema))
    draw = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)
    rows = rows.withColumn("copies", F.col("copies") + F.when(draw < F.col("p"), 1).otherwise(0))
    for d in done:
        rows = rows.unionByName(d)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long").alias("copies"))


def op3_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE_SQL = {}
