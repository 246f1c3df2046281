"""Runs of periodically repeated words, found by longest common extensions over a difference cover.

A run of period q and at least four periods holds, for some point i of the grid 0, 3q, 6q, ..., the words i and
i + q. The points of all periods are a harmonic sum, n log n / 3; where their words agree the pair is extended both
ways as far as the words stay equal. Most extensions end within a few words; the rest are answered by `Extensions`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, chunks, table

COVER, PERIOD = (0, 1, 3, 9), 13  # every difference modulo 13 is one of two members
GRID_POINTS = 1 << 21  # grid points worked on at once


class Extensions:
    """Longest common extensions of pairs of positions in one array whose last value occurs once.

    Only suffixes that begin at positions of the cover (modulo PERIOD) are sorted: first by their PERIOD words,
    then by doubling over the string of these ranks. Two positions are less than PERIOD words before two covered
    ones; these words are compared, and the rest is a range minimum over the sorted suffixes' common prefixes.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.full(PERIOD, -1, words.dtype)])
        self.first = np.full(PERIOD, -1, np.int64)  # where a residue's positions begin in the sample
        parts, at = [], 0
        for r in COVER:
            parts.append(np.arange(r, n, PERIOD))
            self.first[r] = at
            at += len(parts[-1])
        spots = np.concatenate(parts)
        self.shift = np.zeros((PERIOD, PERIOD), np.int64)
        for a in range(PERIOD):
            for b in range(PERIOD):
                self.shift[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
        m = len(spots)
        columns = [self.words[spots + t] for t in range(PERIOD)]
        levels = [self._ranks(columns)]
        while m and levels[-1].max() < m - 1:
            gap = 1 << (len(levels) - 1)
            later = np.full(m, -1, np.int64)
            later[: max(0, m - gap)] = levels[-1][gap:]
            levels.append(self._ranks([levels[-1], later]))
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self.minima = [self._neighbours(spots, order, levels[:-1])]
        while (w := 1 << (len(self.minima) - 1)) * 2 <= m - 1:
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-w], low[w:]))

    @staticmethod
    def _ranks(columns: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def _neighbours(self, spots: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of sorted sampled suffixes next to each other: whole blocks by rank, the last one word by word."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
            out[same] += PERIOD << k
        return out + common_words(self.words, spots[a], spots[b], PERIOD)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of equal words from i and j on (i <> j)."""
        shift = self.shift[i % PERIOD, j % PERIOD]
        out = common_words(self.words, i, j, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            x, y = i[far] + shift[far], j[far] + shift[far]
            a, b = (self.rank[self.first[z % PERIOD] + z // PERIOD] for z in (x, y))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                these = level == k
                t = self.minima[k]
                out[far[these]] += np.minimum(t[low[these]], t[high[these] - (1 << k)])
        return out


def common_words(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Equal words from i and j on, counted up to `most`."""
    out = np.zeros(len(i), np.int64)
    most = np.broadcast_to(most, len(i))
    left = np.flatnonzero(most > 0)
    t = 0
    while len(left):
        left = left[words[i[left] + t] == words[j[left] + t]]
        t += 1
        out[left] = t
        left = left[most[left] > t]
    return out


class Reach:
    """Equal words from i and j on, within documents. What PERIOD words leave open is looked up in the documents concerned, which alone are sorted, and once."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.words, self.doc = np.concatenate([words, -np.arange(2, 2 + PERIOD)]), doc
        self.have = np.zeros(int(doc.max()) + 1, bool)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = common_words(self.words, i, j, PERIOD)
        far = np.flatnonzero(out == PERIOD)
        if len(far):
            need = self.have.copy()
            need[self.doc[i[far]]] = True
            if (need & ~self.have).any():
                mask = need[self.doc]
                self.have, self.at, self.sorted = need, np.cumsum(mask) - 1, Extensions(self.words[: len(mask)][mask])
            out[far] = self.sorted(self.at[i[far]], self.at[j[far]])
        return out


def grid(sizes: np.ndarray, starts: np.ndarray, least: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, position, period): for each period the points 0, (periods - 1) * period, ... of each document."""
    most = np.where(sizes >= least, sizes // periods, 0)
    doc = np.repeat(np.arange(len(sizes)), most)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = -(-(sizes[doc] - p) // ((periods - 1) * p))
    total = np.concatenate([[0], np.cumsum(points)])
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, total[at] + GRID_POINTS, side="right")) - 1)
        n = points[at:to]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q, d = np.repeat(p[at:to], n), np.repeat(doc[at:to], n)
        yield d, starts[d] + k * (periods - 1) * q, q
        at = to


def runs_of(texts: list[np.ndarray], least: int = 6, periods: int = 4) -> list[np.ndarray]:
    """For each array of word numbers its runs as rows (start, length, period) by start, then period: maximal stretches of at least `least` words and `periods` of their smallest periods."""
    if periods < 2:
        raise ValueError("a run holds two periods at least")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.full(int(sizes.sum()) + len(sizes) + 1, 0, np.int64)
    edges = np.concatenate([[0], starts + sizes])
    words[edges] = -2 - PERIOD - np.arange(len(edges))  # every border once
    inside = np.ones(len(words), bool)
    inside[edges] = False
    words[inside] = np.concatenate([np.zeros(0, np.int64), *texts])
    doc = np.repeat(np.arange(len(sizes) + 1), np.concatenate([[1], sizes + 1]))
    doc = np.maximum(doc - 1, 0)
    doc_back = np.concatenate([np.arange(0, 1), np.repeat(np.arange(len(sizes)), sizes[::-1] + 1)]) if len(sizes) else np.zeros(1, np.int64)
    onward, backward = Reach(words, doc), Reach(words[::-1], doc_back)
    found, last = [], len(words) - 1
    for _, i, p in grid(sizes, starts, least, periods):
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        ahead = onward(i, i + p)
        behind = backward(last - i + 1, last - i - p + 1)
        size = behind + p + ahead
        keep = size >= np.maximum(least, periods * p)
        found.append(np.stack([i[keep] - behind[keep], size[keep], p[keep]]))
    if not found:
        return [np.zeros((0, 3), np.int64)] * len(texts)
    start, size, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, size, start))
    start, size, p = start[order], size[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])  # the smallest period of a stretch comes first
    start, size, p = start[new], size[new], p[new]
    order = np.lexsort((p, start))
    rows = np.stack([start, size, p], axis=1)[order]
    cut = np.searchsorted(rows[:, 0], edges)
    out = [rows[cut[d] : cut[d + 1]] - np.array([starts[d], 0, 0]) for d in range(len(texts))]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those of a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, periods: int = 4) -> DataFrame:
    """One row per input row: id, runs (array of start, length, period by start, then period) and collapsed (the text without a run's words after its first period, words joined by one space).

    Words are what stands between blanks. A null, empty or blank text has no runs and an empty collapsed text.
    Repeated rows and rows of one id stay, whatever the id's type, nulls too; no rows, no rows; other columns are
    not carried. Texts are read whole; a task holds a chunk of small texts or one long one, and some forty times
    its words in 8-byte numbers if it has long runs. Words are told apart exactly.
    """

    def run(batches):
        for b in chunks(batches, "text"):
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
            found = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], least, periods)
            at = np.cumsum([0, *map(len, found)])
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            inner = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)
            flat = pa.array([collapse(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), runs, flat], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents made periodic from some word on, as the id's hash says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    d = d.withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)})
    d = d.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    d = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.selectExpr("doc_id", "n_runs", "-b.s AS start", "b.length AS length", "-b.p AS period", "(1000 * b.length) div -b.p AS exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict = {}
