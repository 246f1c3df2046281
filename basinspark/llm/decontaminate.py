"""Benchmark decontamination: an inverted BM25 index of the test items, every training passage its query."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, chunks, dropped, shingle_hashes, stored, table

PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 64
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20  # most items and bytes of one index, which every task holds


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer is its last line, or, of one line, its last sentence; the rest is the question."""
    t = text.strip()
    cut = t.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.!?]+\s+", t)]
        cut = ends[-1] if ends else 0
    return t[:cut], t[cut:]


class Statistics:
    """Of all items with words: their number, mean and greatest length, and for `terms` (ascending) how many items have each."""

    def __init__(self, n: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.longest, self.terms, self.df = n, mean, longest, terms, df


class ItemIndex:
    """Postings by term: items in ascending order with their BM25 weight as a share of the item's own greatest score.

    So 1 is an item whose every term the passage has. Each term keeps its greatest weight, each run of
    POSTINGS_BLOCK postings its own. An index of some of the items is given the statistics of the whole.
    """

    def __init__(self, items: list[tuple[int, str]], share: float, overlap: float, k: int, whole: Statistics | None = None):
        self.share, self.overlap, self.k = share, overlap, k
        w = Words(pa.array([t for _, t in items], pa.string()), extra=PUNCTUATION)
        words = [w.hash[w.bounds[i] : w.bounds[i + 1]] for i in range(len(items))]
        full = [i for i, x in enumerate(words) if len(x)]
        self.ids = [items[i][0] for i in full]
        words = [words[i] for i in full]
        self.longest = whole.longest if whole else max(map(len, words), default=1)
        self.parts = []
        for i in full:
            sides = Words(pa.array(question_and_answer(items[i][1])), extra=PUNCTUATION)
            self.parts.append([shingle_hashes(sides.hash[sides.bounds[j] : sides.bounds[j + 1]], k) for j in range(2)])
        self.lengths = [[min(k, int(n)) for n in np.diff(Words(pa.array(question_and_answer(items[i][1])), extra=PUNCTUATION).bounds)] for i in full]
        n, own = len(words), sum(map(len, words)) / max(1, len(words))
        total, mean = (whole.n, whole.mean) if whole else (n, own)
        rows = [(t, i, c) for i, x in enumerate(words) for t, c in zip(*np.unique(x, return_counts=True), strict=True)]
        term = np.array([r[0] for r in rows], np.uint64)
        item, tf = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        self.terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
        size = np.array([len(x) for x in words], float)
        if whole:
            df = whole.df[np.searchsorted(whole.terms, self.terms)]
        weight = np.log1p((total - df[at] + 0.5) / (df[at] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(mean, 1))) if n else tf
        weight = weight / np.bincount(item, weight, n)[item] if n else weight
        order = np.lexsort((item, at))
        self.item, self.weight, at = item[order], weight[order], at[order]
        self.start = np.searchsorted(at, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(self.terms) else np.zeros(0)
        self.common = np.diff(self.start) > max(16, n // 8)
        self.lists = [(self.item[a:b].tolist(), self.weight[a:b].tolist(), [float(self.weight[i : min(b, i + POSTINGS_BLOCK)].max()) for i in range(a, b, POSTINGS_BLOCK)]) for a, b in zip(self.start[:-1], self.start[1:], strict=True)]

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score is `share` or more.

        Cursors stand in order of their item. The pivot is the first at which the terms' greatest weights reach
        the threshold; no item before it can. If the greatest weights of the blocks at the pivot do not reach
        it either, the cursors jump past the nearest block's end, else the pivot is scored or moved to.
        """
        cursors = [[self.lists[t][0][0], 0, t] for t in terms.tolist()]
        need, out = self.share - 1e-9, []
        while cursors:
            cursors.sort()
            total, p = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= need:
                    p = i
                    break
            if p < 0:
                break
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            bound, ends = 0.0, []
            for c in cursors[: p + 1]:
                items, _, tops = self.lists[c[2]]
                at = bisect_left(items, pivot, c[1])
                if at < len(items):
                    b = at // POSTINGS_BLOCK
                    bound += tops[b]
                    ends.append(items[min(len(items), (b + 1) * POSTINGS_BLOCK) - 1])
            if bound < need:
                to = min([e + 1 for e in ends] + [c[0] for c in cursors[p + 1 : p + 2]])
                to = max(to, pivot + 1)
            elif cursors[0][0] == pivot:
                score = sum(self.lists[c[2]][1][c[1]] for c in cursors[: p + 1])
                if score >= need:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for c in cursors[: p + 1]:
                items = self.lists[c[2]][0]
                c[1] = bisect_left(items, to, c[1])
                c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def matches(self, w: Words) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, overlap of question, of answer) for every item leaked into a run of texts.

        Passages are twice as long as the longest item and begin one such length apart, so that an item lies
        whole in one. Which passages can reach the threshold at all is settled for all at once: the weights of
        rare terms by item, and the greatest weights of the common ones.
        """
        if not len(self.terms):
            return []
        step, n_items = self.longest, len(self.ids)
        at = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == w.hash)
        if not len(hit):
            return []
        n = np.diff(w.bounds)
        passages = np.maximum(1, -(-n // step))
        first = np.cumsum(passages) - passages
        doc = np.searchsorted(w.bounds, hit, side="right") - 1
        k = (hit - w.bounds[doc]) // step
        p = first[doc] + k
        both = np.concatenate([p, p[k > 0] - 1]), np.concatenate([at[hit], at[hit][k > 0]])
        pair = np.unique(both[0] * len(self.terms) + both[1])
        p, t = pair // len(self.terms), pair % len(self.terms)
        base = np.bincount(p[self.common[t]], self.most[t[self.common[t]]], int(passages.sum()))
        rare = ~self.common[t]
        rp, rt = p[rare], t[rare]
        count = self.start[rt + 1] - self.start[rt]
        where = np.repeat(self.start[rt] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        cell = np.repeat(rp, count) * n_items + self.item[where]
        cells, inverse = np.unique(cell, return_inverse=True)
        score = np.bincount(inverse, self.weight[where], len(cells))
        live = np.unique(np.concatenate([cells[score + base[cells // n_items] >= self.share - 1e-9] // n_items, np.flatnonzero(base >= self.share - 1e-9)]))
        out = {}
        begin, end = np.searchsorted(p, live), np.searchsorted(p, live, side="right")
        for q, a, b in zip(live.tolist(), begin.tolist(), end.tolist(), strict=True):
            d = int(np.searchsorted(first, q, side="right")) - 1
            lo = int(w.bounds[d]) + (q - int(first[d])) * step
            words = w.hash[lo : min(int(w.bounds[d + 1]), lo + 2 * step)]
            grams: dict[int, np.ndarray] = {}
            for i, s in self.search(t[a:b]):
                sides = []
                for part, length in zip(self.parts[i], self.lengths[i], strict=True):
                    if length and length not in grams:
                        grams[length] = shingle_hashes(words, length) if len(words) >= length else words[:0]
                    sides.append(float(np.isin(part, grams[length]).mean()) if length else 1.0)
                if min(sides) >= self.overlap and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, *sides)
        return [(d, i, *v) for (d, i), v in sorted(out.items())]


def _item_terms(batches):
    """Of each item with words: how many, and its distinct terms."""
    for b in batches:
        w = Words(b.column("text"), extra=PUNCTUATION)
        full = np.flatnonzero(np.diff(w.bounds))
        terms = [np.unique(w.hash[w.bounds[i] : w.bounds[i + 1]]).view(np.int64) for i in full.tolist()]
        yield pa.RecordBatch.from_pydict({"block": b.column("block").take(pa.array(full)), "n": pa.array(np.diff(w.bounds)[full], pa.int64()), "terms": pa.array(terms, pa.list_(pa.int64()))})


def item_indexes(tests: DataFrame, share: float, overlap: float, words: int):
    """One index after the other over the items (item, text), of BLOCK_ITEMS and BLOCK_BYTES at most about.

    Each has the items that a hash deals it. How many items have a term, their mean and greatest length are counted
    over all items in Spark, so that blocks bound memory and change no score; an index gets the counts of its own terms.
    """
    n, size = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    if blocks == 1:
        yield ItemIndex(sorted((r.item, r.text) for r in tests.collect()), share, overlap, words), True
        return
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    terms = stored(tests.select("block", "text").mapInArrow(_item_terms, "block long, n long, terms array<long>"))
    all_items, mean, longest = terms.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0)), F.coalesce(F.max("n"), F.lit(1))).first()
    by_term = terms.select("block", F.explode("terms").alias("term")).groupBy("term", "block").count()
    df = by_term.groupBy("term").agg(F.sum("count").alias("df"))
    df = stored(by_term.select("term", "block").join(df, "term"))
    for block in range(blocks):
        own = df.where(F.col("block") == block).select("term", "df").toPandas()
        hashes = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        whole = Statistics(all_items, mean, longest, hashes[order], own["df"].to_numpy(np.int64)[order])
        yield ItemIndex(sorted((r.item, r.text) for r in tests.where(F.col("block") == block).select("item", "text").collect()), share, overlap, words, whole), False
    dropped(terms, df)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.6, overlap: float = 0.8, words: int = 5) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): one row a text and item that it holds.

    A passage is a hit if its BM25 score for the item is `share` or more of the greatest possible, and
    `overlap` of the question's and of the answer's distinct `words`-word shingles are in it. Letters A-Z are
    folded, punctuation separates words. Items are taken in blocks of bounded number and bytes, each an index
    that all texts are run against; statistics are those of all items. Null or empty texts and items match nothing;
    repeated rows give their result once, and so do texts of one id; ids are of any type, a null one is an id like others; a null item is left out;
    equal items each match; no items, no rows; other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    tests = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    item_kind = to_arrow_type(tests.schema["item"].dataType)
    shape = f"id {rows.schema['id'].dataType.simpleString()}, item {tests.schema['item'].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    out = None
    for index, only in item_indexes(tests, share, overlap, words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in chunks(batches):
                got = index.matches(Words(b.column("text"), extra=PUNCTUATION))
                yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array([g[0] for g in got], pa.int64())), "item": pa.array([index.ids[g[1]] for g in got], item_kind), **{c: pa.array([g[i] for g in got], pa.float64()) for i, c in ((2, "score"), (3, "question_overlap"), (4, "answer_overlap"))}})

        found = rows.mapInArrow(run, shape)
        if not only:  # written, so that no more than one index is held at a time
            found = stored(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("id", "item").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def op1_decontaminate(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL = {}
