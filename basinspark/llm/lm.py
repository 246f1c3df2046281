"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by the workers."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, crc_mod, mapped, mix, packed_pieces, packed_reduce, put_bytes, scratch, shard_of, table, unpack_columns

BEGIN, END = np.uint64(0x5BE6), np.uint64(0x0E2D)
PAIR = np.dtype([("a", "u8"), ("b", "u8"), ("c", "u8")])
TYPE = np.dtype([("b", "u8"), ("c", "u8")])
MERGE_AT = 1_500_000  # pairs a task gathers before it sums them


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous token, token, tokens of each text): each text's words and one end, the first after a begin."""
    w = Words(texts)
    n = np.diff(w.bounds) + 1
    last = np.cumsum(n) - 1
    b = np.full(int(n.sum()), END, np.uint64)
    words = np.ones(len(b), bool)
    words[last] = False
    b[words] = w.hash
    a = np.empty_like(b)
    a[1:] = b[:-1]
    a[last - n + 1] = BEGIN
    return a, b, n


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def pair_shard(a: np.ndarray, b: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the context; the pairs of a hot context are dealt by both words."""
    key = mix(a + np.uint64(1))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
        is_hot = hot[at] == a
        key[is_hot] = pair_key(a[is_hot], b[is_hot])
    return shard_of(key, shards)


def summed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    out = np.empty(len(at), PAIR)
    out["a"], out["b"], out["c"] = a[at], b[at], np.add.reduceat(c, at) if len(at) else c
    return out


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts; where counts are too few for the formula, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def hot_contexts(rows: DataFrame, share: float = 0.001) -> list[int]:
    """Hashes of words that make up over `share` of the tokens of one text in 64: at most 1/share of them.

    Only a hint for dealing pairs out; counts never depend on it.
    """

    def words(batches):
        for b in chunks(batches):
            a, _, _ = token_pairs(b.column("text"))
            u, c = np.unique(a, return_counts=True)
            top = np.argsort(-c)[: int(2 / share)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(u[top].view(np.int64)), "c": pa.array(c[top]), "n": pa.array(np.where(np.arange(len(top)) == 0, len(a), 0))})

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).mapInArrow(words, "a long, c long, n long").groupBy("a").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    got = some.orderBy(F.desc("n"), F.desc("c")).select("a", "c", "n")
    total = got.agg(F.sum("n")).first()[0] or 0
    return [r.a for r in got.where(F.col("c") > share * total).orderBy(F.desc("c"), "a").limit(int(1 / share)).collect()] if total else []


class KneserNey:
    """The model's place and its totals; every worker maps the arrays it reads."""

    def __init__(self, uri: str, shards: int, hot: dict, totals: dict, counted: set, worded: set):
        self.uri, self.shards, self.totals = uri, shards, totals
        self.full = {"context": counted, "pair": counted, "large": counted, "word": worded}  # shards that have files
        order = sorted(hot, key=lambda h: h & (1 << 64) - 1)
        self.hot = np.array(order, np.int64).view(np.uint64)
        self.hot_stats = np.array([hot[h] for h in order], np.float64).reshape(-1, 4)
        self.d2, self.d1 = _discounts(totals["pairs"]), _discounts(totals["types"])
        self.vocabulary, self.tokens, self.n_types = totals["vocabulary"], totals["tokens"], totals["n_types"]
        self.open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def array(self, kind: str, shard: int, dtype: str) -> np.ndarray:
        if (kind, shard) not in self.open:
            # shards without records have no files; where the folder itself cannot be read, that must not pass for an empty model
            self.open[kind, shard] = np.asarray(mapped(f"{self.uri}/{kind}/{shard}", dtype)) if shard in self.full[kind.split(".")[0]] else np.zeros(0, dtype)
        return self.open[kind, shard]

    def look(self, what: str, values: dict[str, str], at: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        """For each key the values beside it in its shard's sorted array, 0 where it is not there."""
        out = [np.zeros(len(keys), np.float64) for _ in values]
        order = np.argsort(keys)
        order = order[np.argsort(at[order], kind="stable")]
        cut = np.searchsorted(at[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            own, have = order[cut[s] : cut[s + 1]], self.array(f"{what}.key", s, "u8")
            if not len(have):
                continue
            i = np.searchsorted(have, keys[own])
            i[i == len(have)] = 0
            hit = have[i] == keys[own]
            for o, (name, kind) in zip(out, values.items(), strict=True):
                o[own[hit]] = self.array(f"{what}.{name}", s, kind)[i[hit]]
        return out

    def logs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of b after a, count of b in the training tokens)."""
        v, n = self.vocabulary, self.tokens
        every, which = np.unique(np.concatenate([b, a]), return_inverse=True)
        in_b, in_a = which[: len(b)], which[len(b) :]
        at = shard_of(mix(every + np.uint64(1)), self.shards)
        total, n1, n2, n3 = self.look("context", {"total": "u8", "n1": "u8", "n2": "u8", "n3": "u8"}, at, every)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, every), len(self.hot) - 1)
            is_hot = self.hot[i] == every
            total[is_hot], n1[is_hot], n2[is_hot], n3[is_hot] = self.hot_stats[i[is_hot]].T
        (types,) = self.look("word", {"types": "u8"}, at, every)
        # unigrams: continuation counts, interpolated with 1 / (V + 1)
        d = np.array([0, *self.d1])[np.minimum(types, 3).astype(int)]
        t1, t2, t3 = self.totals["types_by_count"]
        rest = (self.d1[0] * t1 + self.d1[1] * t2 + self.d1[2] * t3) / max(1, self.n_types) if self.n_types else 1.0
        p1 = np.maximum(types - d, 0) / max(1, self.n_types) + rest / (v + 1)
        # bigrams
        key = pair_key(a, b)
        (c,) = self.look("pair", {"count": "u1"}, pair_shard(a, b, self.hot, self.shards), key)
        big = c == 255
        if big.any():
            (full,) = self.look("large", {"count": "u8"}, pair_shard(a[big], b[big], self.hot, self.shards), key[big])
            c[big] = full
        d = np.array([0, *self.d2])[np.minimum(c, 3).astype(int)]
        ctx = total[in_a]
        gamma = np.where(ctx > 0, (self.d2[0] * n1[in_a] + self.d2[1] * n2[in_a] + self.d2[2] * n3[in_a]) / np.maximum(ctx, 1), 1.0)
        p = np.maximum(c - d, 0) / np.maximum(ctx, 1) + gamma * p1[in_b]
        count = total[in_b]
        ends = b == END
        count[ends] = self.totals["ends"]
        return np.log10(p), count


def fit_kneser_ney(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None, shards: int | None = None) -> KneserNey:
    """Counts every pair of adjacent tokens of all texts and writes the model to the shared folder.

    Pairs are summed inside the tasks and meet by context (a hot context's by pair), once. A shard writes its
    pairs as sorted hashes with counts, and its contexts' totals; the kinds of context before each word are
    summed in a second, smaller shuffle. A null text counts as an empty one: one end token. No row gives a
    model that knows nothing and scores 1 / (V + 1).
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    uri = uri or scratch(train.sparkSession)
    shards = shards or max(16, 2 * rows.rdd.getNumPartitions())
    hot_list = hot_contexts(rows)
    hot = np.sort(np.array(hot_list, np.int64).view(np.uint64)) if hot_list else np.zeros(0, np.uint64)

    def pack(batches):
        held, n = [], 0

        def flush():
            r = summed(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            held.clear()
            return r

        for batch in chunks(batches):
            a, b, _ = token_pairs(batch.column("text"))
            r = summed(a, b, np.ones(len(a), np.uint64))
            held.append((r["a"], r["b"], r["c"]))
            n += len(r)
            if n > MERGE_AT:
                r = flush()
                n = 0
                yield pair_shard(r["a"], r["b"], hot, shards), r
        if held:
            r = flush()
            yield pair_shard(r["a"], r["b"], hot, shards), r

    def merge(shard, blobs):
        r = unpack_columns(blobs, PAIR)
        r = summed(r["a"], r["b"], r["c"])
        a, c = r["a"], r["c"]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(first)
        ctx = a[at]
        add = lambda x: np.add.reduceat(x.astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
        stats = np.stack([add(c), add(c == 1), add(c == 2), add(c >= 3)], 1)
        is_hot = np.isin(ctx, hot)
        order = np.argsort(ctx[~is_hot])
        for name, x in (("key", ctx), ("total", stats[:, 0]), ("n1", stats[:, 1]), ("n2", stats[:, 2]), ("n3", stats[:, 3])):
            put_bytes(f"{uri}/context.{name}/{shard}", x[~is_hot][order].astype("u8").tobytes())
        key = pair_key(a, r["b"])
        order = np.argsort(key)
        put_bytes(f"{uri}/pair.key/{shard}", key[order].tobytes())
        put_bytes(f"{uri}/pair.count/{shard}", np.minimum(c[order], 255).astype(np.uint8).tobytes())
        large = order[c[order] >= 255]
        put_bytes(f"{uri}/large.key/{shard}", key[large].tobytes())
        put_bytes(f"{uri}/large.count/{shard}", c[large].astype("u8").tobytes())
        begin = ctx == BEGIN
        said = {"shard": shard, "pairs": _counts_of_counts(c), "tokens": int(c.sum()), "contexts": int((~is_hot & ~begin).sum()), "begins": int(stats[begin, 0].sum()), "hot": [[int(h), *map(int, s)] for h, s in zip(ctx[is_hot].view(np.int64), stats[is_hot], strict=True)]}
        put_bytes(f"{uri}/said/{shard}.json", json.dumps(said).encode())
        words, types = np.unique(r["b"], return_counts=True)
        out = np.empty(len(words), TYPE)
        out["b"], out["c"] = words, types
        yield packed_pieces(shard_of(mix(words + np.uint64(1)), shards), out, shards)

    def words(key, rows):
        r = unpack_columns(rows.column("data").to_pylist(), TYPE)
        order = np.argsort(r["b"])
        b, c = r["b"][order], r["c"][order]
        first = np.ones(len(b), bool)
        first[1:] = b[1:] != b[:-1]
        at = np.flatnonzero(first)
        types = np.add.reduceat(c, at) if len(at) else c
        put_bytes(f"{uri}/word.key/{key[0].as_py()}", b[at].tobytes())
        put_bytes(f"{uri}/word.types/{key[0].as_py()}", types.astype("u8").tobytes())
        return pa.Table.from_pydict({"shard": pa.array([key[0].as_py()], pa.int32()), "words": [len(at)], "types": [int(types.sum())], "by": pa.array([[*_counts_of_counts(types), int((types >= 3).sum())]], pa.list_(pa.int64()))})

    got = packed_reduce(rows, pack, merge, "shard int, data binary", shards).groupBy("shard").applyInArrow(words, "shard int, words long, types long, by array<long>").collect()
    totals = {"pairs": [0] * 4, "types": [0] * 4, "types_by_count": [0] * 3, "tokens": 0, "vocabulary": 0, "n_types": 0, "ends": 0}
    sums: dict[int, np.ndarray] = {}
    counted: set[int] = set()
    if got:
        by = np.sum([r.by for r in got], axis=0).tolist()
        totals |= {"types": by[:4], "types_by_count": [by[0], by[1], by[4]], "vocabulary": sum(r.words for r in got), "n_types": sum(r.types for r in got)}
        for x in train.sparkSession.read.text(f"{uri}/said").toLocalIterator():
            s = json.loads(x.value)
            counted.add(s["shard"])
            totals["pairs"] = [p + q for p, q in zip(totals["pairs"], s["pairs"], strict=True)]
            totals["tokens"] += s["tokens"]
            totals["ends"] += s["begins"]
            for h, *v in s["hot"]:
                sums[h] = sums.get(h, 0) + np.array(v)
    return KneserNey(uri, shards, {h: v.tolist() for h, v in sums.items()}, totals, counted, {r.shard for r in got})


def score_kneser_ney(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text.

    score is the model's log10 probability of the text, its end included; a null text is an empty one, so
    that it has one token. Repeated rows stay; other columns are not carried.
    """

    def run(batches):
        n_all, v = model.tokens, model.vocabulary
        for batch in chunks(batches, most=1 << 20):
            a, b, n = token_pairs(batch.column("text"))
            lp, c = model.logs(a, b)
            base = np.log10((c + 0.5) / (n_all + 0.5 * (v + 1)))
            at = np.cumsum(n) - n
            score = np.add.reduceat(lp, at)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_tokens": pa.array(n), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(n), n_all, np.int64)), "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(-score / n, 300))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def op7_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 1
    model = fit_kneser_ney(docs.where(~held))
    return score_kneser_ney(docs, model).withColumn("held_out", held)


QUERIES = {"op7_kneser_ney": op7_kneser_ney}
ORACLE_SQL = {}
