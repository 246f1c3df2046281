"""Language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, table, utf8

WINDOW, WIDTHS, FILTERS = 128, (1, 2, 3, 4), 8
LOOK = max(WIDTHS) - 1  # bytes beyond a window that its last filters read
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 3


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text in rows of WINDOW bytes and the LOOK after them, the last filled up with zeros; and the rows of each text."""
    rows = -(-np.diff(off) // WINDOW)
    at = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(int(at[-1]) * WINDOW + LOOK, np.uint8)
    flat[np.arange(len(raw)) + np.repeat(at[:-1] * WINDOW - off[:-1], np.diff(off))] = raw
    out = np.zeros((int(at[-1]), WINDOW + LOOK), np.uint8)
    out[:, :WINDOW] = flat[: len(out) * WINDOW].reshape(-1, WINDOW)
    if len(out) > 1:
        out[:-1, WINDOW:] = out[1:, :LOOK]
        out[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(out))] - 1, WINDOW:] = 0
    return out, rows


class ByteConvNet:
    """One-hot bytes, filters of several widths, ReLU, the maximum over a window, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.conv = [r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.base = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        parts = [*self.conv, self.bias, self.dense, self.base]
        m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                b, want = x[order[i : i + batch]], y[order[i : i + batch]]
                best, where = [], []
                for w, k in zip(WIDTHS, self.conv, strict=True):
                    z = sum(k[j][b[:, j : j + WINDOW]] for j in range(w))
                    where.append(z.argmax(1))
                    best.append(np.take_along_axis(z, where[-1][:, None], 1)[:, 0])
                pool = np.concatenate(best, 1) + self.bias
                act = np.maximum(pool, 0)
                logit = act @ self.dense + self.base
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = p
                d[np.arange(len(d)), want] -= 1
                d /= len(d)
                back = (d @ self.dense.T) * (pool > 0)
                grads = [np.zeros_like(k) for k in self.conv]
                for n, w in enumerate(WIDTHS):
                    g, f = back[:, n * FILTERS : (n + 1) * FILTERS], np.arange(FILTERS)
                    for j in range(w):
                        np.add.at(grads[n][j], (np.take_along_axis(b, where[n] + j, 1), f[None, :].repeat(len(b), 0)), g)
                grads += [back.sum(0), act.T @ d, d.sum(0)]
                t += 1
                for q, g, a, s in zip(parts, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.01 * (g * g - s)
                    q -= rate / (1 + t / 400) * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    def tables(self) -> list[np.ndarray]:
        """Filter sums over pairs of adjacent bytes: a wide filter is two look-ups a position instead of four."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        one, two, three, four = self.conv
        return [one[0], pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])]

    def log_probs(self, x: np.ndarray, t: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), 512):
            b = x[i : i + 512]
            pair = b[:, :-1].astype(np.uint16) << 8 | b[:, 1:]
            pool = np.concatenate([
                t[0][b[:, :WINDOW]].max(1), t[1][pair[:, :WINDOW]].max(1),
                (t[2][pair[:, :WINDOW]] + t[3][b[:, 2 : 2 + WINDOW]]).max(1),
                (t[4][pair[:, :WINDOW]] + t[5][pair[:, 2 : 2 + WINDOW]]).max(1),
            ], 1)
            logit = np.maximum(pool + self.bias, 0) @ self.dense + self.base
            logit -= logit.max(1, keepdims=True)
            out[i : i + 512] = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return out


def fit_language(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_label: int = SAMPLE_DOCS) -> ByteConvNet | None:
    """Trains on a bounded sample: about `docs_per_label` texts a label, chosen by a hash of id and text, SAMPLE_WINDOWS windows of each.

    Windows are spread evenly over the whole text. Rows with a null label or an empty text teach nothing;
    no row left gives None. Ids are of any type and may be null.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(z) for k, n in counts.items() for z in (k, min(1.0, docs_per_label / n))])
    picked = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def cut(batches):
        for b in chunks(batches):
            x, n = windows(*utf8(b.column("text")))
            end = np.cumsum(n)
            keep = [sorted({int(s + (c - 1) * i // max(1, SAMPLE_WINDOWS - 1)) for i in range(SAMPLE_WINDOWS)}) if c else [] for s, c in zip(end - n, n, strict=True)]
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "win": pa.array([[x[i].tobytes() for i in k] for k in keep], pa.list_(pa.binary()))})

    got = sorted((r.lang, [bytes(w) for w in r.win]) for r in picked.mapInArrow(cut, "lang string, win array<binary>").collect())
    labels = sorted({g[0] for g in got})
    x = np.frombuffer(b"".join(w for g in got for w in g[1]), np.uint8).reshape(-1, WINDOW + LOOK)
    y = np.array([labels.index(g[0]) for g in got for _ in g[1]])
    net = ByteConvNet(labels)
    net.fit(x, y)
    return net


def predict_language(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, from all windows of the whole text.

    The prediction is the label with the highest mean log probability over the windows, the score its mean
    probability. A null text, or one without a letter, is `und` with score 0. Repeated rows stay; a tie takes
    the first label in order; ids are of any type and may be null; other columns are not read.
    """
    t = net.tables() if net else None

    def run(batches):
        for b in chunks(batches, most=1 << 20):
            x, n = windows(*utf8(b.column("text")))
            name, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if net is not None and len(x):
                lp, full = net.log_probs(x, t), n > 0
                at = (np.cumsum(n) - n)[full]
                mean = np.add.reduceat(lp, at, axis=0) / n[full, None]
                best = mean.argmax(1)
                p = np.add.reduceat(np.exp(lp), at, axis=0) / n[full, None]
                has = full & b.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                name[full], score[full] = np.array(net.labels, object)[best], np.clip(p[np.arange(len(best)), best], 0, 1)
                name[~has], score[~has] = "und", 0
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "lang_pred": pa.array(name, pa.string()), "score": pa.array(score)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = fit_language(docs.where(crc_mod(F.col("doc_id"), 5) != 0), "doc_id", "text", "lang")
    return predict_language(docs, net).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL = {}
