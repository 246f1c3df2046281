"""Personal data: patterns with checks, and a skip-chain conditional random field that adds what they miss.

A node is a token with a digit or an @; tokens without are outside by definition, so the chain falls apart where they
stand. Neighbouring nodes share an edge. Tokens of a document that are equal but for punctuation, or end in the same
seven digits, hang on one node of their own that stands for what they name: so any two of them are two edges apart
and a token that occurs k times brings k edges, not k * k. Labels spread over these loops by message passing.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table

# The kinds and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IN_TOKEN, MARK = LOCAL | {"@", "(", ")"}, re.compile("[0-9@]")
LABELS = len(KINDS) + 1  # 0 is outside
BUCKETS, ROUNDS = 1 << 12, 40  # hashed features; rounds of messages at most
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 20_000  # documents learnt from, and their greatest length
CHAIN, SAME, SIMILAR = range(3)  # kinds of edges


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find and the checks let pass, by kind, then start. The time is linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    for m in DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in parts[k : k + 4]):
                out.append((1, start, start + size))
            start += size + 1
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Runs of digits with their length, of letters, and other signs as they are."""
    return re.sub(r"[0-9]+", lambda m: f"9{min(m.end() - m.start(), 20)}", re.sub(r"[A-Za-z]+", "a", token))


def features(token: str, before: str, after: str) -> list[str]:
    digits = re.sub(r"[^0-9]", "", token)
    core = token.strip("._%+()-")
    parts = core.split(".")
    return ["", "s" + shape(core)[:40], "t" + re.sub(r"9\d+", "9", shape(token))[:40], f"n{min(len(digits), 20)}",
            f"@{token.count('@')}{'.' in core.partition('@')[2]}", f"l{13 <= len(digits) <= 19 and luhn(digits)}",
            f"i{len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}", f"({token[:1] in '+('}{token[-1:] == ')'}",
            "b" + re.sub(r"9\d+", "9", shape(before))[:20], "a" + re.sub(r"9\d+", "9", shape(after))[:20]]


def nodes(text: str) -> list[tuple[int, int]]:
    """Start and end of each token that holds a digit or an @, looked for from these outwards."""
    out, end, n = [], 0, len(text)
    m = MARK.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in IN_TOKEN:
            start -= 1
        end = m.end()
        while end < n and text[end] in IN_TOKEN:
            end += 1
        out.append((start, end))
        m = MARK.search(text, end)
    return out


class Graph:
    """The nodes and edges of a run of texts."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        """spans: what the patterns found in each text; a token inside one says so in a feature of its own."""
        self.doc, self.start, self.end = [], [], []  # of each token; nodes that tokens hang on come after them
        node, feature, edges, groups = [], [], [], []
        known: dict = {}
        for d, (text, found) in enumerate(zip(texts, spans, strict=True)):
            tokens = nodes(text)
            first, named = len(self.doc), defaultdict(list)
            inside = _overlaps(tokens, found)
            strings = [text[a:b] for a, b in tokens]
            for k, (a, b) in enumerate(tokens):
                i = first + k
                near = [k > 0 and a - tokens[k - 1][1] <= 2, k + 1 < len(tokens) and tokens[k + 1][0] - b <= 2]
                if near[0]:
                    edges.append((i - 1, i, CHAIN))
                fs = features(strings[k], strings[k - 1] if near[0] else "", strings[k + 1] if near[1] else "")
                fs.append(f"k{inside[k]}")
                for f in fs:
                    if f not in known:
                        known[f] = zlib.crc32(f.encode()) % BUCKETS
                node += [i] * len(fs)
                feature += map(known.__getitem__, fs)
                plain = re.sub(r"[^A-Za-z0-9]", "", strings[k]).lower()
                digits = re.sub(r"[^0-9]", "", plain)
                if len(plain) > 3:
                    named[plain].append(i)
                if len(digits) > 6:
                    named[digits[-7:], SIMILAR].append(i)
                self.doc.append(d)
                self.start.append(a)
                self.end.append(b)
            groups += [(SIMILAR if isinstance(key, tuple) else SAME, members) for key, members in named.items() if len(members) > 1]
        self.tokens = hub = len(self.doc)
        self.groups = groups
        for kind, members in groups:
            edges += [(i, hub, kind) for i in members]
            hub += 1
        self.nodes = hub
        self.node, self.feature = np.array(node, np.int64), np.array(feature, np.int64)
        self.u, self.v, self.kind = np.array(edges, np.int64).reshape(-1, 3).T


def _overlaps(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """For each token 1 + the kind of the first span that it meets, by kind; 0 for none."""
    out, starts = [0] * len(tokens), np.array([a for a, _ in tokens], np.int64)
    ends = np.array([b for _, b in tokens], np.int64)
    for kind, a, b in spans:
        for k in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))):
            out[k] = out[k] or kind + 1
    return out


def _softmax(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    x = np.exp(x - x.max(axis=axes, keepdims=True))
    return x / x.sum(axis=axes, keepdims=True)


def messages(unary: np.ndarray, u: np.ndarray, v: np.ndarray, kind: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS, still: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of nodes and edges by loopy sum-product, all messages at once, half of each kept from the round before.

    pair[k] are the log potentials of edges of kind k. Exact on trees once the messages stand still.
    """
    n, labels = unary.shape
    right, left = np.zeros((len(u), labels)), np.zeros((len(u), labels))
    ends, total = np.concatenate([v, u]), unary
    of_kind = [np.flatnonzero(kind == k) for k in range(len(pair))]

    def send(x, potentials):
        top = x.max(axis=1, keepdims=True)
        x, m = np.exp(x - top), np.empty_like(x)
        for k, these in enumerate(of_kind):
            m[these] = x[these] @ potentials[k]
        m = np.log(m) + top
        return m - m.max(axis=1, keepdims=True)

    potential = np.exp(pair)
    turned = potential.transpose(0, 2, 1)
    for _ in range(rounds if len(u) else 0):
        r, l = send(total[u] - left, potential), send(total[v] - right, turned)  # noqa: E741
        change = max(np.abs(r - right).max(), np.abs(l - left).max())
        right, left = (r + right) / 2, (l + left) / 2
        both = np.concatenate([right, left])
        total = unary + np.stack([np.bincount(ends, both[:, k], n) for k in range(labels)], axis=1)
        if change < still:
            break
    edge = _softmax((total[u] - left)[:, :, None] + (total[v] - right)[:, None, :] + pair[kind], (1, 2))
    return _softmax(total, (1,)), edge


class SkipChain:
    """The model: weights of features, of labels that meet on an edge, and of what a shared node is."""

    def __init__(self):
        self.unary = np.zeros((BUCKETS, LABELS))
        self.pair = np.stack([np.eye(LABELS) * s for s in (0.5, 1.5, 1.0)])
        self.shared = np.zeros((3, LABELS))

    def scores(self, g: Graph) -> np.ndarray:
        out = np.stack([np.bincount(g.node, self.unary[g.feature, k], g.nodes) for k in range(LABELS)], axis=1)
        for k, (kind, _) in enumerate(g.groups):
            out[g.tokens + k] = self.shared[kind]
        return out

    def beliefs(self, g: Graph, still: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        return messages(self.scores(g), g.u, g.v, g.kind, self.pair, still=still)

    def fit(self, g: Graph, labels: np.ndarray, steps: int = 100, rate: float = 0.15, decay: float = 1e-4) -> SkipChain:
        """Likelihood ascent with the beliefs' expectations, by Adam; labels are those of the tokens, then of the shared nodes."""
        truth = np.eye(LABELS)[labels]
        groups = np.array([k for k, _ in g.groups], np.int64)
        params = [self.unary, self.pair, self.shared]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            node, edge = self.beliefs(g, still=0.01)
            off = truth - node
            both = np.einsum("el,ek->elk", truth[g.u], truth[g.v]) - edge
            grads = [np.stack([np.bincount(g.feature, off[g.node, k], BUCKETS) for k in range(LABELS)], axis=1), np.stack([both[g.kind == k].sum(axis=0) for k in range(3)]), np.stack([off[g.tokens :][groups == k].sum(axis=0) for k in range(3)])]
            for p, d, (m, s) in zip(params, grads, moments, strict=True):
                d = d / max(1, g.tokens) - decay * p
                m += 0.1 * (d - m)
                s += 0.02 * (d * d - s)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-8)
        return self


def altered(kind: int, span: str, r: random.Random) -> tuple[str, bool]:
    """The same entity written so that no pattern finds it, and whether only the document can tell what it is."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        local, _, domain = span.partition("@")
        return r.choice([(f"{local}@{domain.split('.')[0]}", False), (f"{local} @{domain}", False), (f"{local}(at){domain}", False), (f"{local}.{domain.split('.')[0]}", True)])
    if kind == 1:
        p = span.split(".")
        return r.choice([("-".join(p), True), (f"{p[0]} .{'.'.join(p[1:])}", True), ("".join(p), True)])
    if kind == 2:
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return r.choice([(".".join(four), False), ("_".join(four), False), ("  ".join(four), False), (digits[-8:], True)])
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return r.choice([(f"({a}) {b}-{c}", False), (f"{a}-{b}-{c}", False), (f"{a}.{b}.{c}", False), (f"{a}{b}{c}", True), (f"{b}-{c}", True)])


def training_texts(texts: list[str], seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, true spans): each text as it is, with its own entities altered and put in elsewhere, and with altered ones of another text.

    An altered entity is true where it is clear by itself or stands beside its plain form, else it is not.
    """
    r, out, pool = random.Random(seed), [], []
    found = [(t, base_spans(t)) for t in texts]
    pool = [(k, t[a:b]) for t, s in found for k, a, b in s]
    for text, spans in found:
        out.append((text, spans))
        own = [(k, text[a:b]) for k, a, b in spans]
        for own_ones in (True, False):
            put = r.sample(own, min(3, len(own))) if own_ones else [r.choice(pool) for _ in range(2)] if pool else []
            cuts = [m.start() for m in re.finditer(r"(?<=[^\W\d_])\s(?=[^\W\d_])", text)]
            if not put or not cuts:
                continue
            parts, true, at, size = [], [], 0, 0
            moved = []
            for (kind, span), cut in zip(put, sorted(r.sample(cuts, min(len(put), len(cuts)))), strict=False):
                new, needs = altered(kind, span, r)
                parts.append(text[at:cut] + " ")
                size += cut - at + 1
                if not needs or own_ones or (kind, span) in own:
                    true.append((kind, size, size + len(new)))
                moved.append((cut, len(new) + 1))
                parts.append(new)
                size += len(new)
                at = cut
            parts.append(text[at:])
            for k, a, b in spans:
                shift = sum(n for cut, n in moved if cut <= a)
                if not any(a < cut < b for cut, _ in moved):
                    true.append((k, a + shift, b + shift))
            out.append(("".join(parts), sorted(true)))
    return out


def fit(texts: list[str], seed: int = 5) -> SkipChain:
    """The model learnt from texts whose entities the patterns find, and from altered copies of them."""
    rows = training_texts(texts, seed)
    g = Graph([t for t, _ in rows], [base_spans(t) for t, _ in rows])
    of: list = [[] for _ in rows]
    for i in range(g.tokens):
        of[g.doc[i]].append((g.start[i], g.end[i]))
    label = [x for tokens, (_, true) in zip(of, rows, strict=True) for x in _overlaps(tokens, true)]
    for _, members in g.groups:
        label.append(max((label[i] for i in members), default=0))
    return SkipChain().fit(g, np.array(label, np.int64)) if g.tokens else SkipChain()


def _whole(kind: int, token: str) -> bool:
    n = sum(map(str.isdigit, token))
    return ("@" in token, token.count(".") == 3, n >= 13, n >= 9)[kind]


def added_spans(texts: list[str], found: list[list[tuple[int, int, int]]], model: SkipChain, least: float = 0.5) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, belief) of the entities beside the patterns' own: tokens in a row with one likeliest kind, of a belief of `least` or more."""
    out: list = [[] for _ in texts]
    g = Graph(texts, found)
    if not g.tokens:
        return out
    belief = model.beliefs(g)[0][: g.tokens]
    label = np.where(belief[:, 1:].max(axis=1) >= least, belief[:, 1:].argmax(axis=1) + 1, 0)
    open_: list | None = None
    for i in range(g.tokens):
        text, kind, p = texts[g.doc[i]], int(label[i]) - 1, float(belief[i, label[i]])
        token = text[g.start[i] : g.end[i]]
        joins = open_ is not None and open_[0] == g.doc[i] and open_[1] == kind and g.start[i] - open_[3] <= 2 and not (_whole(kind, token) or open_[5]) and token[0] != "+"
        if open_ is not None and not joins:
            out[open_[0]].append(tuple(open_[1:5]))
            open_ = None
        if joins:
            open_[3], open_[4] = g.end[i], min(open_[4], p)
        elif kind >= 0:
            open_ = [g.doc[i], kind, g.start[i], g.end[i], p, _whole(kind, token)]
    if open_ is not None:
        out[open_[0]].append(tuple(open_[1:5]))
    for d, spans in enumerate(out):
        taken = np.array(sorted((a, b) for _, a, b in found[d]), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(taken[:, 1])  # the greatest end of spans up to here
        keep = []
        for kind, a, b, p in spans:
            body = texts[d][a:b]
            head, tail = ("._%-)", "._%+(-") if kind == 3 else ("._%+()-", "._%+()-")
            a, b = a + len(body) - len(body.lstrip(head)), b - len(body) + len(body.rstrip(tail))
            k = int(np.searchsorted(taken[:, 0], b)) - 1
            if a < b and not (k >= 0 and reach[k] > a):
                keep.append((kind, a, b, p))
        out[d] = keep
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> SkipChain:
    """The model learnt from `sample_docs` documents of at most `sample_chars` code points that hold a digit or an @, chosen by a hash; null texts are none of them."""
    text, chosen = F.col(f"`{text_col}`"), F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), F.lit(1 << 40))
    rows = docs.select(text.alias("text"), chosen.alias("h")).where(text.rlike("[0-9@]") & (F.length(text) <= sample_chars))
    share = min(1.0, 2 * sample_docs / max(1, rows.count()))
    some = rows.where(F.col("h") <= int(share * (1 << 40))).orderBy("h", "text").limit(sample_docs).collect()
    return fit([r.text for r in some])


def personal_data(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: id, base and added (arrays of kind, start, end in code points, and belief), by kind, then start.

    base holds what the patterns find and the checks let pass, added what the model sees beside it; no added span
    meets a base one. Null, empty and blank texts have none. Repeated rows and ids of any type stay, nulls too; no rows,
    no rows; other columns are not carried. Whole texts are read; a task holds a chunk of short texts or one long one.
    """
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("belief", pa.float64())]

    def run(batches):
        for b in chunks(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [base_spans(t) for t in texts]
            more = added_spans(texts, found, model, least)
            named = lambda rows: pa.array([[dict(zip(("kind", "start", "end", "belief"), (KINDS[s[0]], *s[1:3], s[3] if len(s) > 3 else 1.0), strict=True)) for s in sorted(r)] for r in rows], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([b.column("id"), named(found), named(more)], ["id", "base", "added"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spans = "array<struct<kind:string,start:long,end:long,belief:double>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def op13_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = personal_data(docs, learn(docs))
    count = [F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    place = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return d.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined(order).alias("spans"))


QUERIES = {"op13_personal_data": op13_personal_data}
ORACLE_SQL: dict = {}
