"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers replace the tokenizer library. The first reads character classes and marks
where a pretoken ends; a run of texts is cut into pieces of equal length, each piece yields its map from
start state to end state, the maps are composed by a parallel prefix scan, and a second pass over all
pieces at once emits the marks. The second reads the bytes of a pretoken; its transitions carry the
change of the token count, and its states are made when first reached.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, mix, table, utf8

# Character classes of the pretokenizer's pattern, fixed by the vocabulary file's format:
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, L_S, L_T, L_R, L_E, L_V, L_M, L_L, L_D, END = range(15)
N_CLASSES = 15
LETTERS = range(L_S, L_D + 1)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point; surrogates, which UTF-8 texts lack, are OTHER."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = cls
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for c, cls in zip("strevmld", (L_S, L_T, L_R, L_E, L_V, L_M, L_L, L_D), strict=True):
        out[ord(c)] = cls
    return out


def _kind(c: int) -> int:
    return LETTER if c in LETTERS else OTHER if c == QUOTE else c


@functools.cache
def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins): begins is 1 if the character read begins a pretoken, 2 if the one before it does.

    A state is what the open pretoken is: ("run", class), ("sp",) one space that a word may still join,
    ("ws", last is a space) a longer run of white space, ("q",) an apostrophe that began a pretoken,
    ("qx", letter) with r, v or l after it, ("full",) a contraction that is complete. White space before a
    word gives its last character away: if that is a space the word takes it, else it stands alone.
    """
    start = ("end",)
    index, todo, rows = {start: 0}, [start], {}

    def fresh(c):
        return ("end",) if c == END else ("q",) if c == QUOTE else ("sp",) if c == SPACE else ("ws", False) if c == BLANK else ("run", _kind(c))

    def step(s, c):
        k = _kind(c)
        if c == END:
            return start, 1
        if s[0] == "run" and s[1] == k:
            return s, 0
        if s[0] == "sp":
            if c in (SPACE, BLANK):
                return ("ws", c == SPACE), 0
            return ("run", k), 0
        if s[0] == "ws":
            if c in (SPACE, BLANK):
                return ("ws2", c == SPACE), 0
            return (("run", k), 2) if s[1] else (fresh(c), 3)
        if s[0] == "ws2":
            if c in (SPACE, BLANK):
                return ("ws2", c == SPACE), 0
            return (("run", k), 2) if s[1] else (fresh(c), 3)
        if s[0] == "q":
            if c in (L_S, L_T, L_M, L_D):
                return ("full",), 0
            if c in (L_R, L_V, L_L):
                return ("qx", c), 0
            if k == OTHER:
                return ("run", OTHER), 0
            return fresh(c), 1
        if s[0] == "qx":
            if (s[1] in (L_R, L_V) and c == L_E) or (s[1] == L_L and c == L_L):
                return ("full",), 0
            return (("run", LETTER), 2) if k == LETTER else (fresh(c), 3)
        return fresh(c), 1

    while todo:
        s = todo.pop()
        rows[s] = [step(s, c) for c in range(N_CLASSES)]
        for t, _ in rows[s]:
            if t not in index:
                index[t] = len(index)
                todo.append(t)
    nxt, mark = np.zeros((len(index), N_CLASSES), np.uint8), np.zeros((len(index), N_CLASSES), np.uint8)
    for s, row in rows.items():
        for c, (t, m) in enumerate(row):
            nxt[index[s], c], mark[index[s], c] = index[t], m
    return nxt, mark


def prefix_states(maps: np.ndarray) -> np.ndarray:
    """The state in which each piece begins, from state 0: the maps' exclusive prefix composition.

    maps[i, s] is the state after piece i when it begins in s. Hillis-Steele scan: log2(pieces) rounds, each
    composing all pieces at once.
    """
    n, gap, scan = len(maps), 1, maps
    while gap < n:
        later = np.take_along_axis(scan[gap:], scan[:-gap].astype(np.intp), axis=1)
        scan = np.concatenate([scan[:gap], later])
        gap *= 2
    out = np.zeros(n, np.uint8)
    out[1:] = scan[:-1, 0]
    return out


def pretoken_starts(classes: np.ndarray, width: int = 64) -> np.ndarray:
    """Boolean for each class symbol: does a pretoken begin there? END symbols begin one too."""
    nxt, mark = split_transducer()
    n, n_states = len(classes), len(nxt)
    if not n:
        return np.zeros(0, bool)
    pieces = -(-n // width)
    grid = np.full(pieces * width, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(pieces, width).T)
    flat, at = nxt.T.ravel().astype(np.uint8), np.tile(np.arange(n_states, dtype=np.uint8), (pieces, 1))
    for row in grid:
        at = flat[row.astype(np.uint16)[:, None] * np.uint16(n_states) + at]
    state = prefix_states(at)
    begins, flat_mark = np.zeros((width, pieces), np.uint8), mark.T.ravel()
    for j, row in enumerate(grid):
        here = row.astype(np.uint16) * np.uint16(n_states) + state
        begins[j] = flat_mark[here]
        state = flat[here]
    begins = begins.T.ravel()[:n]
    out = (begins & 1).astype(bool)
    out[np.flatnonzero(begins & 2) - 1] = True
    return out


class CountTransducer:
    """Token counts of single pretokens, byte by byte.

    A state holds, for each suffix of what was read that may still begin a longer token, the last token of
    the prefix before it and that prefix's count relative to now; reading a byte finds the one token that
    ends here and that may follow the last token of the prefix before it. Transitions carry the change of
    the count and are made when first needed.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in byte_alphabet().items()}
        text = {t: bytes(byte_of[c] for c in t) for t in spec["model"]["vocab"] if all(c in byte_of for c in t)}
        ranks = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks[text[a], text[b]] = r
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.ranks, self.merged = ranks, {a + b: (r, a, b) for (a, b), r in sorted(ranks.items(), key=lambda x: -x[1])}
        self.tokens = {t: t for t in ({bytes([b]) for b in range(256)} | set(self.merged))}
        self.heads = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.whole = (-1, b"", b"")  # a single byte is not merged from anything
        self.forget()
        self.known, self.known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def forget(self) -> None:
        self.follows: dict = {}
        self.states = [(((None, 0),), b"")]
        self.next: dict[int, tuple[int, int]] = {}
        self.index = {self.states[0]: 0}

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Do the merges leave a and b apart? No pair across the border may merge before its sides are made."""
        got = self.follows.get((a, b))
        if got is None:
            x, y, bound = a, b, 1 << 30
            while True:
                if self.ranks.get((x, y), bound) < bound:
                    got = False
                    break
                mx, my = self.merged.get(x, self.whole), self.merged.get(y, self.whole)
                if mx is my is self.whole:
                    got = True
                    break
                if mx[0] > my[0]:
                    bound, x = mx[0], mx[2]
                else:
                    bound, y = my[0] + 1, my[1]
            self.follows[a, b] = got
        return got

    def _make(self, state: int, byte: int) -> tuple[int, int]:
        before, tail = self.states[state]
        # before[i]: (last token, count relative to now) of the prefix that ends where tail[i:] begins, or
        # None where no token goes on from there; the prefix that ends now comes last
        full = tail + bytes([byte])
        for i, spot in enumerate(before):
            if spot and (t := self.tokens.get(full[i:])) and (spot[0] is None or self.may_follow(spot[0], t)):
                break
        change = spot[1] + 1
        spots = [*before, (t, change)]
        keep = next((i for i in range(len(full)) if full[i:] in self.heads), len(full))
        live = [s and (s[0], s[1] - change) if i == len(full) or full[i:] in self.heads else None for i, s in enumerate(spots)]
        key = (tuple(live[keep:]), full[keep:])
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
        return self.index[key], change

    def count(self, word: bytes) -> int:
        state, n, table = 0, 0, self.next
        for b in word:
            hop = table.get(state << 8 | b)
            if hop is None:
                hop = table[state << 8 | b] = self._make(state, b)
            state, d = hop
            n += d
        return n

    def counts(self, hashes: np.ndarray, word: Callable[[int], bytes]) -> np.ndarray:
        """Counts of distinct pretokens by their hash; those seen lately come from a bounded memory."""
        at = np.searchsorted(self.known, hashes)
        out, seen = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        if len(self.known):
            at = np.minimum(at, len(self.known) - 1)
            seen = self.known[at] == hashes
            out[seen] = self.known_counts[at[seen]]
        new = np.flatnonzero(~seen)
        out[new] = [self.count(word(i)) for i in new]
        if len(self.known) > MAX_KNOWN:
            self.known, self.known_counts = hashes, out
        elif len(new):
            every = np.concatenate([self.known, hashes[new]])
            order = np.argsort(every)
            self.known, self.known_counts = every[order], np.concatenate([self.known_counts, out[new]])[order]
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


MAX_STATES, MAX_KNOWN = 150_000, 2_000_000  # beyond these what was made lazily is dropped and made anew: memory, not results


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text; the vocabulary's special strings count as one token where they stand."""
    t = transducer(path)
    if len(t.states) > MAX_STATES:
        t.forget()
    raw, off = utf8(texts)
    n = len(off) - 1
    # characters: where each begins in the bytes, and its code point
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    classes = char_classes()[code]
    extra = np.zeros(n, np.int64)
    data = raw.tobytes()
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    dead = np.zeros(len(raw), bool)
    for s in t.special:
        at = data.find(s)
        while at >= 0:
            doc = int(np.searchsorted(off, at, side="right")) - 1
            if at + len(s) <= off[doc + 1]:
                extra[doc] += 1
                cut[at] = cut[at + len(s)] = dead[at : at + len(s)] = True
                at = data.find(s, at + len(s))
            else:
                at = data.find(s, at + 1)
    # an END symbol before each cut
    cuts = np.flatnonzero(cut)
    where = np.searchsorted(head, cuts)
    symbols = np.insert(classes, where, END)
    is_end = np.zeros(len(symbols), bool)
    is_end[where + np.arange(len(where))] = True
    begins = pretoken_starts(symbols)[~is_end]
    starts = head[begins]
    starts = starts[~dead[starts]] if len(dead) else starts
    bounds = np.sort(np.concatenate([starts, cuts]))
    ends = bounds[np.searchsorted(bounds, starts, side="right")] if len(starts) else starts
    # equal pretokens are counted once
    from .common import _byte_values, _powers

    p, q = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values(False)[raw] * p[: len(raw)], out=total[1:])
    h = mix((total[ends] - total[starts]) * q[starts]) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first = order[new]
    each = np.zeros(len(h), np.int64)
    each[order] = t.counts(h[first], lambda i: data[starts[first[i]] : ends[first[i]]])[np.cumsum(new) - 1]
    sums = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=sums[1:])
    at = np.searchsorted(starts, off)
    return sums[at[1:]] - sums[at[:-1]] + extra


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Repeated rows stay. Texts of any length are read whole;
    a task holds a few times the bytes of the longest. Other columns are not carried.
    """

    def run(batches):
        for b in chunks(batches, "text"):
            _, off = utf8(b.column("text"))
            n = count_tokens(b.column("text"), path)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n_bytes": pa.array(np.diff(off)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL = {}
