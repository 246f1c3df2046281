"""Runs of repeated words against a plain search of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basinspark.llm import runs


def plain_runs(w, least=6, periods=4):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, periods * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


@st.composite
def texts(draw):
    some = st.lists(st.integers(0, draw(st.integers(0, 3))), max_size=30)
    return draw(st.lists(st.builds(lambda a, b, k, c: a + b * k + c, some, st.lists(st.integers(0, 2), max_size=9), st.integers(0, 40), some), max_size=4))


@settings(max_examples=150, deadline=None)
@given(texts(), st.sampled_from([(6, 4), (2, 2), (9, 3)]))
def test_runs_against_brute_force(docs, limits):
    got = [list(map(tuple, r.tolist())) for r in runs.runs_of([np.array(d, np.int64) for d in docs], *limits)]
    assert got == [plain_runs(d, *limits) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=200), st.data())
def test_extensions(w, data):
    w = np.array([*w, 7])
    i = data.draw(st.integers(0, len(w) - 1))
    j = data.draw(st.integers(0, len(w) - 1).filter(lambda x: x != i))
    k = 0
    while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
        k += 1
    assert runs.Extensions(w)(np.array([i]), np.array([j]))[0] == k


def test_small_blocks_of_the_grid(monkeypatch):
    w = [np.array([0, 1, 2] * 30 + [5] * 20 + list(range(40)) * 5), np.arange(100) % 7]
    want = [r.tolist() for r in runs.runs_of(w)]
    monkeypatch.setattr(runs, "GRID_POINTS", 3)
    assert [r.tolist() for r in runs.runs_of(w)] == want


def plain_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), s, m, q, 1000 * m // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def test_query_against_brute_force(spark, sf):
    got = runs.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [d for d in docs if len((d.text or "").split()) < 3000]
    assert len(short) > 150
    want = {d.doc_id: plain_row(d.doc_id, d.text) for d in short}
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs) and {k: rows[k] for k in want} == want
    assert sum(r[1] for r in want.values()) > 10


def test_runs_odd(spark, odd, none):
    got = {r.doc_id: r for r in runs.periodic_runs(odd).collect()}
    assert runs.periodic_runs(odd).count() == odd.count() and runs.periodic_runs(none).count() == 0
    assert [(got[k].runs, got[k].collapsed) for k in (1, 2, 3)] == [([], "")] * 3
    assert [tuple(r) for r in got[5].runs] == [(0, 20000, 1)] and got[5].collapsed == "word"
    assert got[7].collapsed == "é ü 日本 <|endoftext|> 12's"
    ids = spark.createDataFrame([(None, "a b " * 4, 1), ("x", None, 2)], "doc_id string, text string, runs int")
    assert sorted((str(r.doc_id), len(r.runs), r.collapsed) for r in runs.periodic_runs(ids).collect()) == [("None", 1, "a b"), ("x", 0, "")]
    planted = runs.with_planted_runs(ids)
    assert planted.where("doc_id IS NULL").first().text == "a b " * 4


def test_fewer_than_two_periods():
    with pytest.raises(ValueError):
        runs.runs_of([], 6, 1)
