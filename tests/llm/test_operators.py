"""The text operators against brute force, SQL and odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basinspark.llm import components, decontaminate, jaccard, langid, lines, lm, mixing, pages, quality, tokens, urls
from basinspark.llm.common import Words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1: decontamination


def test_wand_finds_all_above_threshold():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    index = decontaminate.ItemIndex([(i, " ".join(r.choice(vocab) for _ in range(r.randint(4, 30)))) for i in range(200)], 0.3, 0.8, 5)
    for _ in range(60):
        t = np.array(sorted(r.sample(range(len(index.terms)), 20)))
        score = np.zeros(len(index.ids))
        for x in t:
            score[index.item[index.start[x] : index.start[x + 1]]] += index.weight[index.start[x] : index.start[x + 1]]
        assert {i for i, _ in index.search(t)} == {i for i in range(len(score)) if score[i] >= 0.3 - 1e-9}


def test_leaks_against_brute_force(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()}
    norm = lambda t: re.sub(r"[^\w]+", " ", t.translate(LOW)).strip()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if f" {norm(i.text)} " in f" {norm(d.text)} "}
    assert want <= got and want


def test_leaks_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three. Four five six"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaked_items(odd, items).collect()] == [(4, 1)]
    assert decontaminate.leaked_items(odd, items.where("false")).count() == 0 == decontaminate.leaked_items(none, items).count()
    named = items.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    for key, want in ((F.lit(None).cast("long"), None), (F.lit(2**60 + 1), 2**60 + 1), (F.lit("é"), "é")):
        both = odd.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id").cast(odd.select(key.alias("k")).schema["k"].dataType)).otherwise(key))
        got = decontaminate.leaked_items(both, named).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(want, "i1")]


def test_blocks_of_items(spark, sf, monkeypatch):
    """Scores don't depend on how many blocks the items are cut into."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, " . ")], "item_id long, text string"))
    found = lambda: {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.leaked_items(documents(spark, sf), items, share=0.3, overlap=0.1).collect()}
    whole = found()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert found() == whole and whole


# 2: line dedup


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_edit_distance(spark):
    r, rows = random.Random(3), []
    for _ in range(150):
        a = [r.choice("abé") for _ in range(r.randint(10, 25))]
        b = list(a)
        for _ in range(r.randint(0, 7)):
            i = r.randrange(len(b))
            b[i : i + r.randint(0, 1)] = r.choice([[], ["a"], ["b"]])
        rows += [(x, y, m, distance(a, b) <= m) for m in (1, 2, 5, 30) for x, y in ((a, b), (b, a))]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>, m int, ok boolean")
    assert d.where(lines.edit_distance_within(F.col("a"), F.col("b"), F.col("m")) != F.col("ok")).count() == 0


def test_lines_against_sql(same):
    same(lines, "op2_line_dedup")


def test_lines_odd(spark, odd, none):
    got = {(r.doc_id, r.n_removed) for r in lines.dedup_lines(odd).collect()}
    assert (1, 0) in got and (2, 0) in got and (4, 0) in got
    assert lines.dedup_lines(none).count() == 0
    d = spark.createDataFrame([(1, "a common line here\nnext is a line\n\nlast"), (2, "a common line her\nown words are new"), (3, "a common line here")], "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(d).orderBy("doc_id").collect()] == ["a common line here\nnext is a line\n\nlast", "own words are new", ""]


def test_long_lines_against_brute_force(spark):
    """Edits grow with the line: a line is removed if and only if an earlier one is within a word for 20, at every length."""
    r, every = random.Random(4), []
    for n in (*range(18, 46), 59, 60, 61, 99, 100, 160, 410, 645, 790, 801, 840, 1300):
        a = [f"{r.choice('abcdefgh')}{r.randint(0, 300)}" for _ in range(n)]
        made = [a]
        for edits in (n // 20, n // 20 + 1):
            b = list(a)
            for j in range(edits):
                i = (j * n) // edits + r.randrange(n // edits // 2)
                b[i : i + 1] = r.choice([[], [b[min(i, len(b) - 1)], "Z"], ["Z"]])
            made.append(b)
        every += [" ".join(x) for x in made]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(every)], "doc_id long, text string")
    got = {x.id for x in lines.duplicate_lines(d).collect()}
    want = set()
    for i, a in enumerate(every):
        for j in range(i // 3 * 3, i):
            a_, b_ = a.split(), every[j].split()
            n = min(len(a_), len(b_))
            if n >= 20 and distance(a_, b_) <= n // 20 or n < 20 and distance(a, every[j]) <= 2:
                want.add(i)
    assert got == want and len(want) > 30


def test_lines_of_a_large_group(spark):
    """Near copies that share segments, most within the edits of the earliest, some only of another one."""
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(60)] + [" ".join(base[:i] + ["x", "y", "z"] + base[i + 3 :]) for i in range(50)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, text string")
    want = {i for i, a in enumerate(rows) if any(distance(a.split(), b.split()) <= 3 for b in rows[:i])}
    assert {x.id for x in lines.duplicate_lines(d).collect()} == want


def test_lines_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two three\none two three", 7, "x", None), (None, None, 8, "y", 1), (1, "one two three", 9, "z", 2)], "doc_id long, text string, n_lines int, removed string, line_id int")
    got = lines.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "n_lines", "removed", "line_id", "n_lines_", "n_removed", "removed_"]
    assert sorted((r.n_lines, r.removed, r.n_removed) for r in got.collect()) == [(7, "x", 1), (8, "y", 0), (9, "z", 0)]


def test_pipeline_drops_long_near_lines(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    a = "It was a long line of many words that somebody copied with some word changed, as happens often on pages that copy each other by hand."
    d = spark.createDataFrame([(1, a, len(a), 5), (2, a.replace("somebody", "everyone"), len(a), 6), (3, "quite another line of words", 27, 7)], "doc_id long, text string, n_chars long, n_removed int")
    assert distance(a, a.replace("somebody", "everyone")) > lines.MAX_EDITS
    assert sorted((r.doc_id, r.n_removed) for r in pipeline.line_stage(spark, d, sf).collect()) == [(1, 5), (3, 7)]


# 3: mixing


def test_pivotal_keeps_the_sum():
    r = np.random.default_rng(0)
    size, p = r.integers(1, 500, 300).astype(float), r.random(300)
    q = mixing.pivotal(size, p, r.random(300))
    assert abs((size * p).sum() - (size * q).sum()) < 1e-3 and ((q > 0) & (q < 1)).sum() <= 1


def test_mixing(spark, sf):
    got = mixing.mix_sources(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    level, w = None, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index))}
    cap, total, open_ = {s: 2 * by["size"][s] for s in by.index}, 1.5 * by["size"].sum(), set(by.index)
    target = {}
    while True:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        open_ -= over
    target |= {s: level * w[s] for s in open_}
    for s in by.index:
        assert abs(by.target[s] - target[s]) < 1e-6 and abs(by.taken[s] - by.target[s]) <= by.most[s]
    deep = mixing.mix_sources(documents(spark, sf), fan_in=2).join(documents(spark, sf).select("doc_id", "source"), "doc_id").toPandas().groupby("source").taken.sum()
    assert all(abs(by.target[s] - deep[s]) <= by.most[s] for s in by.index)
    again = mixing.mix_sources(documents(spark, sf).repartition(7)).orderBy("doc_id").toPandas()
    assert (again.taken.to_numpy() == got.sort_values("doc_id").taken.to_numpy()).all()


def test_mixing_odd(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(none).count() == 0


# 4: language ID


def test_language_held_out(spark, sf):
    docs = documents(spark, sf)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = langid.fit_language(docs.where(~held), "doc_id", "text", "lang")
    got = langid.predict_language(docs.where(held), net).join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_odd(odd, none):
    net = langid.fit_language(odd, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.predict_language(odd, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred in ("en", "de", "fr")
    assert langid.fit_language(none, "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in langid.predict_language(odd, None).collect()} == {"und"} and langid.predict_language(none, net).count() == 0


def test_network_against_plain_convolution():
    r = np.random.default_rng(8)
    net = langid.ByteConvNet(["a", "b", "c"])
    net.bias, net.base = r.normal(0, 1, net.bias.shape).astype(np.float32), r.normal(0, 1, 3).astype(np.float32)
    x = r.integers(0, 256, (20, langid.WINDOW + langid.LOOK)).astype(np.uint8)
    got = net.log_probs(x, net.tables())
    for row, want in zip(x, got, strict=True):
        pool = np.concatenate([[max(sum(float(k[j, row[i + j], f]) for j in range(w)) for i in range(langid.WINDOW)) for f in range(langid.FILTERS)] for w, k in zip(langid.WIDTHS, net.conv, strict=True)])
        z = np.maximum(pool + net.bias, 0) @ net.dense + net.base
        assert np.allclose(want, z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-3)


# 5: n-gram Jaccard join


@pytest.mark.parametrize("t", [Fraction(17, 20), Fraction(4, 5)])
def test_signatures_lose_no_link(t):
    """Every pair at the threshold or above shares a signature, each pair alone, at many sizes; sketches turn none down."""
    r, sets = np.random.default_rng(5), []
    for n in (*range(2, 40), 60, 100, 250, 700):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            most = int(len(a) * (1 - t) / (1 + t)) + 1
            gone = int(r.integers(0, most + 1))
            new = r.integers(0, 1 << 63, int(r.integers(0, most + 1))).astype(np.uint64)
            sets.append((a, np.unique(np.concatenate([a[gone:], new]))))
    flat = [x for p in sets for x in p]
    size = np.array([len(x) for x in flat])
    whose, sig = jaccard.signatures(np.concatenate(flat), size, t)
    sketch, of, n_similar = jaccard.sketches(np.concatenate(flat), size), defaultdict(set), 0
    for w, x in zip(whose.tolist(), sig.tolist(), strict=True):
        of[w].add(x)
    for i, (a, b) in enumerate(sets):
        both = len(np.intersect1d(a, b))
        if len(b) and t.denominator * both >= t.numerator * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            n_similar += 1
            assert of[2 * i] & of[2 * i + 1], (len(a), len(b), both)
            u, v = (jaccard.folded([sketch[2 * i + j]], min(len(sketch[2 * i]), len(sketch[2 * i + 1]))) for j in (0, 1))
            assert jaccard.may_link(np.array([len(a)]), np.array([len(b)]), np.bitwise_count(u ^ v).sum(1, dtype=np.int64), t).all()
    assert n_similar > 500


@pytest.mark.parametrize(("words", "t", "block"), [(1, "4/5", 3), (1, "17/20", 512)])
def test_components_against_brute_force(spark, monkeypatch, words, t, block):
    """A chain of sets each similar to the next only, sets about one core that are just not similar, copies, ids that are null or repeated."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, t_, rows = random.Random(6), Fraction(t), []
    chain = [f"w{i}" for i in range(300)]
    rows += [(i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(40)]
    core = [f"c{i}" for i in range(40)]
    rows += [(100 + i, " ".join(core + [f"x{r.randint(0, 60)}" for _ in range(r.randint(0, 14))])) for i in range(80)]
    rows += [(300, rows[5][1]), (None, rows[7][1]), (None, "alone here"), (300, rows[100][1]), (301, rows[100][1])]
    sets = [frozenset(x.split()) for _, x in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * t_.denominator >= len(a | sets[j]) * t_.numerator:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(d, words=words, similarity=t).collect())
    assert got == want and len(set(least.values())) < len(rows) - 20


def test_jaccard_takes_any_id(spark):
    d = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, None)], "name string, body string")
    got = {(r.name, r.component_id) for r in jaccard.jaccard_components(d, "name", "body").collect()}
    assert got == {("a", "a"), ("b", "a"), (None, None)}


def test_jaccard_against_sql(same):
    same(jaccard, "op5_jaccard_join")


def test_jaccard_odd(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd, words=4, similarity="17/20").collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 1, 5), (6, 1, 6), (7, 2, 7), (None, 1, None)}
    assert jaccard.jaccard_components(none).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 120)] + [(200, 200), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in range(100, 120)} == {100} and len(got) == 71
    assert components.components(e.where("false")).count() == 0


# 6: quality rules


def test_statistics_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, sf)).collect()}
    for r in documents(spark, sf).collect():
        w, at, covered = words(r.text), defaultdict(list), set()
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        for p in at.values():
            if len(p) > 1:
                covered.update(j for i in p for j in range(i, i + 8))
        ls = [x for x in r.text.split("\n") if words(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(ls) - len(set(ls)), len(covered))
        assert g.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (g.base_failed and g.kept)


def test_outliers(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["tree", "river", "stone", "of", "the"]) for _ in range(r.randint(60, 120))), "en", None) for i in range(80)]
    rows += [(100, " ".join("#$%&" + r.choice(["a", "b"]) for _ in range(80)), "en", None)]
    got = {x.doc_id: x.kept for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(100) and sum(got.values()) >= 78


def test_labelled_quality(spark):
    """Of the documents that pass the base rules nearly all labelled good are kept and nearly all labelled bad rejected."""
    folder = "/root/testdata/sf0.01"
    got = quality.quality_rules(documents(spark, folder)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in got}
    assert min(r.n for r in got) >= 10 and kept[1] >= 0.98 and kept[0] <= 0.1


def test_small_groups(spark):
    """A group of a few rows is judged nearly as its language, a larger one by itself; every row gets a distance."""
    r = random.Random(3)
    text = lambda unit, n: " ".join(r.choice(unit) for _ in range(n))
    plain, marked = ["tree", "river", "stone", "of", "and"], ["#tree", "river", "#stone", "of", "#and"]
    rows = [(i, text(plain, r.randint(60, 120)), "en", "a") for i in range(300)] + [(1000 + i, text(marked, r.randint(60, 120)), "en", "b") for i in range(4)] + [(2000 + i, text(marked, r.randint(60, 120)), "en", "c") for i in range(150)]
    rows += [(3000 + i, text(plain, r.randint(60, 120)), "de", f"s{i}") for i in range(100)] + [(3999, text(["#$%&"], 80), "de", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality_rules(d.where("source <> 'c'")).collect()}
    assert all((x.distance is None) == x.base_failed for x in got.values()) and not any(got[1000 + i].kept for i in range(4))
    assert not got[3999].kept and sum(got[3000 + i].kept for i in range(100)) >= 95
    own = {x.doc_id: x.kept for x in quality.quality_rules(d.where("source <> 'b'")).collect()}
    assert sum(own[2000 + i] for i in range(150)) >= 140 and sum(own[i] for i in range(300)) >= 285


def test_estimates_against_plain_search(spark):
    """The determinant comes near the least of many random starts, and the verdicts agree."""
    r, k = np.random.default_rng(5), len(quality.FEATURES)
    mix = np.tril(r.normal(0, 0.6, (k, k))) + np.eye(k)
    x = np.concatenate([r.normal(0, 1, (400, k)) @ mix.T, r.normal(0, 0.4, (80, k)) + [9, -7, 8, 0, 5]])
    floors = np.diag(np.square(quality.FLOORS))
    away = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(100):
        at = r.choice(len(x), k + 1, replace=False)
        for _ in range(30):
            m, c = x[at].mean(0), quality.SCALE * np.cov(x[at].T, bias=True) + floors
            at = np.argsort(away(m, c))[: int(quality.KEPT_SHARE * len(x))]
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c
    near = x[away(*best[1:]) <= quality.CUTOFF]
    want = away(near.mean(0), np.cov(near.T, bias=True) + floors) <= quality.CUTOFF
    rows = spark.createDataFrame([("p", "k", i, *map(float, v)) for i, v in enumerate(x)], "parent string, key string, i int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    e = quality.robust_estimates(rows).first()
    low = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(k)] for i in range(k)])
    got = away(np.array([e[f"m_{i}"] for i in range(k)]), low @ low.T) <= quality.CUTOFF
    assert not want[400:].any() and not got[400:].any() and (got == want).mean() >= 0.99
    assert abs(np.linalg.det(low @ low.T) / np.linalg.det(np.cov(near.T, bias=True) + floors) - 1) < 0.05


def test_quality_odd(odd, none):
    got = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert got[1].n_words == 0 and not got[1].kept and got[5].n_repeat_words == 20000
    assert quality.quality_rules(none).count() == 0


# 7: language model


def test_kneser_ney_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = lm.fit_kneser_ney(docs.where("doc_id % 4 <> 1"), shards=5)
    got = {r.doc_id: r for r in lm.score_kneser_ney(docs, model).collect()}
    tok = lambda t: ["<s>", *words((t or "").translate(LOW)), "</s>"]
    uni, bi = Counter(), Counter()
    for d, t in rows:
        if d % 4 != 1:
            k = tok(t)
            uni.update(k[1:])
            bi.update(zip(k, k[1:]))
    n, v = sum(uni.values()), len(uni)
    ctx, kinds, types = Counter(), defaultdict(lambda: [0] * 4), Counter()
    for (a, b), c in bi.items():
        ctx[a] += c
        kinds[a][min(c, 3)] += 1
        types[b] += 1
    cc = lambda x: [sum(1 for c in x if c == i) for i in (1, 2, 3, 4)]
    d2, d1, total = lm._discounts(cc(bi.values())), lm._discounts(cc(types.values())), sum(types.values())
    rest = sum(d1[min(c, 3) - 1] for c in types.values()) / total
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    for d, t in rows[:60]:
        k, score, base = tok(t), 0.0, 0.0
        for a, b in zip(k, k[1:]):
            p1 = cut(types.get(b, 0), d1) / total + rest / (v + 1)
            c = ctx.get(a, 0)
            score += math.log10(cut(bi.get((a, b), 0), d2) / c + sum(d2[i - 1] * kinds[a][i] for i in (1, 2, 3)) / c * p1 if c else p1)
            base += math.log10((uni.get(b, 0) + 0.5) / (n + 0.5 * (v + 1)))
        assert abs(got[d].score - score) < 1e-6 and abs(got[d].base_score - base) < 1e-6
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(k) - 1, sum(b in uni for b in k[1:]), n)


def test_kneser_ney_sums_to_one(odd):
    model = lm.fit_kneser_ney(odd, shards=3)
    w = Words(pa.array(["one two three four five six word é ü 日本 <|endoftext|> 12's " + "x" * 50000]))
    every = np.concatenate([w.hash, [lm.END]])
    p, _ = model.logs(np.full(len(every), w.hash[0]), every)
    unseen, _ = model.logs(w.hash[:1], np.array([12345], np.uint64))
    assert abs((10**p).sum() + 10 ** unseen[0] - 1) < 1e-9


def test_kneser_ney_odd(odd, none):
    assert lm.score_kneser_ney(odd, lm.fit_kneser_ney(none)).where("score > 0 OR n_known > 0").count() == 0
    got = {r.doc_id: r.n_tokens for r in lm.score_kneser_ney(odd, lm.fit_kneser_ney(odd)).collect()}
    assert got[1] == 1 and got[5] == 20001


# 8: token counts


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_tokens_against_library(vocabulary):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(vocabulary), random.Random(1)
    cases = ["", " ", "  ", "it's we're  'x 'l 'll !'s", "a <|endoftext|> b<|endoftext|><|endoftext|>", "日本語 123 4５　x\xa0y", "a" * 300, "\t\tfoo\r\n x  "]
    cases += ["".join(r.choice(" \n\t'strevmldab1!é日　x") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert tokens.count_tokens(pa.array(cases), vocabulary).tolist() == [len(e.ids) for e in t.encode_batch(cases, add_special_tokens=False)]


def test_prefix_states_match_a_plain_walk():
    nxt, mark = tokens.split_transducer()
    c = np.random.default_rng(0).integers(0, tokens.N_CLASSES, 1000).astype(np.uint8)
    state, begins = 0, np.zeros(1000, bool)
    for i, x in enumerate(c):
        m, state = mark[state, x], nxt[state, x]
        begins[i] |= bool(m & 1)
        if m & 2:
            begins[i - 1] = True
    assert (tokens.pretoken_starts(c, 7) == begins).all()


def test_tokens_odd(vocabulary, odd, none):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(odd, vocabulary).collect()}
    assert got[1] == got[2] == (0, 0, False) and got[5][2]
    assert tokens.token_counts(none, vocabulary).count() == 0


# 9: HTML


def test_common_lines():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got, it = pages.common_lines(a, b), iter(b)
        assert len(got) == t[-1][-1] and all(a[i] in it for i in got)


def test_pages(spark):
    shared = "<div>Same head</div><p>Menu of the house</p>"
    rows = [(1, "http://h.x/a/1", f"{shared}<p>First&nbsp;own\n text &amp; more<p>second</p><div class='side ad'>buy</div>"), (2, "http://h.x/a/2", f"{shared}<p>Other text</p>"), (3, "http://o.x/z", "<nav>n</nav><article><h1>T</h1><script>var a='<p>'</script><p>b</p></article><footer>f</footer>"), (4, None, None), (5, "http://lone.x/", "<p>alone"), (6, "http://h.x/a/1", None)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First own text & more\nsecond", 2: "Other text", 3: "T\nb", 4: "", 5: "alone", 6: ""}


def test_pages_of_one_path(spark):
    """Pages that differ in the query are each other's partners; versions of one URL, copies and empty pages are not."""
    page = lambda x: f"<p>Menu of the house</p><p>{x}</p><p>All rights kept</p>"
    rows = [(1, "http://q.x/article?id=1", page("one")), (2, "http://q.x/article?id=2", page("two")), (3, "http://q.x/article?id=3", page("three")), (4, "http://q.x/article?id=4", page("three")), (5, "http://q.x/article?id=2", None), (6, "http://v.x/a", page("old")), (7, "http://v.x/a", page("new"))]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Menu of the house\n{}\nAll rights kept"
    assert got == {1: "one", 2: "two", 3: "three", 4: "three", 5: "", 6: whole.format("old"), 7: whole.format("new")}


def test_tags_against_a_plain_pattern():
    """On pages whose quotes are closed the scan finds what one regular expression finds."""
    plain = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
    r = random.Random(7)
    parts = ["<p>", "</p>", "<div class='a > b'>", '<a href="x<y>">', "text", " < ", "<3", "<!-- <p> -->", "<script>if (a<b) '</p>'</script>", "<STYLE>x</style >", "<!doctype html>", "<br/>", "&lt;", "<title>t</title>", "</", "\n"]
    for _ in range(400):
        html = "".join(r.choice(parts) for _ in range(r.randint(0, 15))) + "<p>"
        want = [(m.start(), m.end(), " " if m[1] else (m[3] or "").lower(), bool(m[2]), m[4] or "") for m in plain.finditer(html)]
        assert list(pages.tags(html)) == want, html


def test_names_of_an_article():
    """Inside the main element only whole names count, outside also the parts of hyphened ones; formulas are text."""
    inside = "".join(f"<div class='{c}'>{c}</div>" for c in ("social-history", "share-price", "menu-of-the-day", "share", "ad"))
    html = f"<div class='site-header'>h</div><article>{inside}<p id=search-theory>t <math><mi>x</mi></math></p></article><div class='cookie-notice'>c</div>"
    assert [t for t, k in pages.page_lines(html) if k == pages.MAIN] == ["social-history", "share-price", "menu-of-the-day", "t", "x"]
    assert {t for t, k in pages.page_lines(html) if k == pages.AROUND} == {"h", "share", "ad", "c"}
    assert pages.page_lines('<p>a</p><a href="x>b</a><p>c</p>') == [("a", pages.FREE), ("b", pages.FREE), ("c", pages.FREE)]


def test_odd_pages_take_linear_time():
    began = time.time()
    for piece in ('<a "', "<a x='", '<a">"', "<", "<!", "</", "<div>", "<b>", "</p>", "<!--", "<script>", '<p class="', "<div class='ad'>"):
        pages.page_lines(piece * (1_000_000 // len(piece)))
    pages.page_lines("<div>" * 100_000 + "</p>" * 100_000 + "<b>" * 100_000 + "</i>" * 100_000)
    assert time.time() - began < 60


def test_pages_empty(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.main_text(d).count() == 0


# 10: URLs


def test_urls_against_sql(same):
    same(urls, "op10_url_filter")


def test_aliases(spark):
    link = lambda u: f'<head><link href="{u}" rel="canonical"></head>'
    rows = [(1, "http://a.org/1", link("http://example.com/en/9")), (2, "http://b.org/2", link("http://a.org/1#x")), (3, "http://c.org/3", '<meta http-equiv="refresh" content="0; url=/4">'), (4, "http://c.org/4", link("//b.org/2")), (5, "http://d.org/5", None), (6, "http://e.org/6", link("http://www.example.com/en/1")), (7, "http://e.org/6", link("http://x.net/es/1")), (8, None, "x"), (9, "no url", "")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), urls.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    more = spark.createDataFrame([("http://d.org/5", "http://q.net/fr/1"), (None, "http://x")], "from_url string, to_url string")
    got = {r.page_id: (r.verdict, r.via) for r in urls.judge_urls(spark.createDataFrame(rows[4:5], "page_id long, url string, html string"), urls.RULES, redirects=more).collect()}
    assert got == {5: ("block", "alias")}


def test_links_are_resolved(spark):
    cases = [("http://a.org/x/y/z", "../w", "http://a.org/x/w"), ("http://a.org/x/y", "./w", "http://a.org/x/w"), ("http://a.org/x", "../../w?a=../b", "http://a.org/w?a=../b"), ("http://a.org", "w", "http://a.org/w"), ("https://a.org/x", "//B.org/q/..", "https://B.org/"), ("http://a.org/x?q", "?r", "http://a.org/x?r"),
             ("http://a.org/x", "/y/./z", "http://a.org/y/z"), ("http://a.org/x", "http://b.org/a..b/c.", "http://b.org/a..b/c."), ("http://a.org/x", "#top", None), ("http://a.org/x", "", None), ("http://a.org/x", None, None)]
    d = spark.createDataFrame([(i, u, k) for i, (u, k, _) in enumerate(cases)], "i int, url string, link string")
    got = {r.i: r.a for r in urls.resolved(d, "link", "url", "a").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    blocked = '<link rel="canonical" href="http://x.net/es/1">'
    rows = [(1, "http://a.org/1", f"<!-- {blocked} -->"), (2, "http://a.org/2", f"<script>{blocked}</script >"), (3, "http://a.org/3", f"<!-- {blocked}"), (4, "http://a.org/4", '<base href="http://x.net/es/a/"><link rel="canonical" href="../b">'), (5, "http://a.org/5", f"<!-- x -->{blocked}"), (5, "http://a.org/5", f"<!-- x -->{blocked}"), (6, "http://a.org/" + "z" * 1_000_000, blocked), (None, "http://a.org/5", None)]
    d = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = sorted((r.page_id or 0, r.verdict) for r in urls.judge_urls(d, urls.RULES).collect())
    assert got == [(0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "block"), (5, "block"), (5, "block"), (6, "block")]
    assert urls.judge_urls(d.where("false"), urls.RULES).count() == 0


# the pipeline


def test_pipeline_against_its_parts(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = documents(spark, sf), []
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf))
        seen.append((docs.columns, docs.select("doc_id").distinct().count()))
    assert all(c == documents(spark, sf).columns for c, _ in seen[:-1]) and seen[-1][0][-1] == "copy"
    assert [n for _, n in seen] == sorted((n for _, n in seen), reverse=True) and seen[-1][1] > 0
    items = {r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert not any(i in r.text for r in docs.collect() for i in items)


def test_pipeline_odd(spark, odd, none, sf):
    """Nulls, empty, blank, repeated and very long texts, clashing columns and no rows pass through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd.withColumnRenamed("n", "copies").withColumn("copy", F.lit(3)), none):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
        got = pipeline.mixing_stage(spark, docs, sf)
        assert got.columns == [*docs.columns, "copy_" if "copy" in docs.columns else "copy"]
        rows = got.collect()
        assert all(r.text for r in rows) and bool(rows) == (not docs.isEmpty())


def test_mixing_repeated_rows(spark, sf):
    """Rows that come three times over, and rows without an id, are taken as often as the mix says."""
    pipeline = pytest.importorskip("corpus_pipeline")
    d = documents(spark, sf)
    d = d.unionByName(d).unionByName(d).unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    got = pipeline.mixing_stage(spark, d, sf)
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    want = 1.5 * d.agg(F.sum(size)).first()[0]
    assert abs(got.agg(F.sum(size)).first()[0] / want - 1) < 0.05
