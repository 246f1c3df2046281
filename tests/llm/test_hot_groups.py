import random
from fractions import Fraction
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from basinspark.llm import jaccard


def test_common_passage_is_not_compared_by_the_square(spark, monkeypatch):
    """Texts with one passage in common, else unlike: of the pairs only those that share something rare are compared."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    texts = {i: passage + words(40) for i in range(300)}
    for i in range(20):  # near copies of some
        own = texts[i].copy()
        own[70] = "changed"
        texts[1000 + i] = own
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    seen, plain = [], jaccard.compared_in_blocks
    monkeypatch.setattr(jaccard, "compared_in_blocks", lambda mixed, *a: seen.append(mixed.agg(F.max("size")).first()[0] or 0) or plain(mixed, *a))
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.jaccard_components(docs, words=5, similarity="4/5").collect()}
    assert got == {i: (i % 1000, int(i % 1000 < 20)) for i in texts}
    assert seen and max(seen) <= jaccard.LOCAL


def test_rare_features_keep_every_similar_pair(spark):
    r, t = np.random.default_rng(5), Fraction(4, 5)
    sets = []
    for _ in range(40):
        base = r.choice(400, int(r.integers(1, 60)), replace=False)
        for _ in range(3):
            kept = base[r.random(len(base)) < 0.93]
            sets.append(np.unique(np.concatenate([kept if len(kept) else base, r.integers(0, 400, int(r.integers(0, 4)))])).astype(np.int64))
    items = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "digest long, items binary")
    by = {}
    for x in jaccard.rare_features(items.select("digest"), items, t).collect():
        by.setdefault(x.digest, set()).add(x.sig)
    similar = [(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert len(similar) > 20
    assert all(by.get(i, set()) & by.get(j, set()) for i, j in similar)
