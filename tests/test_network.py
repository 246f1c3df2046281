"""Networks by doubling against plain walks."""

import random

from basinspark.operators import network as N


def table(spark, edges):
    return spark.createDataFrame(edges, "seg long, down long")


def plain_levels(edges):
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(b, set()).add(a)
    seen = {}

    def level(v):
        if v not in seen:
            seen[v] = max((level(u) + 1 for u in up.get(v, ())), default=0)
        return seen[v]

    return {v: level(v) for v in {x for e in edges for x in e}}


def test_levels_and_closure(spark):
    r = random.Random(2)
    edges = [(k, r.randrange(k)) for k in range(1, 120)] + [(k, r.randrange(k)) for k in range(5, 120, 9)]
    edges += edges[:7] + [(200, 0), (201, 201), (202, None)]
    got = {x.seg: x.level for x in N.downstream_order(table(spark, edges)).collect()}
    want = plain_levels([e for e in edges if e[1] is not None and e[1] in {a for a, _ in edges}])
    assert got == {a: want.get(a, 0) for a, _ in edges}
    outlets = spark.createDataFrame([(0,), (3,), (50,), (50,), (999,), (201,)], "seg long")
    up = {(x.outlet, x.seg) for x in N.upstream(table(spark, edges), outlets).collect()}
    want = set()
    for o in (0, 3, 50):
        todo = {o}
        while todo:
            want |= {(o, x) for x in todo}
            todo = {a for a, b in edges if b in todo and a != b and (o, a) not in want}
    assert up == want


def test_cycles_are_cut_at_their_lowest_id(spark):
    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (10, 11), (11, 12), (12, 10), (12, 13), (20, 21), (21, 22), (22, 21), (22, 23), (23, 22), (30, 30), (40, -1)]
    got = {x.seg: x.level for x in N.downstream_order(table(spark, [*edges, (5, 0), (13, 0)])).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 10: 0, 11: 1, 12: 2, 13: 3, 20: 0, 21: 1, 22: 2, 23: 3, 30: 0, 40: 0}
    place = {x.seg: x.position for x in N.positions(table(spark, [*edges, (5, 0), (13, 0)])).collect()}
    assert sorted(place.values()) == list(range(1, 16)) and {place[30], place[40]} == {1, 2}
    assert all(place[a] < place[b] for a, b in [(1, 2), (2, 3), (3, 4), (4, 5), (12, 13), (22, 23)])


def test_random_cycles_leave_an_order(spark):
    r = random.Random(8)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(50)]
    step, level = N.cut_cycles(table(spark, edges))
    left = [(x.u, x.v) for x in step.collect()]
    assert set(left) <= set(edges)
    got = {x.node: x.level for x in level.collect()}
    want = plain_levels(left)
    assert {k: v for k, v in got.items()} == want
    gone = {e for e in edges if e[0] != e[1]} - set(left)
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)

    def comes(a, b):
        seen, todo = set(), [a]
        while todo:
            for y in reach.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    assert all(comes(b, a) for a, b in gone)  # only edges of cycles go


def test_a_long_river_takes_few_rounds(spark, monkeypatch):
    calls = []
    plain = N.stored
    monkeypatch.setattr(N, "stored", lambda d: calls.append(1) or plain(d))
    e = spark.range(1, 5001).selectExpr("id AS seg", "id - 1 AS down")
    assert N.downstream_order(e).where("level <> 5000 - seg").isEmpty() and len(calls) < 35
    calls.clear()
    assert N.upstream(e, spark.range(1, 2).selectExpr("id AS seg")).count() == 5000 and len(calls) < 35


def test_no_edges(spark):
    e = table(spark, [])
    assert N.downstream_order(e).count() == N.positions(e).count() == N.upstream(e, spark.range(3).selectExpr("id AS seg")).count() == 0


def plain_upstream(edges, outlets):
    up = {}
    for a, b in edges:
        if a != b and a is not None and b is not None:
            up.setdefault(b, set()).add(a)
    there = {x for b, s in up.items() for x in (b, *s)}
    want = set()
    for o in set(outlets) & there:
        todo = [o]
        while todo:
            x = todo.pop()
            if (o, x) not in want:
                want.add((o, x))
                todo += up.get(x, ())
    return want


def test_closures_of_trees_braids_and_cycles(spark):
    r = random.Random(21)
    ids = list(range(150))
    r.shuffle(ids)
    tree = [(ids[k], ids[r.randrange(max(0, k - 3), k)]) for k in range(1, 150)]
    rings = [(a, b) for ring in ([200, 207, 201, 215], [230, 231], [240, 400, 241]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    rings += [(250, 207), (251, 250), (252, 251), (231, 260), (260, 261), (270, 400)]
    braided = [(r.randrange(60), r.randrange(60)) for _ in range(80)]
    for edges in (tree, [*tree, *rings], [*tree, *tree[:9], *((ids[9], ids[40]), (5, 5), (7, None))], braided, [*rings, (215, 252)]):
        outlets = [ids[0], ids[20], ids[21], ids[90], 207, 230, 241, 260, 261, 252, 3, 999]
        got = [(x.outlet, x.seg) for x in N.upstream(table(spark, edges), spark.createDataFrame([(o,) for o in [*outlets, 3]], "seg long"), 16).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_upstream(edges, outlets)


def test_a_closure_writes_less_than_it_gives(spark, monkeypatch):
    written, plain = [], N.stored

    def counted(d):
        out = plain(d)
        written.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", counted)
    e = spark.range(1, 20001).selectExpr("id AS seg", "id - 1 AS down")
    assert N.upstream(e, e.where("seg % 100 = 7").select("seg"), 3000).count() == sum(20001 - o for o in range(7, 20001, 100))
    assert sum(written) < 10 * 20000
