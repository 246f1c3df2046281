"""Repairs of conversations against a plain search over all edits."""

import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from basinspark.llm import conversations as C

RIGHT = re.compile("(s?(ua)+)?")


def plain(turns, first=C.OPEN, last=C.RIGHT):
    """Cheapest (cost, audit): Bellman-Ford over all nodes until nothing changes."""
    n = len(turns)
    best = {(0, first): (0, "")}
    changed = True
    while changed:
        changed = False
        for (k, s), (c, a) in list(best.items()):
            to = [((k, C.FILL[s]), (c + 3, a + "I"))]
            if k < n:
                i, f, m = turns[k]
                to.append(((k + 1, s), (c + 4 * m, a + "D" * m)))
                if f != "d":
                    to.append(((k + 1, C.FILL[s]), (c + 3 + 3 * (f == "t"), a + "R")))
                    if (s, i) in C.NEXT:
                        to.append(((k + 1, C.NEXT[s, i]), (c + 3 * (f == "t"), a + "K")))
            for node, value in to:
                if node not in best or value < best[node]:
                    best[node], changed = value, True
    got = [best[n, s] for s in last if (n, s) in best]
    return min(got) if got else None


def all_audits(turns, most=2):
    """Every audit with `most` insertions at a place at most, by the words of the task alone: for very short conversations."""
    out = []

    def go(k, cost, audit, roles, put):
        if put < most:
            for who in "ua":
                go(k, cost + 3, audit + "I", roles + who, put + 1)
        if k == len(turns):
            if RIGHT.fullmatch(roles):
                out.append((cost, audit))
            return
        i, f, _ = turns[k]
        more = 3 * (f == "t")
        go(k + 1, cost + 4, audit + "D", roles, 0)
        if f != "d":
            go(k + 1, cost + more, audit + "K", roles + i, 0)
            for who in "ua":
                go(k + 1, cost + 3 + more, audit + "R", roles + who, 0)

    go(0, 0, "", "", 0)
    return min(out)


TURN = st.tuples(st.sampled_from("ssuuuaaa t"), st.sampled_from(["", "", "", "t", "d"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_search_against_all_edits(turns):
    turns = [(*t, 1) for t in turns]
    assert C.search(turns, C.OPEN, C.RIGHT) == all_audits(turns)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ssuuuaaa t"), st.sampled_from(["", "", "", "t", "d"]), st.integers(1, 3)), max_size=40), st.integers(0, 40))
def test_stretches_combine(turns, cut):
    turns = [(i, f, m if f == "d" else 1) for i, f, m in turns]
    want = plain(turns)
    assert C.search(turns, C.OPEN, C.RIGHT) == want
    both = C.combine(C.stretch(tuple(turns[:cut])), C.stretch(tuple(turns[cut:])))
    assert min((c, x) for a, b, c, x in both if a == C.OPEN and b in C.RIGHT) == want


def plain_repair(rows):
    """Of one conversation's damaged rows (turn, role, text): all that the query returns, word for word."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    rows = sorted(rows, key=key)
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, turns, counts = set(), [], dict.fromkeys("brt", 0)
    for _, role, text in rows:
        last = re.findall("[^\x20\x09-\x0d]", text)
        fault = "b" if not last else "r" if (role, text) in seen else "t" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role[:1], "d" if fault in ("b", "r") else fault, 1))
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:], strict=False))
    cost, audit = plain(turns)
    left, out = iter(rows), []
    for e in audit:
        who = ["user", "assistant"][bool(out) and out[-1].startswith("u")]
        if e == "I":
            out.append(f"{who}:")
        else:
            _, role, text = next(left)
            if e != "D":
                out.append(f"{role if e == 'K' else who}:{text}")
    assert RIGHT.fullmatch("".join(o[0] for o in out))
    return gaps, counts["b"], counts["r"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    h = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
    if h == 1:
        text = ""
    elif h == 2:
        text = re.sub("[.!?]", "", text)
    elif h == 4:
        role = "user"
    return [] if h == 0 else [(turn, role, text)] * (2 if h == 3 else 1)


def check(spark, folder):
    got = C.op11_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    by = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        by[r.conv_id] += damage(r.conv_id, r.turn, r.role, r.text)
    want = {k: plain_repair(v) for k, v in by.items()}
    rows = got.collect()
    assert len(rows) == len(want) and {r.conv_id: tuple(r)[1:] for r in rows} == want
    return want


def test_query_against_brute_force(spark, sf):
    assert sum(w[5] for w in check(spark, sf).values()) > 100


def test_long_and_odd_conversations(spark, tmp_path, monkeypatch):
    """Several levels of the tree, null ids, turns, roles and texts, equal turns, repeated rows, a conversation that is dropped whole."""
    roles = ["user", "assistant", "system", "tool", "", None, "a", "u"]
    texts = ["Yes.", "no", "", " \n", None, "What?  ", "é!"]
    rows = [(c, t if t % 7 else None, roles[(t * t + c) % 8 if t % 3 == 0 else t % 2], f"{texts[t % 7] or ''}{t % 11}." if t % 4 else texts[t % 7]) for c in (1, 2) for t in range(700 // c)]
    rows += [(None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (None, 3, "assistant", "Ho.")]
    rows += [(4, 5, "user", "again.")] * 90 + [(4, 5, "assistant", "a " * 50000), (4, 9, "user", "again.")]
    lost = next(c for c in range(10, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "gone.")]
    spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(C, "STRETCH", 5)
    monkeypatch.setattr(C, "FAN", 3)
    want = check(spark, str(tmp_path))
    assert want[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_work_stays_small():
    """A hundred hostile turns are still settled in far fewer nodes than there are edits."""
    for pattern in ("s", "uu a", "aatu", "ua" * 3 + "s", " t"):
        turns = [(pattern[k % len(pattern)], ("", "t", "d")[k % 3], 1) for k in range(100)]
        assert C.search(turns, C.OPEN, C.RIGHT) == plain(turns)
