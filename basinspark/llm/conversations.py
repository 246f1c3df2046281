"""Repair of conversations: what is wrong with their turns, and the cheapest edits that make their roles alternate.

Roles are right when their initials read `(s?(ua)+)?`. Each turn is kept, given another role or deleted, and empty
turns may be inserted; the edits of least cost are found by branch and bound, among equals those whose initials
(D, I, K, R) come first in ASCII. As edits of equal cost never begin each other (what would be left of the longer one
are insertions, which cost), the least edits of two stretches that meet in a state are the least of both together.
So a conversation of any length is cut into stretches of bounded length, each solved for every pair of states at its
ends, and the results are combined in a tree.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import renumber
from .common import stored, table

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3  # for each truncated turn that is not deleted
OPEN, ASKED, ANSWERED, AFTER_SYSTEM = 0, 2, 3, 1  # nothing yet; last came u; last came a; last came s
NEXT = {(OPEN, "s"): AFTER_SYSTEM, (OPEN, "u"): ASKED, (AFTER_SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
RIGHT, PAIRS = (OPEN, ANSWERED), ("su", "ua", "au")
FILL = {OPEN: ASKED, AFTER_SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}  # where a user's or assistant's turn leads
BLANKS = " \t\n\x0b\f\r"
STRETCH, FAN = 48, 32  # turns solved at once, stretches combined at once


def search(turns: list[tuple[str, str, int]], first: int, last: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from state `first` over all turns to one of the states `last`; None if none does.

    turns: (initial, fault, copies), the fault "", "t" (truncated) or "d" (to be deleted, all copies). Depth first
    with a stack of its own. A node (turns done, state) is left when what it has cost and the least that each
    further turn costs in any state exceed the incumbent, or when it was reached before by edits not worse.
    """
    n = len(turns)
    rest = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        initial, fault, copies = turns[k]
        keep = (0 if initial in ("s", "u", "a") else COST["R"]) + (TRUNCATED if fault == "t" else 0)
        rest[k] = rest[k + 1] + (COST["D"] * copies if fault == "d" else min(COST["D"], keep))
    best, seen, stack = None, {}, [(0, first, 0, "")]
    while stack:
        k, state, cost, audit = stack.pop()
        if best is not None and cost + rest[k] > best[0]:
            continue
        was = seen.get((k, state))
        if was is not None and was <= (cost, audit):
            continue
        seen[k, state] = (cost, audit)
        if k == n and state in last and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [(k, FILL[state], cost + COST["I"], audit + "I")]
        if k < n:
            initial, fault, copies = turns[k]
            more = TRUNCATED if fault == "t" else 0
            steps.append((k + 1, state, cost + COST["D"] * copies, audit + "D" * copies))
            if fault != "d":
                steps.append((k + 1, FILL[state], cost + COST["R"] + more, audit + "R"))
                if (state, initial) in NEXT:
                    steps.append((k + 1, NEXT[state, initial], cost + more, audit + "K"))
        # the cheapest is looked into first, of equal ones the first in ASCII
        stack.extend(sorted(steps, key=lambda s: (s[2] + rest[s[0]], s[3]), reverse=True))
    return best


@functools.lru_cache(1 << 14)
def stretch(turns: tuple[tuple[str, str, int], ...]) -> list[tuple[int, int, int, str]]:
    """(first state, last state, cost, audit) of a stretch, for all pairs of states that edits lead between."""
    found = ((a, b, search(turns, a, (b,))) for a in range(4) for b in range(4))
    return [(a, b, *got) for a, b, got in found if got is not None]


def combine(left: list[tuple[int, int, int, str]], right: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The same for two stretches one after the other."""
    best: dict = {}
    for a, m, c, x in left:
        for m2, b, d, y in right:
            if m == m2 and ((a, b) not in best or (c + d, x + y) < best[a, b]):
                best[a, b] = (c + d, x + y)
    return [(a, b, *got) for (a, b), got in best.items()]


def _columns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), *(F.coalesce(f"`{c}`", F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))


def faults(turns: DataFrame) -> DataFrame:
    """conv, turn, role, dig, initial, fault (b blank, r repeated, t truncated or nothing), copies: one row for equal rows of a turn, without texts.

    Of equal rows of one turn only the first can be other than repeated. A role and text that an earlier turn has is
    found from the least turn of each repeated pair, aggregated before it is joined.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", "b").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    rows = turns.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("dig"), fault.alias("own")).groupBy("conv", "turn", "role", "dig", "own").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.groupBy("conv", "role", "dig").agg(F.min(rank).alias("least"), F.count("*").alias("n")).where("n > 1")
    r, a = rows.alias("r"), again.alias("a")
    repeated = F.expr("a.least IS NOT NULL AND NOT (r.turn <=> a.least.turn)")
    fault = F.when(F.col("own") == "b", "b").when(repeated, "r").otherwise(F.col("own"))
    return r.join(a, F.expr("r.conv <=> a.conv AND r.role = a.role AND r.dig = a.dig"), "left").select("r.conv", "r.turn", "r.role", "r.dig", F.substring("r.role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


def _solve(rows: list[dict]) -> dict:
    """What a stretch of turns in order comes to: its counts, what it begins and ends with, and its cheapest edits."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"low": None, "high": None, "head": rows[0]["initial"], "tail": None}
    turns = []
    for r in rows:
        initial, fault, copies = r["initial"], r["fault"], r["copies"]
        if fault in ("b", "r"):
            out["blank" if fault == "b" else "duplicate"] += copies
            turns.append((initial, "d", copies))
        else:
            out["truncated"] += fault == "t"
            turns.append((initial, fault, 1))
            if copies > 1:
                out["duplicate"] += copies - 1
                turns.append((initial, "d", copies - 1))
        out["illegal"] += copies - 1 + (out["tail"] is not None and out["tail"] + initial not in PAIRS)
        out["tail"] = initial
        if r["turn"] is not None:
            out["turns"] += r["turn"] != out["high"]
            out["low"] = r["turn"] if out["low"] is None else out["low"]
            out["high"] = r["turn"]
    return out | {"moves": stretch(tuple(turns))}


def _meet(x: dict, y: dict) -> dict:
    """Two stretches, one after the other, as one."""
    out = {k: x[k] + y[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += x["tail"] + y["head"] not in PAIRS
    out["turns"] -= x["high"] is not None and x["high"] == y["low"]
    either = lambda a, b: b if a is None else a
    return out | {"low": either(x["low"], y["low"]), "high": either(y["high"], x["high"]), "head": x["head"], "tail": y["tail"], "moves": combine(x["moves"], y["moves"])}


def _join(stretches: list[dict]) -> dict:
    """Stretches in order, read from rows, as one."""
    return functools.reduce(_meet, ({**r, "moves": [tuple(m.values()) for m in r["moves"]]} for r in stretches))


def _packed(groups: DataFrame, one, turn: str) -> DataFrame:
    """One result of stretches for each row (conv, at, rows)."""
    fields = f"blank long, duplicate long, truncated long, illegal long, turns long, low {turn}, high {turn}, head string, tail string, moves array<struct<a:int,b:int,cost:long,audit:string>>"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            got = [one(rows) for rows in b.column("rows").to_pylist()]
            for g in got:
                g["moves"] = [dict(zip(("a", "b", "cost", "audit"), m, strict=True)) for m in g["moves"]]
            kinds = {"low": b.column("rows").type.value_type.field("turn" if one is _solve else "low").type, "head": pa.string(), "tail": pa.string(), "moves": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}
            kinds["high"] = kinds["low"]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("at"), *(pa.array([g[n] for g in got], kinds.get(n, pa.int64())) for n in names)], ["conv", "at", *names])

    return groups.mapInArrow(run, f"conv {groups.schema['conv'].dataType.simpleString()}, at long, {fields}")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation in `turns`: its id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A conversation's rows are taken by turn (nulls first), then role, then the text's SHA-256. Its faults: gaps (numbers
    missing between the least and greatest turn), blank and duplicate rows (role and text came before), truncated
    ones (no `.`, `!` or `?` at the end) - the first that holds for a row counts - and illegal pairs of neighbours'
    role initials. cost and audit are those of the cheapest edits. A null role or text is one space, an empty role has
    no initial and cannot stay. Rows of a null id are one conversation; equal rows, empty and very long texts are
    rows like others; no rows, no conversations; other columns are not read. Of the texts only digests move here.
    """
    rows = faults(_columns(turns, conv, turn, role, text))
    kind = rows.schema["turn"].dataType.simpleString()
    d = renumber(rows, ["conv", "turn", "role", "dig"], "number").withColumn("at", F.floor((F.col("number") - 1) / STRETCH))
    groups = d.groupBy("conv", "at").agg(F.sort_array(F.collect_list(F.struct("number", "turn", "initial", "fault", "copies"))).alias("rows"))
    begin = stored(_packed(groups, _solve, kind))
    low = begin.groupBy("conv").agg(F.min("at").alias("zero"), F.max("at").alias("end"))
    most = low.agg(F.max(F.col("end") - F.col("zero"))).first()[0] or 0
    x, y = begin.alias("x"), low.where("end > zero").alias("y")
    part = x.join(y, F.expr("x.conv <=> y.conv"), "left").select(*(f"x.{c}" for c in begin.columns if c != "at"), F.coalesce(F.expr("x.at - y.zero"), F.lit(0)).alias("at"))
    while most > 0:
        inner = F.struct("at", *(c for c in begin.columns if c not in ("conv", "at")))
        groups = part.groupBy("conv", F.floor(F.col("at") / FAN).alias("at")).agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("o"), inner.alias("v")))).alias("sorted")).select("conv", "at", F.transform("sorted", lambda s: s["v"]).alias("rows"))
        part, most = _packed(groups, _join, kind), most // FAN
        part = stored(part)
    ends = F.expr(f"filter(moves, m -> m.a = {OPEN} AND m.b IN {RIGHT})")
    best = F.array_min(F.transform(ends, lambda m: F.struct(m["cost"].alias("cost"), m["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return part.select(F.col("conv").alias(conv), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversation, position (0, 1, ...), role and text of every turn that the repairs' audits leave or put in.

    Texts move once, to their conversation; there they are read in order, one batch at a time, beside the audit, so
    that a conversation of any length takes bounded memory. The rows of one conversation stand in order in one partition.
    """
    t = _columns(turns, conv, turn, role, text)
    rows = t.select("conv", F.lit(1).alias("step"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("dig"), "text")
    plan = repairs.select(F.col(f"`{conv}`").alias("conv"), F.lit(0).alias("step"), F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("dig"), F.col("audit").alias("text"))
    both = plan.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "step", "turn", "role", "dig").select("conv", "step", "role", "text")

    def run(batches):
        audit, at, state, position, last = "", 0, OPEN, 0, None
        for b in batches:
            out: list = []

            def put(who, state, said=""):
                nonlocal position
                out.append((last, position, who, said))
                position += 1
                return state

            def fill(state):
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    state = put("assistant" if state == ASKED else "user", FILL[state])
                    at += 1
                return state

            for key, step, who, said in zip(*(b.column(c).to_pylist() for c in ("conv", "step", "role", "text")), strict=True):
                if step == 0:
                    state = fill(state)  # what the last conversation ends with
                    audit, at, state, position, last = said, 0, OPEN, 0, key
                    state = fill(state)
                    continue
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = put(who, NEXT[state, who[0]], said)
                elif edit == "R":
                    state = put("assistant" if state == ASKED else "user", FILL[state], said)
                state = fill(state)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((b.schema.field("conv").type, pa.int64(), pa.string(), pa.string()))], ["conv", "position", "role", "text"])

    return both.mapInArrow(run, f"conv {both.schema['conv'].dataType.simpleString()}, position long, role string, text string").withColumnsRenamed({"conv": conv})


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conversation and the SHA-256 of its `role:text`, joined by line ends, for what `repaired_turns` gives: read in its order, a batch at a time."""

    def run(batches):
        sha, key, kind = None, None, None
        for b in batches:
            done: list = []
            kind = b.schema.field("conv").type
            for k, position, who, said in zip(*(b.column(c).to_pylist() for c in ("conv", "position", "role", "text")), strict=True):
                if position == 0:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    sha, key = hashlib.sha256(), k
                sha.update(("\n" if position else "").encode() + f"{who}:{said}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    d = repaired.withColumnRenamed(conv, "conv")
    return d.mapInArrow(run, f"conv {d.schema['conv'].dataType.simpleString()}, sha256 string").withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a quarter of the rows dropped, emptied, cut short, repeated or given to the user, as their hash says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("h")
    d = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h).where("h <> 0")
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir):
    every = table(spark, sf_dir, "conversations")
    turns = damaged(every)
    repairs = stored(repair(turns))
    sha = digests(repaired_turns(turns, repairs))
    ids = every.select("conv_id").distinct().alias("i")
    d = ids.join(repairs.alias("r"), F.expr("i.conv_id <=> r.conv_id"), "left").join(sha.alias("s"), F.expr("i.conv_id <=> s.conv_id"), "left")
    zero = [F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("i.conv_id", *zero, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("s.sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE_SQL: dict = {}
