"""N-gram Jaccard self-join by PartEnum signatures."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_broadcast, chunks, dropped, mix, packed_reduce, shard_of, stored, table, unpack_columns
from .components import components

RECORD = np.dtype([("low", "u4"), ("digest", "u8")])
DEALT = np.dtype([("sig", "u8"), ("digest", "u8")])
SECOND = 3  # second-level parts of a first-level part; every two of them make a signature
FAMILIES = 3  # independent partitions of the domain that sets with too many empty signatures go through
LOCAL = 64  # a task's sets of one signature that meet in one place, more are dealt out; sets of one signature that are all compared
BLOCK = 512  # sets of one signature that are compared at once with as many
LEAST = 32  # of a set's signatures that it takes along to see at which of them a pair meets first


def size_bands(t: Fraction, most: int) -> list[int]:
    """Band edges: band i holds the sizes from edge i to before edge i + 1; sets of similarity t lie in one band or adjacent ones."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(int(edges[-1] / t) + 1)
    return edges


@functools.cache
def band_plan(t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, first-level parts, spare parts) by band, for sets of that band and the next; 0 parts where only equal sets are similar.

    Such sets differ in at most k features, so that at most k / 2 first-level parts differ in two or more; k // 2 + 1 +
    spare parts leave 1 + spare that differ in one at most, which two of the part's three second-level parts
    don't hold. spare is what a set is expected to have of parts with an empty signature, and two deviations more.
    """
    edges = size_bands(t, 1 << 40)
    parts, spares = [], []
    for low in range(len(edges) - 2):
        widest = min(2 * (edges[low + 2] - 1), int((edges[low + 1] - 1) * (1 + 1 / t)))
        k, spare = int(widest * (1 - t) / (1 + t)), 0
        if k:
            for _ in range(4):
                cells = SECOND * (k // 2 + 1 + spare)
                empty = cells * (1 - (SECOND - 1) / cells) ** edges[low]
                spare = int(np.ceil(empty + 2 * np.sqrt(empty))) if empty >= 0.05 else 0
        parts.append(k // 2 + 1 + spare if k else 0)
        spares.append(spare)
    return np.array(edges), np.array([*parts, 0]), np.array([*spares, 0])


def digests(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit name of each set; 0 is the empty set's. s: the sets' shingles end to end, n: how many each has."""
    out, full = np.zeros(len(n), np.uint64), n > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(s + np.uint64(77)), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64)) | np.uint64(1)
    return out


def signatures(s: np.ndarray, n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, given end to end: PartEnum of each set's band with the next and of the band before with its own.

    The feature domain is dealt by hash into first-level parts and these into SECOND second-level parts. A signature
    is what a set has in all second-level parts of one first-level part but one. Two sets of similarity t have 1 + spare
    first-level parts in which they agree on a signature. Signatures of no features are left out, as all
    sets that lack them would meet: a set with `spare` such parts or fewer still agrees with its partner on another. Sets
    with more, which cannot count on that, go through another partition of the domain as well, the last of which leaves nothing out.
    """
    edges, parts, spares = band_plan(t)
    band = np.searchsorted(edges, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    got_set, got_sig = [], []
    for shift in (0, 1):
        low = np.maximum(band - shift, 0)
        live = (n > 0) & (band >= shift) & (parts[low] > 0)
        for family in range(FAMILIES):
            ids = np.flatnonzero(live)
            if not len(ids):
                break
            n1 = parts[low[ids]]
            place = np.full(len(n), -1)
            place[ids] = np.arange(len(ids))
            base = SECOND * (np.cumsum(n1) - n1)
            of = place[owner]
            own = of >= 0
            of, x = of[own], s[own]
            h = mix(x ^ mix(low[ids].astype(np.uint64) * np.uint64(FAMILIES) + np.uint64(family + 1))[of])
            cell = base[of] + (((h >> np.uint64(32)) * (SECOND * n1).astype(np.uint64)[of]) >> np.uint64(32)).astype(np.int64)
            sums, count = np.zeros(SECOND * int(n1.sum()), np.uint64), np.bincount(cell, minlength=SECOND * int(n1.sum()))
            np.add.at(sums, cell, mix(h))
            sums, count = sums.reshape(-1, SECOND), count.reshape(-1, SECOND)
            rest, left = sums.sum(1, keepdims=True) - sums, count.sum(1, keepdims=True) - count
            whose = np.repeat(np.arange(len(ids)), n1)
            number = (np.arange(len(whose)) - (base // SECOND)[whose]).astype(np.uint64)
            kind = (low[ids].astype(np.uint64) * np.uint64(FAMILIES) + np.uint64(family))[whose]
            sig = mix(mix(rest) + ((kind << np.uint64(40)) + number * np.uint64(SECOND))[:, None] + np.arange(SECOND, dtype=np.uint64))
            thin = np.bincount(whose[(left == 0).any(1)], minlength=len(ids)) > spares[low[ids]]
            take = left > 0 if family < FAMILIES - 1 else np.ones_like(left, bool)
            got_set.append(np.broadcast_to(ids[whose][:, None], take.shape)[take])
            got_sig.append(sig[take])
            live = np.zeros(len(n), bool)
            live[ids[thin]] = True
    return (np.concatenate(got_set), np.concatenate(got_sig)) if got_set else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sketches(s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set about four times as many bits as it has features, a power of two: each feature turns over the bit of its hash.

    Two sets differ in at least as many features as their sketches in bits; the longer sketch folds onto the shorter.
    """
    bits = 64 << np.maximum(0, np.round(np.log2(np.maximum(n, 16) / 16))).astype(np.int64)
    base = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(n)), n)
    at = base[owner] + (mix(s ^ np.uint64(0x5EED)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(base.tolist(), bits.tolist(), strict=True)]


def folded(sketch: list[bytes], length: int) -> np.ndarray:
    """Sketches of `length` bytes or more as rows of 64-bit numbers, folded to that length."""
    out = np.empty((len(sketch), length // 8), np.uint64)
    for size in {len(x) for x in sketch}:
        at = [i for i, x in enumerate(sketch) if len(x) == size]
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketch[i] for i in at), np.uint64).reshape(len(at), size // length, length // 8), axis=1)
    return out


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, t: Fraction) -> np.ndarray:
    """Can sets of n and m features that differ in `differ` or more be of similarity t?"""
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (small * t.denominator >= large * t.numerator) & ((n + m) * (t.denominator - t.numerator) >= differ * (t.denominator + t.numerator))


def shingle_sets(docs: DataFrame, k: int, extra: str = "") -> DataFrame:
    """(id, at, n, digest, sketch) of each row, or with `extra` (digest, items): the sorted 64-bit shingles as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in chunks(batches):
            sets = Words(b.column("text")).shingles(k)
            n = np.array([len(s) for s in sets], np.int64)
            s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            digest = pa.array(digests(s, n).view(np.int64))
            if extra:
                yield pa.RecordBatch.from_pydict({"digest": digest, "items": pa.array([x.tobytes() for x in sets], pa.binary())})
            else:
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "at": b.column("at"), "n": pa.array(n), "digest": digest, "sketch": pa.array(sketches(s, n), pa.binary())})

    return docs.mapInArrow(run, "digest long, items binary" if extra else f"id {kind}, at long, n long, digest long, sketch binary")


def shared_signatures(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(sig, digest) of every signature that two different sets or more have.

    Signatures travel packed and meet by their value: a shard takes a range of their 64 bits and knows them apart by 32
    more, so that a chance hit, which verification turns down, stays as rare at any size. A task that alone has more than LOCAL
    sets of one signature deals the others out, each lot with the first set, so that no place gathers a hot signature.
    """
    shards = max(16, 2 * docs.rdd.getNumPartitions())

    def pack(batches):
        held, n = [], 0

        def flush():
            sig, digest = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            home = shard_of(sig, shards)
            sig = home.astype(np.uint64) << np.uint64(32) | mix(sig) & np.uint64(0xFFFFFFFF)
            order = np.lexsort((digest, sig))
            sig, digest = sig[order], digest[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (digest[1:] != digest[:-1])
            sig, digest = sig[new], digest[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            lot = (np.arange(len(sig)) - start) // LOCAL
            more = lot > 0
            r = np.empty(int((~more).sum()), RECORD)
            r["low"], r["digest"] = (sig[~more] & np.uint64(0xFFFFFFFF)).astype(np.uint32), digest[~more]
            yield (sig[~more] >> np.uint64(32)).astype(np.int32), r
            if more.any():
                heads = np.flatnonzero(more & ((np.arange(len(sig)) - start) % LOCAL == 0))
                d = np.empty(int(more.sum()) + len(heads), DEALT)
                d["sig"], d["digest"] = np.concatenate([sig[more], sig[heads]]), np.concatenate([digest[more], digest[start[heads]]])
                to = shard_of(mix(d["sig"] * np.uint64(3) + np.concatenate([lot[more], lot[heads]]).astype(np.uint64)), shards)
                yield to + shards, d

        for b in chunks(batches):
            sets = Words(b.column("text")).shingles(k)
            size = np.array([len(s) for s in sets], np.int64)
            s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            whose, sig = signatures(s, size, t)
            held.append((sig, digests(s, size)[whose]))
            n += len(sig)
            if n > 2_000_000:
                n = 0
                yield from flush()
        if held:
            yield from flush()

    def merge(shard, blobs):
        if shard >= shards:
            r = unpack_columns(blobs, DEALT)
        else:
            short = unpack_columns(blobs, RECORD)
            r = np.empty(len(short), DEALT)
            r["sig"], r["digest"] = short["low"].astype(np.uint64) | np.uint64(shard << 32), short["digest"]
        r = r[np.lexsort((r["digest"], r["sig"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["sig"][1:] != r["sig"][:-1]) | (r["digest"][1:] != r["digest"][:-1])
        r = r[new]
        same = r["sig"][1:] == r["sig"][:-1]
        keep = np.zeros(len(r), bool)
        keep[1:] |= same
        keep[:-1] |= same
        yield pa.RecordBatch.from_pydict({"sig": pa.array(r["sig"][keep].view(np.int64)), "digest": pa.array(r["digest"][keep].view(np.int64))})

    return packed_reduce(docs.select("text"), pack, merge, "sig long, digest long", shards, 2 * shards)


def screened(pairs: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""

    def run(batches):
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            ok = np.zeros(b.num_rows, bool)
            shape = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
            for p, q in np.unique(shape, axis=0).tolist():
                at = np.flatnonzero((shape == (p, q)).all(1))
                u, v = (folded([z[i] for i in at], min(p, q)) for z in (x, y))
                ok[at] = may_link(n[at], m[at], np.bitwise_count(u ^ v).sum(1, dtype=np.int64), t)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    x = info.select(F.col("digest").alias("a"), F.col("n"), F.col("sketch").alias("x"))
    y = info.select(F.col("digest").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, items: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of set names whose Jaccard similarity is t or more, exactly."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                piece, ok = b.slice(i, 64), []
                for p, q in zip(piece.column("x"), piece.column("y"), strict=True):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    ok.append(t.denominator * both >= t.numerator * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = items.select(F.col("digest").alias("a"), F.col("items").alias("x"))
    y = items.select(F.col("digest").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys out of batches that are sorted by them."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cut = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(cut, cut[1:], strict=False):
            yield rows.slice(i, j - i)
        held = rows.slice(cut[-1])
    if held is not None:
        yield held


def compared_in_blocks(mixed: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) of all sets of one signature that belong to different components and whose sketches allow a link.

    mixed: (sig, digest, comp, main, size, odd), where main is the signature's most frequent component, size its sets and
    odd those outside main. The odd ones are dealt into blocks, all are dealt into blocks, and every two blocks are
    compared inside one task: only what passes is a row. Similar sets share many signatures: a pair is left to the least
    of them, as far as the LEAST least ones of both tell.
    """
    first = mixed.groupBy("digest").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LEAST).alias("first"))
    own = info.select("digest", "n", "sketch").join(first, "digest")
    d = mixed.withColumn("rows", F.ceil(F.col("odd") / BLOCK)).withColumn("cols", F.ceil(F.col("size") / BLOCK)).join(own, "digest")
    keep = ["digest", "comp", "n", "sketch", "first"]
    odd = d.where("comp <> main").select("sig", F.pmod(F.xxhash64("digest"), "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"), *keep)
    every = d.select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("digest", F.lit(7)), "cols").alias("j"), F.lit(1).alias("side"), *keep)

    def run(batches):
        for g in groups(batches, ["sig", "i", "j"]):
            side, digest, comp, n = (g.column(c).to_numpy() for c in ("side", "digest", "comp", "n"))
            x = g.column("sketch").to_pylist()
            x, sig, first = folded(x, min(map(len, x))), g.column("sig")[0].as_py(), g.column("first")
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            y, a, b, less = x[two], [], [], {}

            def before(i):
                if i not in less:
                    less[i] = {v for v in first[i].as_py() if v < sig}
                return less[i]

            for i in one.tolist():
                ok = two[may_link(n[two], n[i], np.bitwise_count(y ^ x[i]).sum(1, dtype=np.int64), t) & (comp[two] != comp[i])]
                ok = [j for j in ok.tolist() if before(i).isdisjoint(before(j))]
                b.append(digest[ok])
                a.append(np.full(len(ok), digest[i]))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    cells = odd.unionByName(every).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return cells.mapInArrow(run, "a long, b long").distinct()


def rare_features(sets: DataFrame, items: DataFrame, t: Fraction) -> DataFrame:
    """(sig, digest) of features of the sets (column digest), such that two of them of similarity t share one.

    The features are put in one order, those of few of these sets first. Two similar sets share one among the first
    n - ceil(2t / (1 + t) n) + 1 of the smaller and the first n - ceil(t n) + 1 of the larger. So sets that have a
    passage in common and are else unlike do not meet in it. Features that one set alone has are counted, not listed.
    """
    p, q = t.numerator, t.denominator

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                piece = b.slice(i, 64)
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in piece.column("items")]
                n = np.array([len(x) for x in own])
                yield pa.RecordBatch.from_pydict({"sig": pa.array(np.concatenate(own)), "digest": pa.array(np.repeat(piece.column("digest").to_numpy(), n)), "n": pa.array(np.repeat(n, n))})

    each = stored(items.join(sets, "digest", "left_semi").mapInArrow(run, "sig long, digest long, n long"))
    shared = each.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    own = each.join(shared, "sig").groupBy("digest", "n").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("f"))
    own = own.withColumn("alone", F.col("n") - F.size("f")).withColumn("most", F.expr(f"n - (n * {p} + {q - 1}) div {q} + 1 - alone")).where("most > 0")
    took = own.select("digest", "n", "alone", F.posexplode(F.slice("f", 1, F.col("most").cast("int"))).alias("i", "f"))
    took = stored(took.select("f.sig", "digest", F.expr(f"alone + i <= n - (n * {2 * p} + {p + q - 1}) div {p + q}").alias("least")))
    dropped(each)
    kept = took.groupBy("sig").agg(F.count("*").alias("c"), F.max("least").alias("least")).where("c > 1 AND least").select("sig")
    return took.join(kept, "sig").select("sig", "digest")


def mixed_signatures(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(sig, digest, comp, main, size, odd, pivot) of the signatures that sets of different components have. The pivot is of another component than main."""
    now = members.withColumn("comp", F.col("digest")) if labels is None else members.join(labels, "digest")
    by = now.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.min("digest").alias("least"))
    of = by.groupBy("sig").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.min(F.struct(F.xxhash64("least", F.lit(turn)).alias("h"), "least", "comp")).alias("p1"), F.max(F.struct(F.xxhash64("least", F.lit(turn)).alias("h"), "least", "comp")).alias("p2"))
    pick = F.when(F.col("p1.comp") != F.col("top.comp"), F.col("p1.least")).otherwise(F.col("p2.least"))
    of = of.where("comps > 1").select("sig", F.col("top.comp").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("odd"), pick.alias("pivot"))
    return now.join(of, "sig")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: str = "4/5") -> DataFrame:
    """id, n_shingles, component_id, n_links of every row: which texts reach each other by links of that similarity.

    A text's set is its distinct `words`-word shingles, case folded; a shorter text is one shingle; a text
    without words, or null, is linked with nothing and its own component. Equal sets are one class; classes that share
    a signature are candidates. A signature's classes are first compared with one of them, the pivot; while that joins
    most of what is still apart, another pivot of another component follows; in the end all classes of a signature that are
    still in different components are compared in blocks, those of signatures of more than LOCAL sets only where they also share
    one of their rare features. So no link between components is missed and none
    inside a component is looked for. Sketches turn pairs down before the sets themselves are compared. n_links counts the
    links found, copies included as one. component_id is the least id that is not null; a row whose id is
    null has the component of its text's links, null if there are none. A repeated id is one document for each of its rows: each row
    has the component of its own text. Repeated rows stay. Other columns are not read.
    """
    t = Fraction(similarity)
    # where a text of a set is found again; the digest decides if others come along
    at = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.lit(0))).otherwise(F.xxhash64(F.col(text_col), F.lit(1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), at.alias("at"))
    sets = stored(shingle_sets(rows, words))
    members = stored(shared_signatures(rows, words, t).distinct())
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    links = labels = None
    if not members.isEmpty():
        names = stored(members.select("digest").distinct())
        n_names = names.count()
        info = stored(sets.where("n > 0").join(bounded_broadcast(names, n_names), "digest", "left_semi").groupBy("digest").agg(F.min("at").alias("at"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
        texts = rows.join(bounded_broadcast(info.select("at"), n_names), "at", "left_semi")
        items = stored(shingle_sets(texts, words, "items").join(bounded_broadcast(names, n_names), "digest", "left_semi").dropDuplicates(["digest"]))
        last, turn = None, 0
        while True:
            mixed = stored(mixed_signatures(members, labels, turn))
            left = mixed.count()
            blocks = last is not None and left > 0.6 * last
            if not left:
                break
            if blocks:
                hot = stored(mixed.where(F.col("size") > LOCAL).select("digest").distinct())
                if not hot.isEmpty():
                    finer, coarse = mixed.where(F.col("size") <= LOCAL).select("sig", "digest").unionByName(rare_features(hot, items, t)), mixed
                    mixed = stored(mixed_signatures(finer, labels, turn))
                    dropped(coarse)
                pairs = compared_in_blocks(mixed, info, t)
            else:
                pairs = mixed.where("digest <> pivot").join(mixed.select("sig", F.col("digest").alias("pivot"), F.col("comp").alias("other")), ["sig", "pivot"]).where("comp <> other")
                pairs = screened(pairs.select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b")).distinct(), info, t)
            new = stored(verified(pairs, items, t))
            links = new if links is None else links.unionByName(new)
            dropped(mixed)
            if labels is None:
                joined, before = components(new), None
                labels = stored(names.join(joined.select(F.col("node").alias("digest"), "component"), "digest", "left").select("digest", F.coalesce("component", "digest").alias("comp")))
            else:
                ends = new.join(labels.select(F.col("digest").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("digest").alias("b"), F.col("comp").alias("y")), "b")
                joined, before = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), labels
                labels = stored(labels.join(joined.select(F.col("node").alias("comp"), "component"), "comp", "left").select("digest", F.coalesce("component", "comp").alias("comp")))
                dropped(before)
            if blocks:
                break
            last, turn = left, turn + 1
        dropped(members, info, items)
        links = links.distinct()
    if links is None:
        by_class = classes.select("digest", F.col("rep").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    else:
        ends = links.selectExpr("a AS digest").unionByName(links.selectExpr("b AS digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
        by_class = classes.join(labels, "digest", "left").join(ends, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
        least = by_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
        by_class = by_class.join(least, "comp").select("digest", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = sets.select("id", "n", "digest").join(by_class, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, similarity="17/20")


# Links by all shared shingles, then the least id within reach of each document.
ORACLE_SQL = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT n.doc_id, n.n AS n_shingles, CAST(least(n.doc_id, coalesce(min(r.other), n.doc_id)) AS BIGINT) AS component_id FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
""",
}
QUERIES = {"op5_jaccard_join": lambda spark, sf_dir: op5_jaccard_join(spark, sf_dir).drop("n_links")}
