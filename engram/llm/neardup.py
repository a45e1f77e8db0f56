"""Near-duplicates by a chosen-path set similarity join over word shingles.

Documents of the same shingle set are one class, of which one row takes part. Each class has a signature of minwise
tokens. In a tree a node chooses one or two signature places at random (1 / threshold on average), and each of its
classes goes on to the child that its token at that place names; so two classes of similarity s stay together from level
to level with s / threshold nodes on average, and unlike ones part quickly. Nodes of few classes compare them all, others
branch on, and independent trees are repeated until the recall that is aimed at is reached: a pair at the threshold
itself survives four levels of one tree with probability 0.64, ten trees miss it once in 25,000.

A large node may hold a group of near copies, which no branching parts. Its consensus sketch (the majority of each bit)
tells: members near it are compared with a pivot, the member nearest to it, and the most central ones branch no further.
Once the links found so far have been joined into components, the members of a pivot's group that are outside the pivot's
component are compared with the whole group, in blocks, by bitmaps over the pivot's shingles, which bound the similarity
from above. Other comparisons are a 64-bit sketch first. Each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, broadcast_if_small, hot_lookup, slices
from engram.llm.components import components
from engram.session import materialize

PLACES, TREES, DEPTH, SMALL = 64, 10, 6, 40
#: Bits from the consensus within which a member joins a pivot's group, and within which it branches no further.
NEAR, CENTRAL = 20, 10
#: Members of a block on either side of a comparison; bits of a member's bitmap of shingles that the pivot lacks.
INSIDE, OUTSIDE, NEW_BITS = 1024, 256, 256
#: Blocks of either side that meet in one task.
GRID = 8
#: The first id that stands for a null one, beyond all integers' range, and the type that holds both.
STAND_IN, WIDE = "1" + "0" * 20, "decimal(38,0)"
_RNG = np.random.default_rng(20240501)
_ODD = _RNG.integers(1, 1 << 62, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PLACES, np.uint64)
_WORD = _RNG.integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit names of a text's distinct shingles of ``width`` words; fewer words make one shingle, none make none.

    A-Z are lower-cased; words are what spaces and the bytes 9 to 13 part.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if h.size < width:
        return _mix((h * _WORD[: h.size]).sum(keepdims=True) + np.uint64(h.size))
    n = h.size - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += _mix(h[i : i + n] * _WORD[i])
    return np.unique(_mix(total + np.uint64(width)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_name(s: np.ndarray) -> tuple[int | None, int | None]:
    """The 128-bit name of a set, as two numbers; an empty set has none."""
    if not s.size:
        return None, None
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    named = [set_name(s) for s in sets]
    return [pa.array([x[i] for x in named], pa.int64()) for i in (0, 1)]


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PLACES) minwise tokens of sets that aren't empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(s.size for s in sets[:-1])])
    out = np.empty((len(sets), PLACES), np.uint32)
    for j in range(PLACES):
        x = flat * _ODD[j] + _ADD[j]
        out[:, j] = np.minimum.reduceat((x ^ (x >> np.uint64(29))) >> np.uint64(32), first).astype(np.uint32)
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """A bit of a hash of each place: a signed 64-bit number each."""
    bits = _mix(sig.astype(np.uint64) + np.uint64(0x1234567)) >> np.uint64(63)
    return (bits << np.arange(PLACES, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def children(node: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(child, row) of every class in its node: one place always, a second one in a share of the nodes."""
    h = _mix(node.view(np.uint64) + np.uint64(0x7F4A7C15))
    rows = np.arange(node.size)
    out, at = [], []
    second = (h >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    for i, chosen in ((0, rows), (1, np.flatnonzero(second))):
        place = ((h[chosen] >> np.uint64(6 * i)) % np.uint64(PLACES)).astype(np.int64)
        if i:  # another place than the first
            place = np.where(place == (h[chosen] % np.uint64(PLACES)).astype(np.int64), (place + 1) % PLACES, place)
        token = sig[chosen, place].astype(np.uint64)
        out.append(_mix(h[chosen] ^ _mix(token * np.uint64(64) + place.astype(np.uint64))).view(np.int64))
        at.append(chosen)
    return np.concatenate(out), np.concatenate(at)


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, hi, lo, sig): size and name of each document's shingle set and, where it isn't empty, its signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            full = [s for s in sets if s.size]
            sig = iter([r.tobytes() for r in signature(full)] if full else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.size for s in sets], pa.int64()), *_names(sets), pa.array([next(sig) if s.size else None for s in sets], pa.binary())], names=["doc_id", "n", "hi", "lo", "sig"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, hi bigint, lo bigint, sig binary")


def branch(rows: DataFrame, threshold: float, trees: int = 0) -> DataFrame:
    """(node, k, bits): the children of rows (node, k, sig), or with ``trees`` those of the roots for rows (k, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "sig"):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, PLACES)
            bits, k = sketch(sig), b.column("k").to_numpy()
            roots = [np.full(b.num_rows, t, np.int64) for t in range(1, trees + 1)] or [b.column("node").to_numpy()]
            for root in roots:
                child, at = children(np.ascontiguousarray(root), sig, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(k[at]), pa.array(bits[at])], names=["node", "k", "bits"])

    return arrow_map(rows, run, "node bigint, k bigint, bits bigint")


def small_pairs(nodes: DataFrame, differ: int) -> DataFrame:
    """(a, b, star) of the pairs in small nodes (node, members array of (k, bits)) whose sketches differ in few bits.

    star: the pairs of a spanning tree; if they turn out to be links, the others say nothing new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("members")
            cuts, flat = m.offsets.to_numpy() - m.offsets[0].as_py(), m.flatten()
            ks, bits = flat.field("k").to_numpy(), flat.field("bits").to_numpy().view(np.uint64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                order = np.argsort(ks[i:j], kind="stable")
                x, k = bits[i:j][order], ks[i:j][order]
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= differ
                p, q = np.nonzero(np.triu(near, 1))
                if not p.size:
                    continue
                top = list(range(j - i))
                star = []
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    while top[u] != u:
                        u = top[u]
                    while top[v] != v:
                        v = top[v]
                    star.append(u != v)
                    top[max(u, v)] = min(u, v)
                out.append((k[p], k[q], np.array(star)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "star"])

    return arrow_map(nodes.select("members"), run, "a bigint, b bigint, star boolean")


def full_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(k, names) of the classes in pairs (a, b), from the documents that stand for them, which are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes.select("k", "doc_id", "hi", "lo"), "k")
    wanted = broadcast_if_small(materialize(wanted, "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k, names = [], []
            for x, t, *name in zip(*(b.column(c).to_pylist() for c in ("k", "text", "hi", "lo")), strict=True):
                made = shingle_set(t, width)
                if set_name(made) == tuple(name):  # an id may stand for other texts too
                    k.append(x)
                    names.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(names, pa.binary())], names=["k", "names"])

    sets = arrow_map(docs.select("doc_id", "text").join(wanted, "doc_id").select("k", "text", "hi", "lo"), run, "k bigint, names binary")
    return materialize(sets.groupBy("k").agg(F.min("names").alias("names")), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("k").alias("a"), F.col("names").alias("x")), sets.select(F.col("k").alias("b"), F.col("names").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(x.size, y.size) < percent * max(x.size, y.size):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(x, y), x.size - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), check, "a bigint, b bigint")


def consensus(big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, k, bits, far), (node, n, pivot)): members of large nodes with their distance from the consensus, and each node's
    size and pivot, the member that is nearest to it."""
    ones = [F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1")).alias(f"b{i}") for i in range(PLACES)]
    votes = big.groupBy("node").agg(F.count("*").alias("n"), *ones)
    word = F.lit(0).cast("bigint")
    for i in range(PLACES):
        word = word.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    middle = votes.select("node", "n", word.alias("middle"))
    middle = materialize(middle, "middle")
    far = F.bit_count(F.col("bits").bitwiseXOR(F.col("middle"))).alias("far")
    far = materialize(hot_lookup(big, middle, "node", "n").select("node", "k", "bits", far), "far")
    pivots = far.groupBy("node").agg(F.min(F.struct("far", "k")).alias("p"), F.count("*").alias("n")).select("node", "n", F.col("p.k").alias("pivot"))
    return far, materialize(pivots, "pivots")


def group_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a pivot's group (pivot, k, root, main) that may be links and lie in different components.

    a is outside the pivot's component. Groups whose members are all inside give nothing. A member is a bitmap of the
    pivot's shingles that it has, and one of hashes of those that the pivot lacks. Blocks of a bounded number of members
    meet each other, so a group of any size is spread over tasks, and only pairs that pass the bound leave them.
    """
    split = groups.groupBy("pivot").agg(F.count("*").alias("size"), F.count_if(F.col("root") != F.col("main")).alias("outside")).filter("outside > 0")
    split = materialize(split.withColumn("n", F.col("size")).join(sets.select(F.col("k").alias("pivot"), F.col("names").alias("base")), "pivot"), "split")
    rows = hot_lookup(groups, split.drop("base"), "pivot", "n").join(sets, "k")
    rows = hot_lookup(rows, split.select("pivot", "n", "base"), "pivot", "n")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "names"):
            maps, news, size, own = [], [], [], []
            for x, base in zip(b.column("names").to_pylist(), b.column("base").to_pylist(), strict=True):
                x, base = np.frombuffer(x, np.uint64), np.frombuffer(base, np.uint64)
                at = np.minimum(np.searchsorted(base, x), base.size - 1)
                hit = base[at] == x
                word = np.zeros(-(-base.size // 64) * 64, np.uint8)
                word[at[hit]] = 1
                new = np.zeros(NEW_BITS, np.uint8)
                new[(x[~hit] % np.uint64(NEW_BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(word).tobytes())
                news.append(np.packbits(new).tobytes())
                size.append(x.size)
                own.append(int((~hit).sum()))
            keep = [b.column(c) for c in ("pivot", "k", "root", "main", "size", "outside")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(maps, pa.binary()), pa.array(news, pa.binary()), pa.array(size, pa.int64()), pa.array(own, pa.int64())], names=["pivot", "k", "root", "main", "size", "outside", "map", "new", "n", "own"])

    rows = rows.select("pivot", "k", "root", "main", "size", "outside", "names", "base")
    coded = materialize(arrow_map(rows, encode, "pivot bigint, k bigint, root bigint, main bigint, size bigint, outside bigint, map binary, new binary, n bigint, own bigint"), "coded")
    item = F.struct("k", "root", "map", "new", "n", "own")

    def blocks(df: DataFrame, total: str, most: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("k", F.lit(name)), F.ceil(F.col(total) / most)).alias("block")
        return df.groupBy("pivot", block).agg(F.collect_list(item).alias(name), F.first("size").alias("size"), F.first("outside").alias("outside"))

    # the blocks of a group lie on a grid, of which a task gets GRID by GRID
    across, down = F.ceil(F.col("size") / (INSIDE * GRID)), F.ceil(F.col("outside") / (OUTSIDE * GRID))
    xs = blocks(coded, "size", INSIDE, "xs").select("pivot", "xs", F.pmod("block", across).alias("x"), F.explode(F.sequence(F.lit(0), down - 1)).alias("y"))
    ys = blocks(coded.filter("root <> main"), "outside", OUTSIDE, "ys").select("pivot", "ys", F.explode(F.sequence(F.lit(0), across - 1)).alias("x"), F.pmod("block", down).alias("y"))
    met = xs.join(ys, ["pivot", "x", "y"])

    def unpack(part: pa.ListArray) -> tuple:
        rows = part.to_pylist()
        words = lambda f: np.stack([np.frombuffer(r[f], np.uint64) for r in rows])
        return words("map"), words("new"), *(np.array([r[f] for r in rows], np.int64) for f in ("k", "root", "n", "own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                xm, xn, xk, xr, xs, xo = unpack(b.column("xs")[i].values)
                ym, yn, yk, yr, ys, yo = unpack(b.column("ys")[i].values)
                lost = yo - np.bitwise_count(yn).sum(axis=1)
                a, c = [], []
                for j in range(yk.size):
                    base = np.bitwise_count(xm & ym[j]).sum(axis=1, dtype=np.int64)
                    new = np.bitwise_count(xn & yn[j]).sum(axis=1, dtype=np.int64) + lost[j]
                    most = base + np.minimum(new, np.minimum(xo, yo[j]))
                    ok = (100 * most >= percent * (xs + ys[j] - most)) & (xr != yr[j])
                    a.append(np.full(int(ok.sum()), yk[j], np.int64))
                    c.append(xk[ok])
                a, c = np.concatenate(a), np.concatenate(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    return arrow_map(met.select("xs", "ys"), compare, "a bigint, b bigint")


def stand_ins(docs: DataFrame) -> DataFrame:
    """``docs``, or, where ids are null, with ids of their own beyond all others in their place, written to be read again."""
    missing = docs.filter("doc_id is null")
    if missing.isEmpty():
        return docs
    own = (F.lit(STAND_IN).cast(WIDE) + F.monotonically_increasing_id()).cast(WIDE)
    made = materialize(missing.withColumn("doc_id", own), "null_ids")
    return docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast(WIDE)).unionByName(made)


def _restored(column: str, kind: str) -> Column:
    """An id of ``stand_ins`` as it was."""
    return F.when(F.col(column) < F.lit(STAND_IN).cast(WIDE), F.col(column)).cast(kind).alias(column)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach, the row's own included; kept marks the rows that have it for their id. Null and wordless
    texts have no shingles, link with nothing and stand alone. Equal sets are one class whatever its size, so copies
    cost a row each. Rows of the same id each get a row, by their own texts. An empty table gives an empty one; other
    columns are ignored. doc_id is an integer; null ids link, but never name a component unless all its ids are null, of
    which one row is kept.
    """
    docs = docs.select("doc_id", "text")
    named = stand_ins(docs)
    found = _linked(named, width, percent, trees)
    if named is docs:
        return found.drop("hi", "lo", "root")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select(_restored("doc_id", kind), "n_shingles", _restored("component_id", kind), "kept")


def _linked(docs: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """``near_duplicates`` of documents whose ids aren't null, with hi and lo, the name of a row's set, and its component's
    root, a class; all null without shingles."""
    threshold, differ = percent / 100, round(PLACES * (1 - percent / 100) / 2 + 5 * np.sqrt(PLACES * (1 + percent / 100) * (1 - percent / 100)) / 2)
    every = materialize(shingled(docs, width), "shingled")
    # a class is a set, told by 128 bits; k is its number, in the table that is written here
    classes = every.filter("hi is not null").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "sig")).alias("r"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("k"), "hi", "lo", "r.doc_id", "r.sig", "copies"), "classes")

    small, stars, level = [], [], branch(classes.select("k", "sig"), threshold, trees)
    for depth in range(1, DEPTH + 1):
        level = materialize(level, f"level{depth}")
        sizes = materialize(level.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > SMALL), "sizes")
        big = materialize(hot_lookup(level, sizes, "node", "size", "left_semi").select("node", "k", "bits"), "big")
        # without the large nodes a node's rows are few
        few = level.join(broadcast_if_small(sizes.select("node")), "node", "left_anti")
        members = few.groupBy("node").agg(F.collect_list(F.struct("k", "bits")).alias("members")).filter(F.size("members") > 1)
        small.append(materialize(small_pairs(members, differ), "small"))
        if big.isEmpty():
            break
        far, pivots = consensus(big)
        # at the last level all members are compared, however far they are from each other
        near = far.filter(F.col("far") <= (NEAR if depth < DEPTH else PLACES)).select("node", "k")
        stars.append(hot_lookup(near, pivots, "node", "n").select("pivot", "k").distinct())
        if depth < DEPTH:
            on = far.filter(F.col("far") > CENTRAL).select("node", "k")
            level = branch(on.join(classes.select("k", "sig"), "k").select("node", "k", "sig"), threshold)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    # a pair that ends a star in some node is checked first
    pairs = materialize(union(small).groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    groups = materialize(union(stars).distinct(), "groups") if stars else docs.sparkSession.createDataFrame([], "pivot bigint, k bigint")
    spokes = groups.filter("pivot <> k").select(F.least("pivot", "k").alias("a"), F.greatest("pivot", "k").alias("b"))
    every_pair = materialize(pairs.select("a", "b").unionByName(spokes).distinct(), "every_pair")
    sets = full_sets(every_pair, classes, docs, width)
    first = confirm(pairs.filter("star").select("a", "b").unionByName(spokes).distinct(), sets, percent)
    first = materialize(first, "links")
    found = materialize(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    roots = broadcast_if_small(found)
    root_of = lambda df, key, name: df.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    rest = root_of(root_of(pairs.filter("not star"), "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
    mains = materialize(root_of(groups.groupBy("pivot").agg(F.count("*").alias("n")), "pivot", "main"), "mains")
    apart = group_pairs(hot_lookup(root_of(groups, "k", "root"), mains, "pivot", "n"), sets, percent)
    second = confirm(materialize(rest.unionByName(apart).distinct(), "rest"), sets, percent)
    # components are joined by the new links alone: an end stands for its root
    joined = root_of(root_of(second, "a", "ra"), "b", "rb").select(F.col("ra").alias("u"), F.col("rb").alias("v"))
    upper = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = found.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(found.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    final = materialize(final.unionByName(alone), "final")

    # the least id of each component, by way of the classes
    named = final.join(classes.select(F.col("k").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    label = hot_lookup(final, materialize(named, "named"), "root", "n").withColumnRenamed("node", "k")
    label = classes.select("k", "hi", "lo", "copies", F.col("doc_id").alias("own")).join(label, "k", "left")
    # a single row that has no links needs no label
    label = label.filter("copies > 1 or root is not null").select("hi", "lo", "copies", F.coalesce("root", "k").alias("root"), F.coalesce("component_id", "own").alias("component_id"))
    out = hot_lookup(every.select("doc_id", "n", "hi", "lo"), materialize(label, "label"), ["hi", "lo"], "copies", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "hi", "lo", "root")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, with its own columns.

    Of rows that share the smallest id the one of the least set name stays, of those with the same set the least row by
    its columns in order (any of them if a column has no order). Null and wordless texts are in no group and all stay,
    repeated ones too. Null ids go last; a group without other ids keeps one row. An empty table gives an empty one.
    """
    named = stand_ins(docs)
    rows = materialize(_linked(named, width, percent, TREES), "linked")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("kept").select("doc_id", "n")
    ids = materialize(ids, "kept_ids")
    kept = named.join(broadcast_if_small(ids.filter("n = 1").select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    many = ids.filter("n > 1").select("doc_id")
    if not many.isEmpty():
        kept = kept.unionByName(_one_of_each(named, rows, broadcast_if_small(many), width).select(*docs.columns))
    return kept if named is docs else kept.withColumn("doc_id", _restored("doc_id", docs.schema["doc_id"].dataType.simpleString()))


def _one_of_each(docs: DataFrame, rows: DataFrame, many: DataFrame, width: int) -> DataFrame:
    """The documents that stay of those whose ids, ``many``, stand in several rows; ``rows`` as ``_linked`` gives them."""
    found = rows.filter("kept").join(many, "doc_id", "left_semi")
    stay = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("r")).select("r.*")
    # a linked or copied set in this list, and a set that is alone and so has no root
    stay = stay.unionByName(found.filter("root is null and hi is not null").select("doc_id", "hi", "lo")).withColumn("stays", F.lit(True))
    copies = docs.join(many, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    kind, row = docs.schema["doc_id"].dataType.simpleString(), copies.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *_names(sets)], names=["row", "doc_id", "hi", "lo"])

    made = arrow_map(copies, run, f"row {row}, doc_id {kind}, hi bigint, lo bigint")
    least = F.any_value("row") if "map<" in row or "variant" in row else F.min("row")
    full = made.filter("hi is not null").groupBy("doc_id", "hi", "lo").agg(least.alias("row"))
    full = full.join(stay, ["doc_id", "hi", "lo"], "left_semi")
    return made.filter("hi is null").select("row.*").unionByName(full.select("row.*"))
