"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Documents are sets of word shingles under one global order, rare first. Of two sets of at least n shingles that
link, the first n - ceil(0.8 n) + m of either must share m or more. So each document may lengthen its prefix by m - 1
and ask for m shared tokens; a pair must share as many as the smaller m of the two. A document picks its m by the
estimated cost of its candidates: postings to read, and candidates to verify, which fall as m grows.

1. One pass counts all shingles in a sketch of fixed size. It decides the order and the costs, never the result.
2. Equal sets become one class. Each class emits its prefix.
3. Classes whose prefix shares too few tokens with any other go. First round: in each posting list every class meets
   one central class only (a grouped minimum, so a token that a third of all classes share is no hot key), and classes
   that agree on a part of the parities of their whole sets meet two of their group. Verified pairs make components,
   so a group of near copies leaves little for the last round.
4. Last round: classes that share a token and lie in different components meet each other, as far as set sizes and the
   places of the token allow enough overlap and parities of the whole sets show no greater difference than a link
   allows. Pairs that share enough tokens are verified. What lies in one component already needs no more links for that.
5. Every link joins two classes of one component, so all pairs of a component, dealt in pairs of blocks, are
   intersected exactly by counting shared tokens; a class's links are counted there, and no pair is written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, is_small, mix, release, shingles, small, stage, steps, sweep, utf8

#: Counters of the sketch and bits of the filter: 4 MB and 8 MB at any size of input.
SKETCH, BLOCKS = 1 << 22, 16
FILTER_BITS = 1 << 26
#: Cost of verifying one candidate, in postings read.
VERIFY_COST = 32.0
#: Postings that a token costs at least, as the sketch can't see less.
UNSEEN_COST = 0.3
#: 64-bit numbers of parities per set.
PARITIES = 8
#: Set elements and classes that a block of a component holds on average at most.
BLOCK_ELEMENTS, BLOCK_CLASSES = 1_000_000, 2_000
#: Sizes of linked sets lie in one band or in two that follow each other, as 1.26 > 1 / 0.8.
BAND = 1.26
_PARITY_SEED = np.uint64(0x2545F4914F6CDD1D)


# --- tables of fixed size, summed over tasks ---------------------------------------------


def _combined(parts: DataFrame, how: str) -> DataFrame:
    """Adds ('sum', 32 bit) or unites ('or', 8 bit) the tasks' blocks (block, data): one written row per block; streams, so no group is held."""
    width = SKETCH // BLOCKS if how == "sum" else FILTER_BITS // 8 // BLOCKS

    def fold(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py()
                kind = np.uint8 if how == "or" or len(raw) == width else np.uint32
                values = np.frombuffer(raw, kind)
                if how == "or":
                    found[block] = found[block] | values if block in found else values
                else:
                    if block not in found:
                        found[block] = np.zeros(width, np.uint32)
                    found[block] += values
        for block, values in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    once = parts.withColumn("part", F.spark_partition_id() % 16).repartition(BLOCKS * 4, "block", "part").select("block", "data").mapInArrow(fold, schema)
    return stage(once.repartition(BLOCKS, "block").select("block", "data").mapInArrow(fold, schema), "table")


def _table(blocks: DataFrame, width: int) -> np.ndarray:
    """The whole table of bytes (4 to 8 MB) from rows of blocks; a block without a row is zero."""
    out = np.zeros((BLOCKS, width), np.uint8)
    for block, data in blocks.toLocalIterator():
        out[block] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _blocks(values: np.ndarray):
    for k, part in enumerate(values.reshape(BLOCKS, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "data"])


def _each(batches):
    """(data, offsets, batch columns but the text, range) of text in steps; the text is the last column."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.num_columns - 1))
        for i, j in steps(offsets):
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [c[i:j] for c in batch.columns[:-1]]


def shingle_classes(docs: DataFrame) -> np.ndarray:
    """A byte for each hash bucket: log2 of how often its shingles occur beyond the average bucket, over all documents."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for data, offsets, _ in _each(batches):
            np.add.at(counts, (shingles(data, offsets)[0] & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        yield from _blocks(np.minimum(counts, 255).astype(np.uint8))

    def total(batches):
        for batch in batches:
            sums = [int(np.frombuffer(x.as_py(), np.uint32).sum(dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], ["n"])

    counts = _combined(docs.select("text").mapInArrow(run, "block int, data binary"), "sum")
    mean = (counts.mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0) / SKETCH

    def classes(batches):
        for batch in batches:
            for block, data in zip(*batch.columns):
                n = np.frombuffer(data.as_py(), np.uint32)
                out = np.log2(1 + np.maximum(0, n - 2 * mean - 2)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "data"])

    out = _table(counts.mapInArrow(classes, "block int, data binary"), SKETCH // BLOCKS)
    release(counts)
    return out


# --- sets and prefixes -------------------------------------------------------------------


def needed(n):
    """Least overlap of a set of n with any set that it links to."""
    return (SIMILARITY_PERCENT * n + 99) // 100


def least_asked(n):
    """Shared tokens that every document of n shingles asks for at least."""
    return np.maximum(1, n // 16)


def choose(costs: np.ndarray) -> int:
    """The number of shared tokens m to ask for, given the estimated postings of each token of the ordered set."""
    n = len(costs)
    room = n - int(needed(n))
    total = np.cumsum(np.maximum(costs, UNSEEN_COST))
    m = best = int(least_asked(n))
    least = np.inf
    while room + m <= n:
        read = total[room + m - 1]
        cost = room + m + read + VERIFY_COST * read / m
        if cost < least:
            best, least = m, cost
        m *= 2
    return best


def _fingerprints(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    with np.errstate(over="ignore"):
        a, b = mix(u ^ np.uint64(0x5851F42D4C957F2D)), mix(u + np.uint64(0x14057B7EF767814F))
        return int(np.add.reduce(a).astype(np.int64)), int(np.add.reduce(b).astype(np.int64))


def _parities(u: np.ndarray) -> list[int]:
    """512 parities of the set, as 8 numbers: every element in one set alone flips one bit, so two sets differ in at least as many elements as bits."""
    odd = np.bincount((mix(u + _PARITY_SEED) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def prefixes(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Per document, written: rid (its row), doc_id, th (hash of its text), n (set size), fp1, fp2, m, its prefix in the global order and p0 to p7, its parities; an empty set has no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    extra = [f"p{k}" for k in range(PARITIES)]
    names = ["doc_id", "th", "n", "fp1", "fp2", "m", "prefix", *extra]
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * PARITIES]

    def run(batches):
        table = shared.value
        for data, offsets, own in _each(batches):
            s, first = shingles(data, offsets)
            rows = []
            for k, ids in enumerate(zip(*(c.to_pylist() for c in own))):
                u = np.unique(s[first[k] : first[k + 1]])
                if not len(u):
                    rows.append((*ids, 0, 0, 0, 0, None, *[0] * PARITIES))
                    continue
                rank = table[(u & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")
                m = choose(np.exp2(rank[order].astype(np.float64)) - 1)
                rows.append((*ids, len(u), *_fingerprints(u), m, u[order[: len(u) - int(needed(len(u))) + m]].view(np.int64), *_parities(u)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, th long, n long, fp1 long, fp2 long, m int, prefix array<long>, " + ", ".join(f"{c} long" for c in extra)
    out = stage(_hashed(docs).select("doc_id", "th", "text").mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    shared.destroy()
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text; doc_id and th find a row's document again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


# --- verification ------------------------------------------------------------------------


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and set (sorted hashes) of the wanted classes (cid, fp1, fp2, n), from one document each, written."""

    def bits(batches):
        out = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _blocks(out)

    filtered = _combined(wanted.select("fp1").mapInArrow(bits, "block int, data binary"), "or")
    shared = docs.sparkSession.sparkContext.broadcast(_table(filtered, FILTER_BITS // 8 // BLOCKS))
    release(filtered)

    def run(batches):
        table = shared.value
        for data, offsets, _ in _each(batches):
            s, first = shingles(data, offsets)
            rows = {}
            for k in range(len(offsets) - 1):
                u = np.unique(s[first[k] : first[k + 1]])
                if len(u):
                    fp1, fp2 = _fingerprints(u)
                    at = int(mix(np.array([fp1], np.int64).view(np.uint64))[0] & np.uint64(FILTER_BITS - 1))
                    if table[at >> 3] >> (at & 7) & 1:
                        rows[fp1, fp2, len(u)] = u.tobytes()
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(list(rows.values()), pa.binary())], ["fp1", "fp2", "n", "set"])

    found = docs.select("text").mapInArrow(run, "fp1 long, fp2 long, n long, set binary")
    out = stage(found.join(wanted, ["fp1", "fp2", "n"]).dropDuplicates(["cid"]).select("cid", "set"), "sets")
    shared.destroy()
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs a, b of classes those that link by exact intersection of their sets."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILARITY_PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


# --- components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, by alternating large and small stars; every round is written out.

    links: a, b. Grouped minima are formed before the shuffle, so a node with very many links is no hot key.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        out = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = out.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        met = out.join(low, "u")
        # large: larger neighbours hang on the least one; small: the others and the node itself do
        new = met.where("v > u").select("v", "low") if large else met.select("v", "low").unionByName(low.select(F.col("u").alias("v"), "low"))
        return new.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()

    seen = None
    while True:
        new = stage(star(star(edges, True), False), "stars")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        release(edges)
        edges = new
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = stage(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp"))), "components")
    release(edges)
    return out


# --- all links of a component --------------------------------------------------------------


def _overlaps(x: np.ndarray, x_row: np.ndarray, nx: int, y: np.ndarray, y_row: np.ndarray, ny: int, tokens: int) -> np.ndarray:
    """Shared tokens of each of nx sets with each of ny: frequent tokens by a matrix product, the others pair by pair."""
    out = np.zeros(nx * ny, np.int32)
    cx, cy = np.bincount(x, minlength=tokens), np.bincount(y, minlength=tokens)
    work = cx * cy
    dense = np.flatnonzero(work * 200 > nx * ny)
    place = np.full(tokens, -1)
    place[dense] = np.arange(len(dense))
    for k in range(0, len(dense), 1024):
        a, b = (np.zeros((n, min(1024, len(dense) - k)), np.float32) for n in (nx, ny))
        for m, at, row in ((a, place[x] - k, x_row), (b, place[y] - k, y_row)):
            use = (at >= 0) & (at < m.shape[1])
            m[row[use], at[use]] = 1
        out += (a @ b.T).astype(np.int32).ravel()
    rare = (work > 0) & (place < 0)
    x_order = np.argsort(x, kind="stable")
    first = np.concatenate([[0], np.cumsum(cx)])
    use = np.flatnonzero(rare[y])
    ends = np.cumsum(cx[y[use]])
    k = 0
    while k < len(use):
        done = ends[k - 1] if k else 0
        j = max(k + 1, int(np.searchsorted(ends, done + 4_000_000, "right")))
        part = use[k:j]
        n = cx[y[part]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[y[part]], n)
        # every pair counts once per shared token
        keys, found = np.unique(x_row[x_order[at]] * ny + np.repeat(y_row[part], n), return_counts=True)
        out[keys] += found.astype(np.int32)
        k = j
    return out.reshape(nx, ny)


def _degrees(group: pd.DataFrame) -> pd.DataFrame:
    """cid and links within one pair of blocks: of side 0 with side 1, or of side 0 with itself where there is no other."""
    sets = [np.frombuffer(v, np.uint64) for v in group["set"]]
    size = np.array([len(v) for v in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    side = group["side"].to_numpy()
    one = bool((group["own"]).iloc[0])
    if not one and (side == 0).all() | (side == 1).all():
        return pd.DataFrame({"cid": group["cid"], "links": 0})
    kept = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if one else 1))]
    rows = np.repeat(np.arange(len(sets)), size)
    parts = []
    for which in kept:
        place = np.full(len(sets), -1)
        place[which] = np.arange(len(which))
        use = place[rows] >= 0
        parts += [codes[use], place[rows[use]], len(which)]
    both = _overlaps(*parts, int(codes.max()) + 1).astype(np.int64)
    linked = 100 * both >= SIMILARITY_PERCENT * (size[kept[0]][:, None] + size[kept[1]][None, :] - both)
    if one:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[kept[0]] += linked.sum(1)
    if not one:
        links[kept[1]] += linked.sum(0)
    return pd.DataFrame({"cid": group["cid"], "links": links})


def link_counts(comps: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """cid and links, the number of classes that it links to, of every class of comps (node, comp); sizes has cid and n, sets their sets.

    A component is cut into bands of set sizes, and these into blocks by hash; each pair of blocks that sizes let link is
    a group of its own, so a large component is no hot key.
    """
    placed = stage(comps.select(F.col("node").alias("cid"), "comp").join(sizes.select("cid", "n"), "cid").withColumn("band", _band("n")), "placed")
    bands = placed.groupBy("comp", "band").agg(F.count("*").alias("k"), F.sum("n").alias("elements"))
    slots = F.ceil(F.greatest(F.col("elements") / BLOCK_ELEMENTS, F.col("k") / BLOCK_CLASSES)).cast("int")
    whole = (F.sum("k").over(of := Window.partitionBy("comp")) <= BLOCK_CLASSES) & (F.sum("elements").over(of) <= BLOCK_ELEMENTS)
    blocks = bands.withColumns({"slots": slots, "whole": whole})
    layout = stage(blocks.groupBy("comp").agg(F.sum("k").alias("members"), F.first("whole").alias("whole"), F.map_from_entries(F.collect_list(F.struct("band", "slots"))).alias("slots")), "layout")
    met = placed.join(F.broadcast(layout) if is_small(bands) else layout, "comp")
    # two classes of one component link
    pairs = met.where("members = 2").select("cid", F.lit(1).cast("long").alias("links"))
    slot = F.when(F.col("whole"), 0).otherwise(F.expr("cast(pmod(xxhash64(cid), slots[band]) as int)"))
    keys = """
        if(whole, array(named_struct('lo', 0, 'a', 0, 'hi', 0, 'b', 0, 'side', 0)), concat(
            transform(sequence(0, slots[band] - 1), s -> named_struct('lo', band, 'a', least(s, slot), 'hi', band, 'b', greatest(s, slot), 'side', if(s < slot, 1, 0))),
            if(slots[band + 1] is null, array(), transform(sequence(0, coalesce(slots[band + 1], 1) - 1), s -> named_struct('lo', band, 'a', slot, 'hi', band + 1, 'b', s, 'side', 0))),
            if(slots[band - 1] is null, array(), transform(sequence(0, coalesce(slots[band - 1], 1) - 1), s -> named_struct('lo', band - 1, 'a', s, 'hi', band, 'b', slot, 'side', 1)))))"""
    dealt = met.where("members > 2").withColumn("slot", slot).select("comp", "cid", F.explode(F.expr(keys)).alias("key"))
    full = dealt.select("comp", "cid", "key.*").withColumn("own", F.expr("lo = hi and a = b")).join(sets.select("cid", "set"), "cid")
    found = full.groupBy("comp", "lo", "a", "hi", "b").applyInPandas(lambda group: _degrees(group), "cid long, links long")
    return pairs.unionByName(found.groupBy("cid").agg(F.sum("links").alias("links")))


# --- the join ----------------------------------------------------------------------------


def _alike(a: str, b: str):
    """Whether sizes allow a link."""
    return (F.col(a) * 100 >= F.col(b) * SIMILARITY_PERCENT) & (F.col(b) * 100 >= F.col(a) * SIMILARITY_PERCENT)


def _placed(met: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return met.withColumn("comp", F.col("cid"))
    return met.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _able(postings: DataFrame, rounds: int = 2) -> DataFrame:
    """The postings of classes that can still link: token, cid, n, m, pos, sr (shared tokens before), u (others up to the last).

    Two linked sets share at least m tokens of their m-prefixes, m being the lesser of what they ask for. So a
    class needs, for some m from the least that a partner may ask for up to its own, m shared tokens in its
    m-prefix. Classes without go, which leaves fewer tokens shared, and so again.
    """
    room = F.col("n") - F.floor((SIMILARITY_PERCENT * F.col("n") + 99) / 100)
    partner = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * SIMILARITY_PERCENT / 100) / 16))
    before = None
    for _ in range(rounds):
        shared = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").drop("k")
        met = postings.join(shared, "token")
        own = Window.partitionBy("cid")
        met = met.withColumn("sr", F.row_number().over(own.orderBy("pos")) - 1)
        good = (F.col("sr") + 1).between(partner, F.col("m")) & (F.col("pos") < room + F.col("sr") + 1)
        met = met.withColumns({"u": F.max(F.col("pos") - F.col("sr")).over(own), "_ok": F.max(good).over(own)}).where("_ok").drop("_ok")
        postings = stage(met.select("token", "cid", "n", "m", "pos", "sr", "u"), "met")
        release(*[before] * (before is not None))
        before = postings
    return postings


def _grouped(docs: DataFrame, count_links: bool) -> DataFrame:
    """Per row of docs, written: rid, doc_id, th, n, class_id, comp (class of the group), component_id and, if asked, links."""
    spark = docs.sparkSession
    prefixed = prefixes(docs, shingle_classes(docs))
    rows = stage(prefixed.drop("prefix", "m"), "rows")
    classes = stage(rows.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    copies = stage(rows.join(classes.where("copies > 1"), ["fp1", "fp2", "n"]).where("rid <> cid").select("rid"), "copies")
    kept = prefixed.where("n > 0").join(small(copies), "rid", "left_anti")
    met = _able(kept.select(F.col("rid").alias("cid"), F.col("n").cast("int").alias("n"), "m", F.posexplode("prefix").alias("pos", "token")))
    release(prefixed, copies)
    wanted = stage(classes.join(met.select("cid").distinct(), "cid", "left_semi").select("cid", "fp1", "fp2", "n"), "wanted")
    sets = _sets(docs, wanted)
    release(wanted)
    sweep(spark)

    # first round: each class with pivots among those that agree with it on a part of their parities, and with the most central one of each posting list
    sizes = classes.select("cid", F.col("n").alias("pn"))
    pivots = met.groupBy("token").agg(F.min(F.struct("u", "cid")).alias("pivot"), F.count("*").alias("k")).where("k > 1").select("token", F.col("pivot.cid").alias("a"))
    pairs = met.join(pivots, "token").where("cid <> a").groupBy("a", F.col("cid").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    pairs = pairs.where("c * 16 >= n").join(sizes.withColumnRenamed("cid", "a"), "a").where(_alike("n", "pn")).select("a", "b")
    pairs = pairs.union(_agreeing(met, rows)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stage(pairs.distinct(), "pairs")
    links = verified(tried, sets)
    comps = components(links)
    sweep(spark)

    # last round: what is left between components
    pairs = _last_pairs(met, comps, rows, tried)
    release(met, tried)
    if not pairs.isEmpty():
        found = verified(pairs, sets)
        both = stage(links.union(found), "links")
        release(links, found, comps)
        links, comps = both, components(both)
    release(pairs)
    sweep(spark)

    member = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = member.join(member.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
    if count_links:
        named = named.join(link_counts(comps, classes, sets), "cid", "left")
    counted = [F.coalesce("links", F.lit(0)).cast("long").alias("links")] * count_links
    named = named.select("fp1", "fp2", "n", F.col("cid").alias("class_id"), "comp", "component_id", *counted)
    out = rows.select("rid", "doc_id", "th", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left").drop("fp1", "fp2")
    out = stage(out, "grouped")
    release(rows, classes, sets, links, comps)
    sweep(spark)
    return out


def _apart(a: str, b: str):
    """Elements that two sets differ in at least, by their parities."""
    return sum((F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(1, PARITIES)), F.bit_count(F.col(f"{a}p0").bitwiseXOR(F.col(f"{b}p0"))))


def _least(a: str, b: str):
    """The overlap that two sets of these sizes need: 100 i >= 80 (a + b - i)."""
    return F.ceil((F.col(a) + F.col(b)) * SIMILARITY_PERCENT / (100 + SIMILARITY_PERCENT) - 1e-9)


def _agreeing(met: DataFrame, rows: DataFrame) -> DataFrame:
    """a (a pivot) and b: classes that agree on one of 16 parts of their parities, each with the first and the last of them.

    Sets that differ little agree on some parts; a part that sums up few elements says too little and isn't used. One
    row per class and part, and grouped extremes, so a large group of near copies is no hot key; no class gets more
    than 32 pairs, and those that the whole parities forbid go.
    """
    halves = [F.struct(F.lit(2 * k + h).alias("k"), (F.shiftrightunsigned(f"p{k}", 32) if h else F.col(f"p{k}").bitwiseAND(0xFFFFFFFF)).alias("word")) for k in range(PARITIES) for h in (0, 1)]
    able = rows.select(F.col("rid").alias("b"), F.explode(F.array(*halves)).alias("x")).join(met.select(F.col("cid").alias("b")).distinct(), "b", "left_semi")
    keyed = able.select("b", "x.*").where(F.bit_count("word") >= 3)
    ends = keyed.groupBy("k", "word").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    pairs = keyed.join(ends, ["k", "word"]).select("b", F.explode(F.array("low", "high")).alias("a")).where("a <> b").distinct()
    whole = lambda c: rows.select(F.col("rid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", *(f"p{k}" for k in range(PARITIES)))))
    fit = _alike("a_n", "b_n") & (_apart("a_", "b_") <= F.col("a_n") + F.col("b_n") - 2 * _least("a_n", "b_n"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").where(fit).select("a", "b")


def _last_pairs(met: DataFrame, comps: DataFrame, rows: DataFrame, tried: DataFrame) -> DataFrame:
    """a and b, written: the pairs of classes in different components that may link and weren't tried.

    Classes meet under a token and a band of set sizes, so those whose sizes forbid a link aren't compared.
    """
    placed = _placed(met, comps)
    open_tokens = placed.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("token")
    able = _able(placed.join(open_tokens, "token", "left_semi").select("cid", "n", "m", "pos", "token"))
    extra = [f"p{k}" for k in range(PARITIES)]
    rest = stage(_placed(able, comps).join(rows.select(F.col("rid").alias("cid"), *extra), "cid").withColumn("band", _band("n")), "open")
    release(able)
    columns = ("cid", "n", "m", "pos", "sr", "comp", "band", *extra)
    x = rest.select("token", F.col("band").alias("at"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = rest.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"), *(F.col(c).alias(f"b_{c}") for c in columns))
    least = _least("a_n", "b_n")
    # before this token only shared ones can be common, after it no more than either set has left
    most = F.least("a_sr", "b_sr") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    # linked sets differ in at most a + b - 2 i elements, and in at least as many as their parities do
    fit = (most >= least) & (_apart("a_", "b_") <= F.col("a_n") + F.col("b_n") - 2 * least)
    once = (F.col("a_band") < F.col("b_band")) | (F.col("a_cid") < F.col("b_cid"))
    crossed = x.join(y, ["token", "at"]).where(once & (F.col("a_comp") != F.col("b_comp")) & _alike("a_n", "b_n") & fit)
    counted = crossed.groupBy("a_cid", "b_cid").agg(F.count("*").alias("c"), F.first("a_m").alias("a_m"), F.first("b_m").alias("b_m"))
    pairs = counted.where(F.col("c") >= F.least("a_m", "b_m")).select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b"))
    out = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    release(rest)
    return out


def _band(size: str):
    """Sizes of linked sets lie in one band or in two that follow each other."""
    return F.floor(F.log(F.col(size).cast("double")) / float(np.log(BAND))).cast("int")


def similar_groups(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, class_id (equal sets) and, if asked, links (all other classes that its class links to, exactly).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null, empty and wordless texts have no shingles,
    no links and themselves as component. Rows with an equal doc_id are documents of their own; a null doc_id
    never names a component unless all its members' are null. Texts may have any length; an empty table gives no rows.
    Other columns are not read.
    """
    counted = ["links"] * count_links
    if count_links:
        counted = [F.coalesce("links", F.lit(0)).cast("long").alias("links")]
    return _grouped(docs, count_links).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", *counted)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group of rows that link to each other, directly or over others.

    The row with the least doc_id stays, a null one coming last; of rows that share it the one with the least hash of its
    text, and of repeated rows any one. Rows are known by doc_id and text, so an unrelated text under the same doc_id
    stays. Rows without words are in no group and all stay. All columns stay, whatever their names.
    """
    grouped = _grouped(docs, False)
    rows = grouped.where("n > 0").select("comp", "th", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    key = ["none", "id", "th"]
    keys = stage(rows.groupBy("comp", *key).agg(F.count("*").alias("k")), "keys")
    first = keys.groupBy("comp").agg(F.count("*").alias("keys"), F.min(F.struct(*key)).alias("first"))
    held = keys.join(first, "comp").where("keys > 1 or k > 1").select(*key, (F.struct(*key) == F.col("first")).alias("stays"), "k")
    held = stage(held, "held")
    release(grouped, keys)
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)], F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("th"))
    out = named.join(small(held.where("not stays").select(*key)), key, "left_anti")
    repeated = held.where("stays and k > 1").select(*key)
    if not repeated.isEmpty():
        out = out.join(small(repeated), key, "left_anti").unionByName(out.join(small(repeated), key, "left_semi").dropDuplicates(key))
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


__all__ = ["SHINGLE_WORDS", "components", "one_of_each", "similar_groups"]
