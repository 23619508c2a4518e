"""Near duplicates by a chosen-path similarity join.

Documents become sets of hashed word shingles.  Equal sets are one *node*.
Independent trees branch the nodes by minwise tokens: two nodes share
a branch with the probability of their Jaccard similarity, so similar ones stay
together down the tree while others part.  A tree node of at most ``LEAF``
members is compared exhaustively; larger ones branch on (``DEPTHS`` tokens deep
at most).  Trees are repeated to the target recall: a pair at the threshold
parts in all of them with a probability of at most ``MISS``.  How many that
takes depends on the depth, (1 - s^d)^trees: every node is in the trees that
suffice where leaves are two tokens deep, a node of a branch that stayed large
is in those for four tokens too, and what stayed large there in those for
seven (11, 19 and 36 at 0.85; 14, 27 and 59 at 0.80).  The added trees start
at their depth.

Links serve components, so they are confirmed in two rounds.  First members are
compared with one drawn in each tree node (stars, never all pairs); after
joining what is linked, stars are drawn again among those still apart, and then
every pair whose components still differ is compared: all such pairs inside
leaves, and in deep nodes that stayed large (clusters of near copies) all such
pairs too, exactly.  A large node is dealt into blocks of bounded size, and each
pair of blocks is a *tile* whose set intersections are counted at once, as a
product of membership matrices, so that no pair leaves a tile but a link.  A
component larger than a block has its own blocks, and no tile lies within it:
copies that are joined already meet only those that are not.
Before other comparisons lengths and 128 one-bit minhashes must allow the
threshold; the latter cut lies six standard deviations below it.  In the second
round the shingles that a member shares with no other open member bound its
similarities as well, exactly: copies that were edited too far apart drop out
without being paired.  Every link is confirmed on the full sets.

Edge cases: a null or blank text has no shingles and is linked with nothing; a
text of fewer words than a shingle is one shingle; equal ids or rows are linked
like others; a null doc_id is never the smallest unless all are null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import documents, packed, sent_if_small, shipped, tidy, written
from .hashing import functions, mix, shingle_sets, slices

#: A pair at the threshold is in no common leaf with this probability at most.
MISS = 1e-6
DEPTHS = (2, 4, 7)
LEAF = 48
SKETCH = 128
#: Members, and shingles of all of them, of a block of a large node.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Ids of documents to confirm, up to this many, are broadcast to the scan; a
#: larger set is joined by shuffle.
BROADCAST_IDS = 2_000_000

_SIGNED = "rid long, doc_id long, n int, k1 long, k2 long, s1 long, s2 long, paths array<long>"
_SETS = "k1 long, k2 long, shingles array<long>"


def _set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order of its members."""
    return int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + np.uint64(0x2545F491)).sum(dtype=np.uint64).astype(np.int64))


def _longs(offsets: list[int] | np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _trees(percent: int) -> list[tuple[int, int]]:
    """Per depth of ``DEPTHS`` the trees (from, to) that start there: with the
    trees before them they keep a pair's miss at that depth below ``MISS``."""
    ends = [ceil(log(MISS) / log1p(-((percent / 100) ** d))) if percent < 100 else 1 for d in DEPTHS]
    return list(zip([0, *ends], ends))


def _levels(percent: int) -> list[tuple[int, int]]:
    """(tree, index of its depth) of a node's paths, in their order."""
    return [(t, j) for i, (lo, hi) in enumerate(_trees(percent)) for t in range(lo, hi) for j in range(i, len(DEPTHS))]


def _signer(width: int, percent: int):
    """Rows (rid, doc_id, text) to set size, set name, sketch and tree paths."""
    depth = max(DEPTHS)
    place = {level: k for k, level in enumerate(_levels(percent))}
    trees = _trees(percent)[-1][1]
    fs = functions(max(trees * depth, SKETCH), 7)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(2)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets])
                keys = [_set_keys(s) for s in sets]
                full = np.flatnonzero(n)
                sketch = np.zeros((2, len(sets)), np.uint64)
                paths = np.zeros((len(sets), len(place)), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    heads = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for f, (a, c) in enumerate(fs):
                        low = np.minimum.reduceat(flat * a + c, heads)
                        if f < SKETCH:
                            sketch[f // 64, full] |= ((low >> np.uint64(21)) & np.uint64(1)) << np.uint64(f % 64)
                        tree, level = divmod(f, depth)
                        if tree < trees:
                            path = mix((np.full(len(full), tree, np.uint64) if level == 0 else path) * np.uint64(0x9E3779B97F4A7C15) + low)  # noqa: F821
                            if level + 1 in DEPTHS and (tree, DEPTHS.index(level + 1)) in place:
                                paths[full, place[tree, DEPTHS.index(level + 1)]] = path
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, len(place), 0))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int32()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(sketch[0].view(np.int64)), pa.array(sketch[1].view(np.int64)), _longs(ends, paths[full].ravel())],
                    names=["rid", "doc_id", "n", "k1", "k2", "s1", "s2", "paths"],
                )

    return sign


def _setter(width: int):
    """Texts to the name and the members of their shingle sets."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                sets = [s for s in shingle_sets(data, offsets, width) if len(s)]
                if sets:
                    keys = [_set_keys(s) for s in sets]
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), _longs(ends, np.concatenate(sets))], names=["k1", "k2", "shingles"])

    return sets_of


def _named(width: int):
    """A scalar Arrow function: text to the name of its shingle set."""

    def name(texts: pa.Array) -> pa.Array:
        keys = [_set_keys(s) if len(s) else (None, None) for _, _, data, offsets in slices(texts) for s in shingle_sets(data, offsets, width)]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())], names=["k1", "k2"])

    return F.arrow_udf(name, "k1 long, k2 long")


def _may_link(x, y, percent: int) -> Column:
    """Lengths and sketches of two structs (n, s1, s2) allow the similarity."""
    p = (1 + percent / 100) / 2
    most = SKETCH - int(SKETCH * p - 6 * sqrt(SKETCH * p * (1 - p)))
    differ = F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"]))
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (differ <= most)


def _grown(nodes: DataFrame, percent: int) -> DataFrame:
    """The trees' final nodes that have company: (p, large, node, n, s1, s2),
    one row per member; large ones stayed above ``LEAF`` at the last depth."""
    rows = done = None
    who, at = nodes, 0
    for i, (lo, hi) in enumerate(_trees(percent)):
        # nodes of large branches get the trees that the next depth asks for
        per = len(DEPTHS) - i
        trees = F.transform(F.sequence(F.lit(0), F.lit(hi - lo - 1)), lambda t: F.struct(*[F.get("paths", t * per + at + j).alias(f"p{i + j}") for j in range(per)]))
        fresh = who.select("node", "n", "s1", "s2", F.inline(trees)) if hi > lo else None
        at += (hi - lo) * per
        rows = fresh if rows is None else rows if fresh is None else rows.unionByName(fresh)
        p = f"p{i}"
        size = rows.groupBy(F.col(p).alias("q")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = written(rows.join(size, F.col(p) == F.col("q")).drop("q"), f"branch{i}")
        last = i == len(DEPTHS) - 1
        found = (rows if last else rows.where(F.col("size") <= LEAF)).select(F.col(p).alias("p"), (F.col("size") > LEAF).alias("large"), "node", "n", "s1", "s2")
        done = found if done is None else done.unionByName(found)
        if not last:
            rows = rows.where(F.col("size") > LEAF).drop("size", p)
            deep = written(rows.select("node").distinct(), f"deep{i}")
            who = nodes.join(sent_if_small(deep, BROADCAST_IDS), "node", "left_semi")
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is the smallest node
    reachable.  Large-star and small-star steps until nothing changes; each
    step is two shuffles by node, and hubs are combined map-side."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        e = written(small.where("u != v").distinct(), "star")
        # done when every edge leads to a node that leads nowhere, each node to one
        once = e.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
        if once.where("k > 1").select("u").union(e.join(once.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u")).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in ``asked``, from whole texts."""
    wanted = written(nodes.select("node", "k1", "k2", "doc_id").join(asked, "node"), "asked")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_setter(width)), _SETS).join(wanted.select("node", "k1", "k2"), ["k1", "k2"])
    return written(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b"), "links")


def _linked(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Edges (a, b) that join what ``comps`` and ``more`` join."""
    return comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _shared_counts(sets: DataFrame) -> DataFrame:
    """(node, c): how many of a node's shingles any other of these nodes has."""
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only")).where("n = 1")
    alone = alone.groupBy("only").agg(F.count(F.lit(1)).alias("u"))
    return sets.join(alone, F.col("node") == F.col("only"), "left").select("node", (F.size("shingles") - F.coalesce("u", F.lit(0))).alias("c"))


def _may_share(x, y, percent: int) -> Column:
    """The similarity is possible if only the shared shingles can be common."""
    most = F.least(x["c"], y["c"])
    return most * 100 >= (x["n"] + y["n"] - most) * percent


def _similar(x, y, percent: int) -> Column:
    """The full sets of two structs (n, shingles) have the similarity."""
    shared = F.size(F.array_intersect(x["shingles"], y["shingles"]))
    return shared * 100 >= (x["n"] + y["n"] - shared) * percent


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share (0 on the diagonal)."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    flat, row = np.concatenate(sets)[order], row[order]
    heads = np.flatnonzero(np.diff(flat, prepend=flat[:1] - 1))
    often = np.diff(heads, append=len(flat))
    out = np.zeros(n * n, np.int64)
    for f in range(2, 9):  # rare ones pair by pair
        at = heads[often == f]
        if len(at):
            r = row[at[:, None] + np.arange(f)]
            x, y = np.triu_indices(f, 1)
            out += np.bincount((r[:, x] * n + r[:, y]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    common = np.flatnonzero(often > 8)
    for lo in range(0, len(common), 2048):  # common ones as matrices
        some = common[lo : lo + 2048]
        m = np.zeros((n, len(some)), np.float32)
        size = often[some]
        at = np.repeat(heads[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
        m[row[at], np.repeat(np.arange(len(some)), size)] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def _tile(percent: int):
    """A tile's links (a, b) between members of different components; pairs
    inside one of its two blocks are left to the tile of that block alone."""

    def links(t: pa.Table) -> pa.Table:
        node, n, comp, block = (t[c].to_numpy() for c in ("node", "n", "comp", "block"))
        flat = t["shingles"].combine_chunks()
        sets = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])
        alone = t["i"][0].as_py() == t["j"][0].as_py()
        shared = _overlaps(sets)
        ok = (shared * 100 >= (n[:, None] + n[None, :] - shared) * percent) & (comp[:, None] != comp[None, :])
        if not alone:
            ok &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(ok, 1))
        return pa.table({"a": np.maximum(node[a], node[b]), "b": np.minimum(node[a], node[b])})

    return links


def _tiles(large: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) of the members (p, node, n, comp, shingles) of large nodes.
    A component that fills more than a block has blocks of its own, which meet
    the others' but not each other; small ones share blocks."""
    # counted map-side, then by node: what follows is partitioned by it already
    comps = large.groupBy("p", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n")).repartition("p")
    fill = lambda members, n: F.greatest(F.ceil(members / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    node = Window.partitionBy("p")
    comps = comps.withColumn("several", F.count(F.lit(1)).over(node) > 1).where("several")
    comps = comps.withColumn("own", F.when(fill(F.col("members"), F.col("n")) > 1, F.col("comp")).otherwise(-1))  # no node is below 0
    groups = comps.groupBy("p", "own").agg(fill(F.sum("members"), F.sum("n")).cast("int").alias("k"))
    groups = groups.withColumns({"at": F.sum("k").over(node.orderBy("own").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"), "all": F.sum("k").over(node)})
    sizes = written(comps.select("p", "comp", "own").join(groups, ["p", "own"]), "sizes")
    if sizes.isEmpty():  # every large node is one component
        return None
    dealt = large.join(sizes, ["p", "comp"])
    dealt = dealt.withColumn("block", (F.col("at") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("k"))).cast("int"))
    meets = lambda i: (F.col("own") == -1) | (i < F.col("at")) | (i >= F.col("at") + F.col("k"))
    dealt = dealt.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("all").cast("int") - 1), meets)))
    dealt = dealt.select("p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "comp", "shingles")
    return dealt.groupBy("p", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def _stars(met: DataFrame, may, draw: int = 0) -> DataFrame:
    """Distinct pairs (a, b): a member of a tree node and the one drawn there."""
    drawn = met.groupBy("p").agg(F.min_by(F.struct([c for c in met.columns if c not in ("p", "large")]), F.xxhash64("p", "node", F.lit(draw))).alias("y"))
    j = met.join(written(drawn, "drawn"), "p").where((F.col("node") != F.col("y.node")) & may(F.struct([c for c in met.columns if c != "p"]), F.col("y")))
    return j.select(F.col("node").alias("a"), F.col("y.node").alias("b")).distinct()


def _with_comps(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with each node's component; itself if it is linked with none."""
    j = rows.join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    return j.withColumn("comp", F.coalesce("comp", "node")).drop("c_node")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components differ."""
    x = _with_comps(pairs.withColumnRenamed("a", "node"), comps).select(F.col("node").alias("a"), "b", F.col("comp").alias("x"))
    y = _with_comps(x.withColumnRenamed("b", "node"), comps).select("a", F.col("node").alias("b"), "x", "comp")
    return y.where("x != comp").select("a", "b")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signed, groups).  signed: rid, doc_id, n (size of the shingle set), k1
    and k2 (its name) of each row.  groups: k1, k2, comp and component_id of
    each set that more than one row has or that is linked with another."""
    shipped(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(rows.mapInArrow(tidy(_signer(width, percent)), _SIGNED), "signed")
    same = written(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "same")
    nodes = signed.join(same.select("node"), F.col("rid") == F.col("node"), "left_semi").withColumnRenamed("rid", "node")
    met = written(_grown(nodes, percent), "met")

    # round 1: members of a tree node against one of them, drawn by hash
    stars = written(_stars(met, lambda x, y: _may_link(x, y, percent)), "stars")
    comps = written(components(_confirmed(stars, _sets(docs, nodes, _ends(stars), width), percent)), "comps")

    # round 2: pairs whose components still differ; first who may be in one
    at = written(_with_comps(met, comps), "at")
    member = F.struct("node", "n", "s1", "s2", "comp")
    leaves = at.where("NOT large").groupBy("p").agg(F.collect_list(member).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    open_to = lambda x, y: (x["comp"] != y["comp"]) & _may_link(x, y, percent)
    asked = leaves.select(F.explode(F.filter("m", lambda x: F.exists("m", lambda y: open_to(x, y)))).alias("x")).select("x.node")
    split = at.where("large").groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("p")
    asked = written(asked.union(at.where("large").join(split, "p", "left_semi").select("node")).distinct(), "open")
    if not asked.isEmpty():
        sets = _sets(docs, nodes, asked, width)
        at = written(met.join(_shared_counts(sets), "node").where(F.col("c") * 100 >= F.col("n") * percent), "at")
        may = lambda x, y: _may_link(x, y, percent) & _may_share(x, y, percent)
        again = _apart(_stars(at, may, 1), comps)
        comps = written(components(_linked(comps, _confirmed(again, sets, percent))), "comps")
        # all that is left, compared where it meets: only links leave the join
        at = written(_with_comps(at, comps).join(sets, "node"), "at")
        member = F.struct("node", "n", "s1", "s2", "comp", "c", "shingles")
        linked = lambda x, y: (x["comp"] != y["comp"]) & may(x, y) & _similar(x, y, percent)
        pair = lambda x, y: (F.greatest(x["node"], y["node"]).alias("a"), F.least(x["node"], y["node"]).alias("b"))
        leaves = at.where("NOT large").groupBy("p").agg(F.collect_list(member).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        inner = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda y: linked(x, y)), lambda y: F.struct(*pair(x, y)))))
        found = leaves.select(F.explode(inner).alias("x")).select("x.a", "x.b")
        large = at.where("large")
        tiles = _tiles(large.select("p", "node", "n", "comp", "shingles"), percent)
        found = written((found if tiles is None else found.unionByName(tiles)).distinct(), "found")
        if not found.isEmpty():
            comps = written(components(_linked(comps, found)), "comps")

    named = same.join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    named = named.where((F.col("copies") > 1) | F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    return signed, written(named.select("k1", "k2", "comp").join(least, "comp"), "groups")


def labelled(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    signed, groups = near_groups(docs, width, percent)
    j = signed.select("doc_id", "n", "k1", "k2").join(groups.drop("comp").withColumn("in_group", F.lit(True)), ["k1", "k2"], "left")
    grouped = F.col("in_group").isNotNull() & (F.col("n") > 0)
    j = j.withColumn("component_id", F.when(grouped, F.col("component_id")).otherwise(F.col("doc_id")))
    return j.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with its
    smallest doc_id, and every row that is linked with nothing."""
    _, groups = near_groups(docs, width, percent)
    rows = packed(docs, F.col("doc_id"), _named(width)(F.col("text")).alias("k")).select("row", "doc_id", "k.k1", "k.k2")
    j = rows.join(sent_if_small(groups), ["k1", "k2"], "left")
    alone = j.where("comp IS NULL").select("row")
    kept = j.where(F.col("comp").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["comp"]).select("row")
    return alone.unionByName(kept).select("row.*")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(documents(spark, sf_dir), width=3, percent=85)


OP4_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] END) AS s FROM d),
k AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
t AS (SELECT rep, n, unnest(s) AS x FROM k),
c AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r(x, y) AS (SELECT rep, rep FROM k UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x AS rep, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.s) = k.s LEFT JOIN m ON m.rep = k.rep"""
