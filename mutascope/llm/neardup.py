"""Near-duplicate groups with an LSH forest over MinHash signatures.

1. One pass turns each text into its set of ``width``-word shingles and keeps the set's size, a 128-bit
   fingerprint and a signature of ``TREES * STEP`` minima. Equal sets form a class; from here on a class is
   its smallest doc_id, so thousands of copies cost one node.
2. Forest: tree t reads the signature as a cyclic sequence from place ``STEP * t``. Classes that agree on the
   first ``STEP`` values share a region; sorted by the following values, the classes next to one another
   have the longest common prefixes and become candidates (``REACH`` on each side). A region of more than
   ``REGION`` classes is cut by a longer prefix, level by level; what is still larger at the full signature is
   compared with its smallest class. No region is collected, no region's pairs are enumerated. The forest runs in two
   rounds: next neighbours first, then, with the components found so far, those further off, where pairs of one
   component are left out as they are made (such a pair cannot change a component).
3. Candidates whose signatures agree widely enough are confirmed on the full shingle sets (100 * intersection >= 100 * similarity * union), built
   again from the texts of candidate classes only.
4. Links become components by alternating large-star and small-star steps with written tables between.
5. In a crowded region a class may be similar to the group's centre alone and have nearer neighbours in every
   order. So each class is compared once more with the best-linked class of each of its regions, if that is
   in another component, and new links join the components.
6. What the neighbours and centres of a crowded region still miss is found exactly: classes that stand in a region
   of more than ``REACH + 1`` are joined on the prefixes of their sets, rarest shingles first, with length and
   position filters that lose nothing. Pairs of one component are skipped: on each shingle only the classes
   outside its largest component are paired with the others.

A pair at similarity 0.8 shares a region of some tree with probability 1 - (1 - 0.8**3)**24, over 0.9999999;
smaller regions are compared whole, larger ones by step 6, so a pair that shares a region is never lost to crowding.

Defined cases: null, empty and word-free texts have no set, link with nothing and are kept; fewer than
``width`` words form one shingle; a null doc_id cannot name a component: such rows are kept, with a null
component; rows are judged by their own text, and classes with the same smallest id count as one. Shingles
are compared as 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutascope.llm import text as X

TREES, STEP, REACH, REGION = 24, 3, 4, 8192
CENTRE = 2  # values of a prefix that make the wider regions in which centres are sought
AGREE = 40  # of 72 signature values: below, similarity 0.8 has a chance under 1e-6, and sets are not compared
ORDER = 3  # sort columns after the prefix; each holds four signature values
DEPTHS = (STEP, 6, 12, 24, TREES * STEP)
HEAVY_BROADCAST = 100_000   # region keys (8 bytes each) that may be broadcast
IDS_BROADCAST = 1_000_000   # ids of candidate classes (8 bytes each) that may be broadcast
SEEDS = np.random.default_rng(20).integers(1, 1 << 63, TREES * STEP, dtype=np.uint64) * X.U(2) + X.U(1)


def shingles(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text and their text numbers (ascending)."""
    raw, off = X.buffers(part.column("text"))
    starts, ends, doc = X.segments(raw, off, X.NOT_SPACE)
    words = X.fingerprints(raw, starts, ends, X.LOWER)
    grams, at = X.windows(words, doc, width)
    of = doc[at]
    counts = np.bincount(doc, minlength=part.num_rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = counts[short].astype(np.uint64)
        for k in range(width - 1):
            more = counts[short] > k
            whole[more] = X.mix(whole[more] * X.U(0xD6E8FEB86659FD93) + words[first[more] + k])
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, short])
    _, index = np.unique(X.keyed(grams, of), return_index=True)
    index = index[np.argsort(of[index], kind="stable")]
    return grams[index], of[index]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (f1, f2) and signature of every row."""
    def work(part: pa.RecordBatch) -> list:
        grams, of = shingles(part, width)
        n = part.num_rows
        sizes = np.bincount(of, minlength=n)
        has = sizes > 0
        signature = np.zeros((int(has.sum()), TREES * STEP), np.int32)
        prints = np.zeros((2, n), np.int64)
        if len(grams):
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            prints[0][has] = np.add.reduceat(X.mix(grams), cuts).view(np.int64)
            prints[1][has] = np.add.reduceat(X.mix(grams ^ X.U(0xA5A5A5A55A5A5A5A)), cuts).view(np.int64)
            for j, seed in enumerate(SEEDS):
                signature[:, j] = np.minimum.reduceat(((grams * seed) >> X.U(32)).astype(np.uint32), cuts).view(np.int32)
        return [pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                _lists(signature.ravel(), has * signature.shape[1], pa.int32())]

    return X.map_rows(docs, ["doc_id"], "n_shingles long, f1 long, f2 long, signature array<int>", lambda: work)


def _forest(classes: DataFrame, *more: str) -> DataFrame:
    """One row per class and tree."""
    return classes.select("rep", "n", "signature", *more, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))


def _key(depth: int):
    """The region of a row at a depth: its tree and the first values of the tree's order."""
    ring = F.concat("signature", "signature")
    return F.xxhash64("tree", F.slice(ring, F.col("tree") * STEP + 1, depth))


def region_sizes(classes: DataFrame) -> DataFrame:
    """key and count of the regions of more than two classes."""
    sizes = _forest(classes).select(_key(STEP).alias("key")).groupBy("key").count()
    return X.written(sizes.where("count > 2"), "regions")


def candidates(classes: DataFrame, reach: int = REACH, region: int = REGION, ratio: int = 80, turn: int = 0,
               sizes: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a < b) of classes (rep, n, signature), sizes already compatible: neighbours up to ``reach`` places
    on, in turn 1 the next ones only, in turn 2 the others. Pairs of one ``component`` are left out where the
    classes have such a column. ``sizes``: ``region_sizes`` of the classes, where known."""
    hops = {0: range(1, reach + 1), 1: range(1, 2), 2: range(2, reach + 1)}[turn]
    if "component" not in classes.columns:
        classes = classes.withColumn("component", F.col("rep"))
    if not hops:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    sizes = region_sizes(classes) if sizes is None else sizes
    rows = _forest(classes, "component")
    wide = None
    if hops[0] > 1:  # a region of two has first neighbours only
        if sizes.count() <= HEAVY_BROADCAST:
            rows = rows.withColumn("key", _key(STEP)).join(F.broadcast(sizes.select("key")), "key", "left_semi")
        else:
            wide = sizes.select("key")

    def following(depth: int, k: int):
        """Values 4k to 4k+3 after the prefix (16 bits of each), packed into one sortable number."""
        out = F.lit(0).cast("long")
        for j in range(4):
            value = F.get("signature", (F.col("tree") * STEP + depth + 4 * k + j) % (TREES * STEP))
            out = F.shiftleft(out, 16) + value.bitwiseAND(F.lit(0xFFFF))
        return out

    found, parents = [], None
    for level, depth in enumerate(DEPTHS):
        here = rows
        if parents is not None:
            here = here.withColumn("parent", _key(DEPTHS[level - 1])).join(parents, "parent", "left_semi")
        here = here.select("rep", "n", "component", "tree", "signature", _key(depth).alias("key"))
        heavy = (sizes if level == 0 else here.groupBy("key").count()).where(F.col("count") > region).select("key")
        heavy = X.written(heavy, "heavy")
        any_heavy = bool(heavy.take(1))
        light = here
        if any_heavy:
            heavy = X.small(heavy, HEAVY_BROADCAST)
            light = here.join(heavy, "key", "left_anti")
        sort = [f"o{k}" for k in range(ORDER)]
        light = light.select("key", *[following(depth, k).alias(o) for k, o in enumerate(sort)], "rep", "n", "component")
        if wide is not None and level == 0:  # no semi-join, which would sink below the short columns and move signatures
            light = X.found(light, wide, ["key"], HEAVY_BROADCAST)
        order = Window.partitionBy("key").orderBy(*sort, "rep")
        ahead = F.struct(F.col("rep").alias("other"), F.col("n").alias("m"), F.col("component").alias("far"))
        near = light.select("rep", "n", "component", *[F.lead(ahead, k).over(order).alias(f"next{k}") for k in hops])
        found.append(near.select("rep", "n", "component", F.explode(F.array(*[f"next{k}" for k in hops])).alias("x"))
                     .where("x is not null").select("rep", "n", "component", "x.other", "x.m", "x.far"))
        if not any_heavy:
            break
        if level == len(DEPTHS) - 1 and hops[0] == 1:
            rest = here.join(heavy, "key", "left_semi")
            first = rest.groupBy("key").agg(F.min(F.struct("rep", "n", "component")).alias("x"))
            found.append(rest.join(first, "key").select("rep", "n", "component", F.col("x.rep").alias("other"),
                                                        F.col("x.n").alias("m"), F.col("x.component").alias("far")))
        parents = X.small(heavy.select(F.col("key").alias("parent")), HEAVY_BROADCAST)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return (pairs.where((F.col("component") != F.col("far")) & (100 * F.least("n", "m") >= ratio * F.greatest("n", "m")))
            .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct())


def promising(pairs: DataFrame, classes: DataFrame, agree: int = AGREE) -> DataFrame:
    """Pairs whose signatures agree in at least ``agree`` places (a short column, so that the long sets of
    clearly different classes are not moved)."""
    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    return pairs.join(left, "a").join(right, "b").where(same >= agree).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, ratio: int = 80) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= ratio * union, with both numbers."""
    ids = X.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = X.found(docs.select("doc_id", "text"), ids, ["doc_id"], IDS_BROADCAST)

    def work(part: pa.RecordBatch) -> list:
        grams, of = shingles(part, width)
        sizes = np.bincount(of, minlength=part.num_rows)
        cuts = np.cumsum(sizes)[:-1]
        return [[np.sort(g).tobytes() for g in np.split(grams, cuts)]]

    sets = X.written(X.map_rows(texts, ["doc_id"], "set binary", lambda: work), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")

    def compare(batches):
        for batch in batches:
            for part in X.slices(batch, "sa", 1 << 24):
                common, union = [], []
                for x, y in zip(part.column("sa"), part.column("sb")):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    k = len(np.intersect1d(p, q, assume_unique=True))
                    common.append(k)
                    union.append(len(p) + len(q) - k)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common, pa.int64()),
                                                  pa.array(union, pa.int64())], names=["a", "b", "common", "total"])
                yield out
            X.tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (X.in_batches(both.select("a", "b", "sa", "sb"), compare, f"a {kind}, b {kind}, common long, total long")
            .where(100 * F.col("common") >= ratio * F.col("total")))


def placed(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``classes`` with their component so far."""
    known = X.looked_up(classes.select("rep", "n", "signature"), labels.withColumnRenamed("node", "rep"), ["rep"], HEAVY_BROADCAST)
    return known.withColumn("component", F.coalesce("component", "rep"))


def centre_candidates(classes: DataFrame, links: DataFrame, labels: DataFrame, ratio: int = 80) -> DataFrame:
    """Pairs (a < b) of a class and the best-linked class of one of its regions, in different components."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    known = X.written(X.looked_up(placed(classes, labels), X.written(ends, "ends"), ["rep"], HEAVY_BROADCAST), "centres")
    rows = known.select("rep", "n", "signature", "component", "degree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("rep", "n", "component", "degree", _key(CENTRE).alias("key"))
    centres = (rows.where("degree is not null").groupBy("key")
               .agg(F.max(F.struct("degree", "rep", "n", "component")).alias("x"))
               .select("key", F.col("x.rep").alias("other"), F.col("x.n").alias("m"), F.col("x.component").alias("far")))
    met = rows.select("key", "rep", "n", "component").join(centres, "key")
    return (met.where((F.col("component") != F.col("far")) & (100 * F.least("n", "m") >= ratio * F.greatest("n", "m")))
            .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct())


def crowded(classes: DataFrame, reach: int = REACH) -> DataFrame:
    """rep of the classes in a region of more than ``reach + 1``: smaller regions are compared whole."""
    rows = _forest(classes).select("rep", _key(STEP).alias("key"))
    full = X.written(rows.groupBy("key").count().where(F.col("count") > reach + 1).select("key"), "crowded")
    return X.found(rows, full, ["key"], HEAVY_BROADCAST).select("rep").distinct()


def prefix_candidates(reps: DataFrame, docs: DataFrame, labels: DataFrame, width: int, ratio: int = 80) -> DataFrame:
    """All pairs (a < b) of the classes ``reps`` in different components that can reach the ratio.

    Shingles are ordered by their frequency among these classes. A set of n needs ceil(ratio * n / 100) common
    shingles, so similar sets share one of the first n - needed + 1; at the first common one, no more than the rest
    of the shorter tail can be common. Shingles of one set only join nothing and are counted, not moved.
    """
    ids = X.written(reps.select(F.col("rep").alias("doc_id")), "ids")
    texts = X.found(docs.select("doc_id", "text"), ids, ["doc_id"], IDS_BROADCAST)

    def work(part: pa.RecordBatch) -> list:
        grams, of = shingles(part, width)
        return [_lists(grams.view(np.int64), np.bincount(of, minlength=part.num_rows), pa.int64())]

    sets = X.map_rows(texts, ["doc_id"], "grams array<long>", lambda: work).where(F.size("grams") > 0)
    sets = X.written(sets.withColumn("row", F.monotonically_increasing_id()), "grams")
    each = sets.select("row", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = (each.join(often, "gram").groupBy("row")
              .agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("shared")))
    heads = sets.select("row", F.col("doc_id").alias("rep"), F.size("grams").cast("long").alias("n")).join(shared, "row")
    heads = heads.withColumn("alone", F.col("n") - F.size("shared"))  # they come first in the order
    keep = (F.size("shared") - F.ceil(ratio * F.col("n") / 100) + 1).cast("int")
    heads = heads.where(keep > 0).select("rep", "n", "alone", F.posexplode(F.slice("shared", 1, keep)).alias("at", "x"))
    heads = heads.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("x.gram").alias("gram"), "rep", "n", F.coalesce("component", "rep").alias("component"),
        (F.col("n") - F.col("alone") - F.col("at")).alias("left"))  # shingles from this one on
    heads = X.written(heads, "heads")
    sizes = heads.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("size"))
    major = sizes.groupBy("gram").agg(F.max(F.struct("size", "component")).alias("x"), F.count(F.lit(1)).alias("parts"))
    major = X.written(major.where("parts > 1").select("gram", F.col("x.component").alias("major")), "major")
    open_ = X.written(heads.join(major, "gram"), "open")
    few = open_.where(F.col("component") != F.col("major")).select(
        "gram", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "component", "left")])
    total = F.col("n") + F.col("n2")
    met = open_.join(few, "gram").where(
        (F.col("component") != F.col("component2"))
        & ((F.col("component") == F.col("major")) | (F.col("rep") < F.col("rep2")))
        & (100 * F.least("n", "n2") >= ratio * F.greatest("n", "n2"))
        & ((100 + ratio) * F.least("left", "left2") >= ratio * total))
    return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Large-star joins each larger neighbour of a node to the node's smallest neighbour, small-star does the
    same for the smaller neighbours; the rounds needed grow with the logarithm of the size. Minima are
    aggregated before the shuffle and hubs appear only as join keys.
    """
    e = X.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = X.written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (large.join(low, "u")
               .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
               .select("x.u", "x.v").where("u > v").distinct())
        e = X.written(nxt, "small")


def near_duplicates(docs: DataFrame, width: int = 4, ratio: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sk = X.written(sketches(docs, width), "sketches")
    linked = sk.where("n_shingles > 0 and doc_id is not null")
    sets = ["f1", "f2", "n_shingles"]
    classes = X.written(linked.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    sized = classes.select("rep", F.col("n_shingles").alias("n"), "signature", F.col("rep").alias("component"))
    regions = region_sizes(sized)

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        return X.written(confirmed(X.written(pairs, name), docs, width, ratio).select("a", "b"), f"{name}-links")

    def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
        if not more.take(1):
            return labels
        return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    links = links_of(promising(candidates(sized, ratio=ratio, turn=1, sizes=regions), sized), "next")
    labels = components(links)
    wider = candidates(placed(sized, labels), ratio=ratio, turn=2, sizes=regions)
    more = links_of(promising(wider, sized), "wider")
    labels, links = joined(labels, more), links.union(more)
    labels = joined(labels, links_of(promising(centre_candidates(sized, links, labels, ratio), sized), "centre"))
    labels = joined(labels, links_of(prefix_candidates(crowded(sized), docs, labels, width, ratio), "rest"))
    named = (classes.join(labels, classes.rep == labels.node, "left")
             .select(*sets, F.coalesce("component", "rep").alias("component_id")))
    out = sk.drop("signature").join(named, sets, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, ratio: int = 80) -> DataFrame:
    """One document of each group (the smallest id), with all columns. A document is an id with a text: where an id stands
    on several texts, each is judged by itself; repeated rows of a document stay or go together. Rows without an id stay."""
    rows, back = X.hidden(docs, "doc_id", "text")
    rows = rows.withColumn("_text", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.coalesce("text", F.lit("")))))
    named = rows.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_text")).alias("doc_id"), "text")
    gone = near_duplicates(named, width, ratio).where("not kept").select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id._text").alias("_text")).distinct()
    return X.found(rows, X.written(gone, "copies"), ["doc_id", "_text"], IDS_BROADCAST, present=False).select(*back)
