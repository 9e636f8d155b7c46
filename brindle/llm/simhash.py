"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within `radius` bits agree, by the pigeonhole principle, on some choice of whole
blocks of their bits. Those masked patterns are the index's upper nodes: each fingerprint is
dealt to the node of every choice, so any linked pair meets in one. Under a node fingerprints
stand in Gray order and form a tree whose nodes factor out the bits that all their members
share; a search adds up the differences from the top and leaves a whole group as soon as they
exceed the radius, or when the group is already in the searcher's component.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, column, materialize, slices
from .components import components

SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of size words, A-Z lowered; a shorter text is one run, an empty one none."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: lowers A-Z alone, splits at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same items, by the finaliser of SplitMix64."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, second: bool = False) -> DataFrame:
    """(doc_id, key, fp): fp as a signed 64-bit number, key a hash of the text; a null text is empty.

    With `second`, fp2 is another fingerprint of the same shingles, from mixed hashes.
    """
    bounded_batches(docs.sparkSession)
    df = docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("key"), column(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches, 2):
            fps = []
            for t in batch.column("text").to_pylist():
                h = shingle_hashes(t or "", shingle)
                fps.append([fingerprint(h), *([fingerprint(mixed(h))] if second else [])])
            found = np.array(fps, np.uint64).reshape(len(fps), 1 + second).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c) for c in found.T)], names=["doc_id", "key", "fp", *(["fp2"] if second else [])])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, key long, fp long" + (", fp2 long" if second else ""))


def choose_masks(n: int, radius: int, per_node: int = 64) -> list[int]:
    """Masks of agreeing blocks so that any two fingerprints within radius agree under one.

    Of b blocks, radius differences leave b - radius untouched. More blocks make more masks, so
    more copies of a fingerprint, of more shared bits, so fewer fingerprints under a node. The
    choice with the least work is taken, where a copy counts as much as comparisons with
    per_node others; it moves on with n without end. Every choice finds every pair.
    """
    best = None
    for blocks in range(radius + 1, min(3 * radius + 4, 65)):
        agree = blocks - radius
        cost = math.comb(blocks, agree) * (1 + n / 2.0 ** (64 * agree // blocks) / per_node)
        if best is None or cost < best[0]:
            best = cost, blocks, agree
    _, blocks, agree = best
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in pick) for pick in combinations(range(blocks), agree)]


def gray_rank(fp: Column) -> Column:
    """Position of a bit pattern in Gray order: the exclusive or of all its right shifts."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


class GrayIndex:
    """The tree over Gray-ordered fingerprints, and the components found in it."""

    LEAF, FAN, SMALL = 16, 8, 64

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.n = fps, radius, len(fps)
        self.parent, self.merges = np.arange(self.n), []
        self.levels: list[dict] = []
        starts = np.arange(0, self.n, self.LEAF)
        both, any_ = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        while True:
            shared = ~(both ^ any_)
            self.levels.append({"starts": starts, "mask": shared, "bits": both & shared})
            if len(starts) <= self.FAN:
                break
            pick = np.arange(0, len(starts), self.FAN)
            starts, both, any_ = starts[pick], np.bitwise_and.reduceat(both, pick), np.bitwise_or.reduceat(any_, pick)
        for level in self.levels:
            level["ends"] = np.append(level["starts"][1:], self.n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites the components of linked pairs, and keeps the pairs that did unite two."""
        parent = self.parent
        for a_, b_ in zip(a.tolist(), b.tolist()):
            x, y = a_, b_
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.merges.append((a_, b_))

    def _mark(self) -> np.ndarray:
        """Roots, and for each node the least and greatest root below it."""
        root = self.roots()
        for level in self.levels:
            level["low"], level["high"] = np.minimum.reduceat(root, level["starts"]), np.maximum.reduceat(root, level["starts"])
        return root

    def link(self) -> np.ndarray:
        """Root of each fingerprint once all pairs within the radius are linked."""
        near = np.flatnonzero(np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= self.radius)
        self.union(near, near + 1)
        step = max(1, min(2048, 4_000_000 // self.n))
        for at in range(0, self.n, step):
            self._search(np.arange(at, min(at + step, self.n)), self._mark())
        return self.roots()

    def _search(self, q: np.ndarray, root: np.ndarray) -> None:
        fps, radius = self.fps, self.radius
        top = self.levels[-1]
        nodes = np.tile(np.arange(len(top["starts"])), len(q))
        q = np.repeat(q, len(top["starts"]))
        apart, above = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            own = level["mask"][nodes] & ~above  # bits that this node factors out beyond its parent
            apart = apart + np.bitwise_count((fps[q] ^ level["bits"][nodes]) & own)
            same = (level["low"][nodes] == root[q]) & (level["high"][nodes] == root[q])
            go = (apart <= radius) & ~same & (level["ends"][nodes] > q + 1)
            q, nodes, apart, above = q[go], nodes[go], apart[go], level["mask"][nodes[go]]
            if not len(q):
                return
            fan, below = (self.FAN, len(self.levels[depth - 1]["starts"])) if depth else (self.LEAF, self.n)
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            q, apart, above = np.repeat(q, fan), np.repeat(apart, fan), np.repeat(above, fan)
            if (nodes >= below).any():
                ok = nodes < below
                q, nodes, apart, above = q[ok], nodes[ok], apart[ok], above[ok]
        hit = (nodes > q) & (root[nodes] != root[q])
        q, nodes = q[hit], nodes[hit]
        hit = np.bitwise_count(fps[q] ^ fps[nodes]) <= radius
        self.union(q[hit], nodes[hit])


def _link_groups(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of equal group numbers, linked pairs that make a forest of its components."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    a_out, b_out = [], []

    def give(f: np.ndarray, merges: list) -> None:
        pairs = np.array(merges, np.int64).reshape(-1, 2)
        a_out.append(f[pairs[:, 0]])
        b_out.append(f[pairs[:, 1]])

    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= GrayIndex.SMALL), sizes))
    if len(at):
        # small groups, all at once: compare neighbours in Gray order at every offset
        f = fps[at]
        left = np.concatenate([np.arange(k, 0, -1) for k in sizes[(sizes > 1) & (sizes <= GrayIndex.SMALL)].tolist()]) - 1
        leaf = GrayIndex.__new__(GrayIndex)
        leaf.parent, leaf.merges = np.arange(len(at)), []
        i = np.arange(len(at))
        for s in range(1, GrayIndex.SMALL):
            i = i[left[i] >= s]
            if not len(i):
                break
            near = i[np.bitwise_count(f[i + s] ^ f[i]) <= radius]
            leaf.union(near, near + s)
        give(f, leaf.merges)
    for k in np.flatnonzero(sizes > GrayIndex.SMALL):
        f = fps[starts[k] : starts[k] + sizes[k]]
        index = GrayIndex(f, radius)
        index.link()
        give(f, index.merges)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a_out]), np.concatenate([empty, *b_out])


def linked(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) of distinct fingerprints: linked pairs, enough of them for the components of all links."""
    masks = choose_masks(fps.count(), radius)
    nodes = F.array(*(F.struct(F.lit(i).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks)))
    dealt = fps.select("fp", gray_rank(F.col("fp")).alias("g"), F.inline(nodes))
    dealt = dealt.repartition("m", "k").sortWithinPartitions("m", "k", "g").select("m", "k", "fp")

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def give(m, k, f):
            change = np.append(True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])) if len(m) else np.zeros(0, bool)
            a, b = _link_groups(np.cumsum(change), f, radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            m, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            m, k, f = np.append(held[0], m), np.append(held[1], k), np.append(held[2], f.astype(np.int64).view(np.uint64))
            last = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield give(m[:cut], k[:cut], f[:cut])
            held = [m[cut:], k[cut:], f[cut:]]
        if len(held[0]):
            yield give(*held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most radius bits. Copies
    collapse to one fingerprint before any search, and pairs are never listed: an index gives
    a forest. Null texts count as empty, all empty texts share fingerprint zero; null ids take
    part but are no component's id unless it has no other. Repeated rows stay repeated.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = materialize(components(linked(fps.select("fp"), radius), "a", "b"), "fingerprint-components")
    with_rep = found.join(fps, found["node"] == fps["fp"]).select("fp", "root", "rep")
    least = materialize(with_rep.groupBy("root").agg(F.min("rep").alias("least")), "component-ids")
    ids = found.join(least, "root").select(F.col("node").alias("fp"), "least")
    ids = fps.join(ids, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(materialize(ids, "fingerprint-ids"), "fp").select("doc_id", "key", "fp", "component_id")


def shingle_sets(docs: DataFrame, firsts: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(key, set): the distinct shingles of each text in firsts (id, key), which names one row of each.

    Texts are met by id and key, so copies of one text are told apart before any shuffle of texts
    and no key has more rows than a row has repeats.
    """
    texts = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("key"), column(text_col).alias("text"))
    first = firsts.select(F.col("id").alias("first_id"), F.col("key").alias("first_key"))
    texts = texts.join(first, (F.col("key") == F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("key", "text")

    def sets(batches):
        for batch in slices(batches, 1):
            hashes = [np.unique(shingle_hashes(t or "", shingle)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "set"])

    return texts.mapInArrow(sets, "key long, set array<long>").groupBy("key").agg(F.any_value("set").alias("set"))


def alike(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose sets have a Jaccard similarity of least or more; two empty sets have."""
    a, b = (sets.select(F.col("key").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = links.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common >= least * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


#: Most central texts of a component that all its texts are compared with in a round, and the rounds.
HUBS, ROUNDS = 8, 2


def _pairs(left: DataFrame, right: DataFrame, on: list[str], least: float, extra=None) -> DataFrame:
    """Distinct (a, b) of rows that meet on `on`, are of two roots, and whose sets' sizes allow a similarity of least."""
    one = left.select(*on, *(F.col(c).alias(f"{c}_a") for c in left.columns if c not in on))
    two = right.select(*on, *(F.col(c).alias(f"{c}_b") for c in right.columns if c not in on))
    fit = (F.col("root_a") != F.col("root_b")) & (F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.col("n_b") >= least * F.col("n_a") - 1e-9)
    met = one.join(two, on).where(fit if extra is None else fit & extra)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def missed(near: DataFrame, good: DataFrame, groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """good with more links of alike texts, those that a forest of near fingerprints passed over.

    A forest holds some links of a component; where one of them fails the similarity, another
    pair of that component, not in the forest, may pass it. Only such components are searched,
    between the groups found so far. First all texts of one meet its most central ones, whose
    shingles the others share most, round by round outside its largest group. This joins near
    copies of one text by a link each. What is still apart meets by prefix filter: alike sets
    share one of their rarest shingles, and a shingle's largest group isn't paired with itself.
    """
    bounds = materialize(components(near, "a", "b"), "near-components").toDF("key", "bound")
    broken = near.join(good, ["a", "b"], "left_anti").select(F.col("a").alias("key")).join(bounds, "key").select("bound").distinct()
    texts = materialize(bounds.join(broken, "bound", "left_semi").join(sets, "key").select("key", "bound", F.size("set").alias("n"), "set"), "split-components")
    grams = texts.select("key", "bound", F.explode("set").alias("w"))
    times = materialize(grams.groupBy("bound", "w").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared-shingles")
    counted = materialize(grams.join(times, ["bound", "w"]), "split-shingles")
    score = counted.groupBy("key").agg(F.sum("times").alias("score"))
    scored = texts.select("key", "bound", "n").join(score, "key", "left").select("key", "bound", "n", (F.coalesce("score", F.lit(0)) / F.col("n")).alias("score"))
    scored = materialize(scored.where("n > 0"), "central-texts")

    def members() -> DataFrame:
        now = scored.join(groups.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        apart = now.groupBy("bound").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("bound")
        return materialize(now.join(apart, "bound", "left_semi"), "members")

    for round_ in range(ROUNDS):
        now = members()
        open_ = now
        if round_:
            sizes = now.groupBy("bound", "root").count().groupBy("bound").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
            open_ = now.join(sizes, "bound").where("root != major").drop("major")
        rank = F.row_number().over(Window.partitionBy("bound").orderBy(F.desc("score"), "key"))
        hubs = open_.withColumn("rank", rank).where(F.col("rank") <= HUBS).drop("rank")
        more = alike(materialize(_pairs(now.drop("score"), hubs.drop("score"), ["bound"], least), "hub-pairs"), sets, least)
        good = materialize(good.unionAll(more), "alike-links")
        groups = materialize(components(good, "a", "b"), "alike-components")

    now = members().drop("score")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("times", "w"))
    # shingles of one text alone come first in its order and pair nothing
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("key"))
    ranked = counted.join(now, ["key", "bound"]).withColumns({"rank": rank, "alone": alone})
    rare = materialize(ranked.where(F.col("rank") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("key", "bound", "root", "n", "w", (F.col("n") - F.col("rank") - F.col("alone")).alias("after")), "rare-shingles")
    by_root = rare.groupBy("bound", "w", "root").agg(F.count(F.lit(1)).alias("times"))
    major = by_root.groupBy("bound", "w").agg(F.max_by("root", F.struct("times", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    held = materialize(rare.join(major, ["bound", "w"]), "rare-shared-shingles")
    once = (F.col("root_b") == F.col("major_b")) | (F.col("key_a") < F.col("key_b"))
    # at the first shingle that two texts share, what follows it bounds what they share in all
    enough = F.least("after_a", "after_b") + 1 >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9
    pairs = _pairs(held.where("root != major"), held, ["bound", "w"], least, once & enough)
    return good.unionAll(alike(materialize(pairs, "split-pairs"), sets, least))


def similar_groups(docs: DataFrame, radius: int, feature: int, shingle: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, key a hash of its text, and (key, group) of the texts that are like another.

    Two texts are linked if their sets of runs of `shingle` words have a Jaccard similarity of
    least or more and steps of at most radius bits, of either of two fingerprints, lead from one
    to the other. Fingerprints are of runs of `feature` words: fewer words change fewer of them an
    edit, so near copies come closer, and what one fingerprint misses the other mostly has. Null texts count as empty; all empty texts are linked.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, feature, second=True), "fingerprints")
    texts = materialize(rows.groupBy("key").agg(F.any_value("fp").alias("fp"), F.any_value("fp2").alias("fp2")), "distinct-texts")
    links = []
    for fp in ("fp", "fp2"):
        own = texts.select("key", F.col(fp).alias("fp"))
        heads = materialize(own.groupBy("fp").agg(F.min("key").alias("head")), "distinct-fingerprints")
        a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"key_{x}")) for x in "ab")
        between = linked(heads.select("fp"), radius).join(a, "a").join(b, "b")
        links.append(between.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")))
        links.append(own.join(heads, "fp").where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b")))
    near = materialize(reduce(DataFrame.unionAll, links).distinct(), "near-links")
    ends = near.select(F.col("a").alias("key")).unionAll(near.select("b")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    # copies of one text come together map by map before they meet the keys asked for
    firsts = rows.groupBy("key").agg(first.alias("first")).join(ends, "key", "left_semi").select(F.col("first.doc_id").alias("id"), "key")
    sets = materialize(shingle_sets(docs, materialize(firsts, "first-rows"), shingle, id_col, text_col), "shingle-sets")
    good = materialize(alike(near, sets, least), "alike-links")
    groups = materialize(components(good, "a", "b"), "alike-components")
    if good.count() < near.count():
        more = missed(near, good, groups, sets, least)
        groups = materialize(components(more, "a", "b"), "alike-components")
    return rows.select("doc_id", "key"), groups.toDF("key", "group")


def keep_one(docs: DataFrame, radius: int, feature: int, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar_groups: that of the smallest id, of ties the smallest text hash.

    A row with an id goes before one without; of repeated rows one stays. Columns are unchanged.
    """
    rows, groups = similar_groups(docs, radius, feature, shingle, least, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per_text = rows.groupBy("key").agg(F.min(order).alias("first"))
    first = per_text.join(groups, "key", "left").groupBy(F.coalesce("group", "key").alias("group")).agg(F.min("first").alias("first"))
    first = materialize(first.select(F.col("first.doc_id").alias("__brindle_id"), F.col("first.key").alias("__brindle_key")), "kept-rows")
    repeated = rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    keyed = docs.withColumn("__brindle_h", F.xxhash64(column(text_col)))
    kept = keyed.join(first, column(id_col).eqNullSafe(F.col("__brindle_id")) & (F.col("__brindle_h") == F.col("__brindle_key")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates([id_col, "__brindle_h"])
    return kept.select(*(column(c) for c in docs.columns))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
