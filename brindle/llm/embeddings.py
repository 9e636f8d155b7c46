"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector on random directions and orders the vectors of a label
lexicographically by the concatenated hashes; near vectors share a long prefix with good chance
and stand close together. Neighbours within a bounded window are compared, and verified pairs of
all passes are united. Every label goes through the passes, however small or dense. How many more
than the trial's it needs is measured: some of its vectors get a twin at the very threshold, and
the share of twins that the trial meets says how crowded the label is. An exact check follows for
every label: vectors that the passes left in different components are compared by blocks, so no
link depends on a window, on the number of passes or on a label's size. Within a component all
pairs are then counted exactly, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, written
from .components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    window: int = 24  # neighbours compared after each vector, a pass
    trial: int = 8  # passes that measure a label
    probes: int = 256  # vectors of a label that get a twin, about
    recall: float = 0.999  # of pairs at the threshold, by the twins met; sets the passes
    width: float = 0.8  # of a hash's cell on a random direction
    most_side: int = 16384  # vectors a side of one block of the search by blocks, at most
    most_block: int = 1024  # vectors a side of one block of the exact count, at most
    tile: int = 256  # vectors whose products with a whole side are held at once
    seed: int = 20


def unit(vectors: list) -> np.ndarray:
    """Unit rows in double precision, scaled first so that squares neither overflow nor vanish."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(binary, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.float64).reshape(-1, dim)


def forest(x: np.ndarray, y: np.ndarray | None, root: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """Links between the rows of x and y, or among those of x, thinned to a forest of them.

    Rows of y are numbered on from those of x. Which pairs link is exact. Rows of equal root are
    joined already, and none of their links is given.
    """
    to = x if y is None else y
    every, first = (x, 0) if y is None else (np.concatenate([x, y]), len(x))
    # products in single precision err by less than this
    slack = 2.0**-22 * (x.shape[1] + 8)
    low, narrow = np.float32(settings.threshold - slack), to.astype(np.float32).T
    root, out = root.copy(), []
    for at in range(0, len(x), settings.tile):
        hits = x[at : at + settings.tile].astype(np.float32) @ narrow >= low
        if y is None:
            hits[np.arange(len(hits)), np.arange(at, at + len(hits))] = False
        for r in np.flatnonzero(hits.any(1)).tolist():
            i, j = at + r, np.flatnonzero(hits[r]) + first
            j = j[root[j] != root[i]]
            j = j[np.einsum("j,ij->i", x[i], every[j]) >= settings.threshold]
            if len(j):
                groups, one = np.unique(root[j], return_index=True)
                out += [(i, k) for k in j[one].tolist()]
                root[np.isin(root, groups)] = root[i]
    return out


def _vectors(df: DataFrame) -> DataFrame:
    """Adds dim and unit, the vector's unit form as bytes of doubles."""
    names = [c for c in df.columns if c != "embedding"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "embedding") + ", dim int, unit binary"

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors], np.int32)
            out: list = [None] * len(vectors)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i, row in zip(at, unit([vectors[i] for i in at])):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(dims), pa.array(out, pa.binary())], names=[*names, "dim", "unit"])

    return df.mapInArrow(run, schema)


#: Hashes of 4 bits in a sort key, the slack of a cosine in half precision, and the numbers of
#: passes that a label may get; one that needs more has the trial's and the exact check.
HASHES, SLACK, STEPS = 16, 2.0**-9, tuple(sorted({int(2 ** (k / 4)) for k in range(12, 53)}))


def sort_keys(x: np.ndarray, dim: int, number: int, settings: Settings) -> np.ndarray:
    """Concatenated hashes of each row: cells of random directions, the first one highest."""
    rng = np.random.default_rng([settings.seed, number, dim])
    planes, shift = rng.standard_normal((dim, HASHES)), rng.random(HASHES)
    cells = np.clip(np.floor(x @ planes / settings.width + shift) + 8, 0, 15).astype(np.uint64)
    key = np.zeros(len(x), np.uint64)
    for k in range(HASHES):
        key = key << np.uint64(4) | cells[:, k]
    # the highest bit is turned so that signed order is the order of the hashes
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def window_pairs(rows: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, sure, label_id, dim): pairs that stand within a window in some pass.

    rows: (cid, label_id, dim, unit, low, high, probe); passes low to high - 1 are made. Rows are
    dealt by ranges of the sort order, so no label or dense region meets in one task, and a task
    streams its sorted rows and holds a batch and one window. Pairs that half precision shows to
    link are sure, thinned to forests where they were found; those that it cannot tell are given
    all. A row with null a says that the twin b of a probe stood in the window.
    """
    window, threshold, seed = settings.window, settings.threshold, settings.seed

    def project(batches):
        for batch in batches:
            low, high, dims = (batch.column(c).to_numpy() for c in ("low", "high", "dim"))
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            binary = np.array(batch.column("unit").to_pylist(), object)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = _rows(binary[own], d)
                picked = np.flatnonzero(probe[own])
                if len(picked):
                    # a twin lies at the threshold, in a direction of its own
                    away = np.random.default_rng([seed, d, len(picked)]).standard_normal((len(picked), d))
                    away -= (away * x[picked]).sum(1, keepdims=True) * x[picked]
                    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-12)
                    x = np.concatenate([x, threshold * x[picked] + np.sqrt(1 - threshold**2) * away])
                at, twin = np.concatenate([own, own[picked]]), np.repeat([False, True], [len(own), len(picked)])
                half = x.astype(np.float16)
                for number in range(int(low[own].min()), int(high[own].max())):
                    now = np.flatnonzero((low[at] <= number) & (number < high[at]))
                    if not len(now):
                        continue
                    given = batch.select(["cid", "label_id", "dim"]).take(pa.array(at[now]))
                    columns = [*given.columns, pa.array(np.full(len(now), number, np.int32)), pa.array(sort_keys(x[now], d, number, settings)), pa.array(twin[now]), pa.array([v.tobytes() for v in half[now]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["cid", "label_id", "dim", "pass", "key", "twin", "half"])

    dealt = rows.mapInArrow(project, "cid long, label_id long, dim int, pass int, key long, twin boolean, half binary")
    order = ["label_id", "dim", "pass", "key", "cid", "twin"]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None and held.num_rows and batch.num_rows else batch
            n, old = rows.num_rows, rows.num_rows - batch.num_rows
            if not n:
                continue
            ids = np.stack([rows.column(p).to_numpy().astype(np.int64) for p in ("label_id", "dim", "pass")], 1)
            group = np.cumsum(np.append(0, (ids[1:] != ids[:-1]).any(1)))
            cid, twin = rows.column("cid").to_numpy(), rows.column("twin").to_numpy(zero_copy_only=False)
            binary = np.array(rows.column("half").to_pylist(), object)
            a, b, sure = [], [], []
            root = np.arange(n)
            for d in np.unique(ids[:, 1]).tolist():
                at = np.flatnonzero(ids[:, 1] == d)
                x, g, t = np.frombuffer(b"".join(binary[at]), np.float16).reshape(-1, d).astype(np.float32), group[at], twin[at]
                for s in range(1, min(window + 1, len(at))):
                    # pairs of held rows were compared with the batch before
                    i = np.flatnonzero((g[s:] == g[:-s]) & (at[s:] >= old))
                    met = i[(cid[at[i]] == cid[at[i + s]]) & (t[i] != t[i + s])]
                    a += [None] * len(met)
                    b += cid[at[met]].tolist()
                    sure += [False] * len(met)
                    i = i[~t[i] & ~t[i + s]]
                    near = np.einsum("ij,ij->i", x[i], x[i + s])
                    i, near = i[near >= threshold - SLACK], near[near >= threshold - SLACK]
                    for j, c in zip(i.tolist(), near.tolist()):
                        p, q = at[j], at[j + s]
                        if c >= threshold + SLACK:
                            while root[p] != p:
                                root[p] = p = root[root[p]]
                            while root[q] != q:
                                root[q] = q = root[root[q]]
                            if p == q:
                                continue
                            root[max(p, q)] = min(p, q)
                        a.append(int(cid[at[j]]))
                        b.append(int(cid[at[j + s]]))
                        sure.append(c >= threshold + SLACK)
            where = {int(c): k for k, c in enumerate(cid)} if a else {}
            of = ids[[where[c] for c in b]] if b else ids[:0]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_()), pa.array(of[:, 0]), pa.array(of[:, 1].astype(np.int32))], names=["a", "b", "sure", "label_id", "dim"])
            held = rows.slice(max(0, n - window))

    return dealt.mapInArrow(compare, "a long, b long, sure boolean, label_id long, dim int")


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose vectors have a cosine of threshold or more in double precision."""
    a, b = (classes.select(F.col("cid").alias(x), F.col("unit").alias(f"unit_{x}")) for x in "ab")

    def check(batches):
        for batch in batches:
            # the same sum as in the count, so that a pair at the very threshold is told alike
            both = zip(batch.column("unit_a").to_pylist(), batch.column("unit_b").to_pylist())
            near = [bool(np.einsum("j,ij->i", np.frombuffer(x), np.frombuffer(y)[None])[0] >= threshold) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(check, "a long, b long")


def passes_needed(met: DataFrame, settings: Settings) -> DataFrame:
    """(label_id, dim, passes) from (label_id, dim, hits), a row a probe: how many trial passes met its twin.

    A twin met h times in t passes is taken to be met in one with chance (h + 1/2) / (t + 1); the
    passes are the first of STEPS after which the mean chance of being missed in all is small
    enough, and null if none is.
    """
    t = settings.trial
    counts = met.groupBy("label_id", "dim").agg(F.count(F.lit(1)).alias("m"), *(F.count_if(F.col("hits") == h).alias(f"h{h}") for h in range(t + 1)))
    missed = lambda k: reduce(lambda x, y: x + y, (F.col(f"h{h}") * F.pow(F.lit(1 - (h + 0.5) / (t + 1)), k) for h in range(t + 1)))
    fit = F.filter(F.array(*(F.lit(k) for k in STEPS)), lambda k: missed(k) <= (1 - settings.recall) * F.col("m"))
    return counts.select("label_id", "dim", F.get(fit, F.lit(0)).alias("passes"))


def window_links(m: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links that window passes find, verified, thinned to forests where they were found.

    m: (cid, label_id, dim, unit). Every label gets the trial's passes. One gets as many more as
    its twins say, unless the windows would then compare each vector with as many others as
    there are: the exact check that follows costs no more.
    """
    by, w = ["label_id", "dim"], settings.window
    sizes = materialize(m.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "label-sizes")
    share = F.shiftrightunsigned(F.xxhash64("cid", F.lit(settings.seed)), 11) / F.lit(float(1 << 53))
    # a label that more passes cannot serve needs no twins
    probe = (F.col("n") > 2 * w * settings.trial) & (share < settings.probes / F.col("n"))
    tried = materialize(m.join(sizes, by).withColumn("probe", probe), "tried-vectors")
    first = materialize(window_pairs(tried.withColumns({"low": F.lit(0), "high": F.lit(settings.trial)}), settings), "trial-pairs")
    hits = first.where("a is null").groupBy(F.col("b").alias("cid")).count()
    met = tried.where("probe").select("cid", *by).join(hits, "cid", "left").select(*by, F.least(F.coalesce("count", F.lit(0)), F.lit(settings.trial)).alias("hits"))
    plan = sizes.join(passes_needed(met, settings), by).where((F.col("passes") > settings.trial) & (2 * w * F.col("passes") < F.col("n")))
    go_on = materialize(plan.select(*by, F.lit(settings.trial).alias("low"), F.col("passes").alias("high")), "label-plans")
    found = [first.where("a is not null")]
    if not go_on.isEmpty():
        more = window_pairs(tried.withColumn("probe", F.lit(False)).drop("n").join(go_on, by), settings)
        found.append(materialize(more, "window-pairs"))
    pairs = reduce(DataFrame.unionAll, found)
    open_ = pairs.where("not sure").select("a", "b").distinct()
    return pairs.where("sure").select("a", "b").unionAll(verified(open_, m, settings.threshold)).distinct()


def links(classes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b) of classes: links that join all that link, found by window passes and an exact check.

    classes: (cid, label, dim, unit). Labels of every size and density go the same way.
    """
    # labels travel as a hash beside the exact comparison that the class ids stand for
    m = classes.select("cid", F.xxhash64("label").alias("label_id"), "dim", "unit")
    mark = written(m.sparkSession)
    found = materialize(window_links(m, settings), "window-links")
    release(m.sparkSession, mark, keep=1)
    return found.unionAll(missed_links(m, components(found, "a", "b"), settings))


def block_links(m: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): links by blocks alone, without a pass. No query calls it; tests hold links against it."""
    return missed_links(m, m.select(F.col("cid").alias("node"), F.col("cid").alias("root")), settings)


def missed_links(m: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links that join all that link but has different roots, thinned to forests where they were found.

    m: (cid, label_id, dim, unit); found: (node, root), a vector without a row is alone. Finds
    every such link. A label's n vectors are cut in blocks of about 16 times the root of n,
    most_side at most, and each pair of blocks is one group of bounded size; so no label meets in
    one task. The pairs compared grow with the square of a label's vectors.
    """
    side = F.least(F.lit(float(settings.most_side)), 16 * F.sqrt(F.count(F.lit(1))))
    nb, n = F.ceil(F.count(F.lit(1)) / side).cast("int").alias("nb"), F.count(F.lit(1)).alias("n")
    sizes = materialize(m.groupBy("label_id", "dim").agg(nb, n).where("n > 1").drop("n"), "label-blocks")
    m = m.join(found, m["cid"] == found["node"], "left").select("cid", "label_id", "dim", "unit", F.coalesce("root", "cid").alias("root"))
    m = m.join(sizes, ["label_id", "dim"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    parts = ["label_id", "dim", "q", "t"]
    m = m.select("label_id", "dim", F.least("own", "other").alias("q"), F.greatest("own", "other").alias("t"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "root", "unit")
    m = m.repartition(*parts).sortWithinPartitions(*parts, "side", "cid")

    def compare(batches):
        held, before = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(p).to_numpy().astype(np.int64) for p in parts], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and not np.array_equal(before, ids[a]):
                    yield group(held)
                    held = []
                held.append(batch.slice(a, b - a))
                before = ids[a]
        if held:
            yield group(held)

    def group(batches):
        rows = pa.Table.from_batches(batches)
        cid, side = rows.column("cid").to_numpy(), rows.column("side").to_numpy()
        q, t = int(rows.column("q")[0].as_py()), int(rows.column("t")[0].as_py())
        x = _rows(rows.column("unit").to_pylist(), int(rows.column("dim")[0].as_py()))
        n, root = int((side == 0).sum()), np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        links = [] if q != t and n in (0, len(x)) else forest(x, None, root, settings) if q == t else forest(x[:n], x[n:], root, settings)
        ends = cid[np.array(links, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_pydict({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return m.mapInArrow(compare, "a long, b long")


def count_links(members: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(cid, n): vectors of other classes in the same component at the threshold or more.

    members: (root, cid, dim, mult, unit). A component of m is cut in blocks of about four times
    the root of m, so that small ones spread over tasks too and a large one's copies grow with
    m to the power 1.5 until blocks are full; each pair of blocks is one group of bounded size.
    """
    side = F.least(F.lit(float(settings.most_block)), 4 * F.sqrt(F.count(F.lit(1))))
    sizes = materialize(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("nb")), "component-blocks")
    m = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    sides = F.array(F.lit(0), F.lit(1))
    m = m.select("root", "cid", "mult", "dim", "unit", "own", "nb", F.explode(sides).alias("side"))
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    q, t = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    m = m.select("root", q.alias("q"), t.alias("t"), "side", "cid", "mult", "dim", "unit")
    m = m.repartition("root", "q", "t").sortWithinPartitions("root", "q", "t", "side", "cid")
    threshold = settings.threshold

    def count(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None and held.num_rows else batch
            if not rows.num_rows:
                continue
            ids = np.stack([rows.column(p).to_numpy().astype(np.int64) for p in ("root", "q", "t")], 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            end = int(cuts[-1]) if len(cuts) else 0
            if end:
                yield groups(rows.slice(0, end), np.append(0, cuts))
            held = rows.slice(end)
        if held is not None and held.num_rows:
            yield groups(held, np.array([0, held.num_rows]))

    def groups(rows, cuts):
        side, cid, mult, dim = (rows.column(c).to_numpy() for c in ("side", "cid", "mult", "dim"))
        binary = rows.column("unit").to_pylist()
        out_cid, out_n = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = _rows(binary[a:b], int(dim[a]))
            q, t = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            if not len(q) or not len(t):
                continue
            # the same sum as in the search, so that a pair at the very threshold counts alike
            near = np.stack([np.einsum("j,ij->i", x[i], x[t]) for i in q]) >= threshold
            near &= cid[a:b][q][:, None] != cid[a:b][t][None, :]
            out_cid.append(cid[a:b][q])
            out_n.append(near @ mult[a:b][t])
        empty = np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({"cid": pa.array(np.concatenate([empty, *out_cid])), "n": pa.array(np.concatenate([empty, *out_n]))})

    return m.mapInArrow(count, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    rows: (vec_id, embedding, label). Vectors that are null, zero or hold null or non-finite
    components, and those without a label, link with nothing; so do vectors of unequal length.
    Equal vectors of a label collapse to one class before any pass, and count with their
    number. Repeated rows count as vectors of their own; a null vec_id is kept and is the id of
    a component only if it has no other. kept: vec_id equals component_id.
    """
    rows = rows.select("vec_id", "embedding", "label")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = materialize(_vectors(classes.withColumn("cid", F.monotonically_increasing_id()).select("cid", "label", "rep", "mult", "embedding", F.xxhash64("embedding").alias("hash"))), "vector-classes")
    found = materialize(components(links(classes, settings), "a", "b"), "vector-components")
    members = materialize(classes.join(found, classes["cid"] == found["node"]).select("root", "cid", "rep", "mult", "dim", "unit"), "members")
    least = materialize(members.groupBy("root").agg(F.min("rep").alias("least")), "component-ids")
    linked = members.select("cid", "root").join(least, "root").select("cid", "least").join(count_links(members, settings), "cid", "left")
    linked = materialize(linked, "linked-classes")
    info = classes.select("cid", "label", "unit", "hash", "rep", "mult").join(linked, "cid", "left")
    info = info.select("label", "unit", "hash", F.coalesce("least", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"))
    info = materialize(info.select("label", "hash", "component", "links"), "class-answers")
    # equal vectors have equal hashes; a class is told by its label and a 64-bit hash of its vector
    keyed = rows.withColumn("hash", F.when(valid, F.xxhash64("embedding")))
    out = keyed.join(info, ["label", "hash"], "left")
    component = F.when(valid, F.col("component")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
