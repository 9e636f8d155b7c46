"""Packing of documents into token sequences by lexical retrieval.

Documents are dealt to shards of bounded size by their lexical content: the nearest of the
centres of a sample's weighted terms, so that related documents share a shard. Each shard holds
a BM25 inverted index over its documents' token ids, with its own collection statistics, as the
shards of a search cluster do; every document is in one index. A seed is scored with all its
terms. A seed document opens a sequence, its unused BM25
neighbours fill it, best first, and the last one is cut where the sequence is full; what is
left of it seeds the next. Only a shard's last sequence can have room left.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_content
from .common import bounded_batches, column, materialize, slices, tidy, worker_cache
from .wordtable import WordTable


@dataclass(frozen=True)
class Settings:
    length: int = 4096
    end_id: int = 2
    shard_bytes: int = 4_000_000  # of text, on average
    task_bytes: int = 48_000_000  # of text that one task packs, shard by shard, on average
    neighbours: int = 48  # asked for at once; asked again while there is room
    k1: float = 1.2
    b: float = 0.75
    features: int = 64  # of the weighted terms' random projection
    sampled: int = 16  # documents a shard that the centres are found from
    least_sampled: int = 2048
    most_centres: int = 8192
    rounds: int = 8
    seed: int = 20


@dataclass
class Router:
    """Centres of lexical content, and the shards of each: parts[i] of them from first[i] on."""

    idf: np.ndarray
    centres: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    settings: Settings

    def shards(self, docs: list[np.ndarray], spread: np.ndarray) -> np.ndarray:
        leaf = nearest(features(docs, self.idf, self.settings), self.centres)
        return self.first[leaf] + spread % self.parts[leaf]


def features(docs: list[np.ndarray], idf: np.ndarray, settings: Settings) -> np.ndarray:
    """Unit vectors of the documents' weighted terms, projected at random."""
    size, seed = settings.features, settings.seed
    planes = worker_cache(f"pack_planes_{size}_{seed}", lambda: np.random.default_rng(seed).standard_normal((1 << 16, size), np.float32))
    out = np.zeros((len(docs), size), np.float32)
    for i, ids in enumerate(docs):
        term, count = np.unique(ids, return_counts=True)
        v = (np.log1p(count).astype(np.float32) * idf[term]) @ planes[term]
        out[i] = v / max(float(np.sqrt(v @ v)), 1e-12)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(x), 1024))])


def route(x: np.ndarray, mass: np.ndarray, idf: np.ndarray, shards: int, settings: Settings) -> Router:
    """Spherical k-means; centres too light for a shard share one with those next to them."""
    k = min(shards, settings.most_centres, len(x))
    rng = np.random.default_rng(settings.seed)
    picks, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(picks) < k:  # the next centre is far from those there are, by the square of its distance
        far = np.minimum(far, np.square(np.clip(1 - x @ x[picks[-1]], 0, None), dtype=np.float64))
        if far.sum() <= 0:
            break
        picks.append(int(rng.choice(len(x), p=far / far.sum())))
    centres, k = x[picks], len(picks)
    for _ in range(settings.rounds):
        leaf = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, leaf, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
    share = np.bincount(nearest(x, centres), mass, k) * shards / max(mass.sum(), 1e-9)
    first, parts = np.zeros(k, np.int64), np.ones(k, np.int64)
    left, at, used, group, total = np.ones(k, bool), 0, 0, [], 0.0
    for _ in range(k):
        left[at] = False
        group.append(at)
        total += share[at]
        if total >= 0.9 or not left.any():
            first[group], parts[group] = used, max(1, round(total))
            used, group, total = used + max(1, round(total)), [], 0.0
        at = int(np.where(left, centres @ centres[at], -np.inf).argmax())
    return Router(idf, centres, first, parts, settings)


def fit_router(docs: DataFrame, shards: int, n: int, path: str | None, settings: Settings, id_col: str, text_col: str) -> Router | None:
    """A router from a sample picked by a hash of id and text; it bounds what reaches the driver."""
    if shards < 2:
        return None
    want = max(settings.least_sampled, settings.sampled * min(shards, settings.most_centres))
    picked = F.pmod(F.xxhash64(F.lit("sample"), column(id_col), column(text_col)), F.lit(1 << 30)) < int(min(1.0, want / max(1, n)) * (1 << 30))
    sample = materialize(tokenize(docs.where(picked), None, path, settings, id_col, text_col).select("ids"), "pack-sample")

    def count(batches):
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                df[np.unique(np.frombuffer(ids, "<u2"))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "n": pa.array(df[at])})

    df, size = np.zeros(1 << 16), sample.count()
    if not size:
        return None
    for term, c in sample.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = c
    idf = np.log1p((size - df + 0.5) / (df + 0.5)).astype(np.float32)

    def project(batches):
        for batch in batches:
            own = [np.frombuffer(ids, "<u2") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"v": pa.array([v.tobytes() for v in features(own, idf, settings)], pa.binary()), "m": pa.array([float(len(x)) for x in own], pa.float64())})

    rows = sorted((bytes(v), m) for v, m in sample.mapInArrow(project, "v binary, m double").collect())
    x = np.frombuffer(b"".join(v for v, _ in rows), np.float32).reshape(-1, settings.features)
    return route(x, np.array([m for _, m in rows]), idf, shards, settings)


def tokenize(docs: DataFrame, router: Router | None, path: str | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, ids): ids as bytes of unsigned 16-bit numbers."""
    bounded_batches(docs.sparkSession)
    df = docs.select(column(id_col).alias("doc_id"), F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(1 << 31)).alias("spread"), column(text_col).alias("text"))
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_content(path))
    name = "pack_" + hashlib.sha256(content.value.encode()).hexdigest()[:16]
    routes = docs.sparkSession.sparkContext.broadcast(router)
    kind = df.schema["doc_id"].dataType.simpleString()
    end = np.array([settings.end_id], "<u2").tobytes()

    def run(batches):
        table = worker_cache(name, lambda: WordTable(content.value))
        for batch in slices(batches, 2, 500_000, keep="pack_"):
            found = [ids.astype("<u2") for ids in table.ids([t or "" for t in batch.column("text").to_pylist()])]
            out = [ids.tobytes() + end for ids in found]
            shard = np.zeros(len(out), np.int64) if routes.value is None else routes.value.shards(found, batch.column("spread").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard), pa.array(out, pa.binary())], names=["doc_id", "shard", "ids"])

    return df.mapInArrow(run, f"doc_id {kind}, shard long, ids binary")


class Index:
    """BM25 over token ids, as postings sorted by term."""

    def __init__(self, docs: list[np.ndarray], settings: Settings):
        n = len(docs)
        terms, counts, sizes = [], [], np.zeros(n, np.int64)
        for i, ids in enumerate(docs):
            ordered = np.sort(ids, kind="stable")  # radix sort for 16-bit ids
            at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            terms.append(ordered[at])
            counts.append(np.diff(np.append(at, len(ordered))))
            sizes[i] = len(at)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        doc = np.repeat(np.arange(n), sizes)
        lengths = np.array([len(d) for d in docs], np.float64)
        df = np.bincount(term)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        k1, b = settings.k1, settings.b
        weight = self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / lengths.mean()))
        self.own = np.append(0, np.cumsum(sizes))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.append(0, np.cumsum(df))
        self.n, self.settings = n, settings

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, of ties the first."""
        own = slice(self.own[seed], self.own[seed + 1])
        scores = np.zeros(self.n)
        for t in self.terms[own].tolist():
            at = slice(self.start[t], self.start[t + 1])
            # a document stands once in a term's postings, so plain indexing adds each weight
            scores[self.doc[at]] += self.weight[at]
        scores *= unused
        k = self.settings.neighbours
        best = np.argpartition(-scores, k)[:k] if k < self.n else np.arange(self.n)
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))]


def pack_shard(docs: list[np.ndarray], settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; greedy over one shard."""
    index, room = Index(docs, settings), settings.length
    unused, placed = np.ones(len(docs), bool), []
    state = {"sequence": 0, "offset": 0}

    def put(doc: int, start: int) -> int:
        """Places what fits of the document and returns the new start."""
        take = min(len(docs[doc]) - start, room - state["offset"])
        placed.append((doc, start, take, state["sequence"], state["offset"]))
        state["offset"] += take
        return start + take

    def close() -> None:
        if state["offset"] == room:
            state["sequence"], state["offset"] = state["sequence"] + 1, 0

    seed, start, scan = 0, 0, 0
    while True:
        if seed is None:
            while scan < len(docs) and not unused[scan]:
                scan += 1
            if scan == len(docs):
                return placed
            seed, start = scan, 0
        unused[seed] = False
        start = put(seed, start)
        close()
        while start < len(docs[seed]):
            start = put(seed, start)
            close()
        if not state["offset"]:
            seed = None
            continue
        following = None
        while following is None and state["offset"]:
            found = index.neighbours(seed, unused)
            if not len(found):
                break
            for d in found.tolist():
                unused[d] = False
                at = put(d, 0)
                close()
                if not state["offset"]:
                    following = (d, at) if at < len(docs[d]) else (None, 0)
                    break
        # without neighbours the next unused document goes on in the same sequence
        seed, start = following or (None, 0)


def pack(docs: DataFrame, path: str | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and packs as its end mark alone. Every row is packed, repeated rows
    each for itself. Shards follow the documents' lexical content, and a hash of id and text where
    one centre fills several; a document of any length is in one shard.
    """
    size, n = docs.agg(F.sum(F.octet_length(column(text_col))), F.count(F.lit(1))).first()
    router = fit_router(docs, max(1, round((size or 0) / settings.shard_bytes)), n, path, settings, id_col, text_col)
    tokens = tokenize(docs, router, path, settings, id_col, text_col)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def shard(table: pa.Table) -> pa.Table:
        tidy()  # of the tokenizer's tables and the shard before
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        which = table.column("shard")[0].as_py()
        docs = [np.frombuffer(ids, "<u2") for _, ids in rows]
        placed = pack_shard(docs, settings)
        d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*placed))
        crc = np.array([zlib.crc32(docs[i][a : a + n].astype("<u4").tobytes()) for i, a, n, *_ in placed], np.int64)
        ids = pa.array([rows[i][0] for i in d.tolist()], table.schema.field("doc_id").type)
        return pa.table({"doc_id": ids, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": np.array([len(x) for x in docs], np.int64)[d], "sequence_id": (which << 32) + sequence, "offset": offset})

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // settings.task_bytes))
    return tokens.repartition(tasks, "shard").groupBy("shard").applyInArrow(shard, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
