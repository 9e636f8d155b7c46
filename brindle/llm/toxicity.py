"""Toxicity as maximum-scoring segments of token log-odds.

Tokens score by their log-odds under Dirichlet priors, from labelled documents; a linear scan
(Ruzzo and Tompa, 1999) finds all maximal segments of a text; extreme-value statistics
(Karlin and Altschul, 1990 and 1993) turn the segments' scores, and the length of the text
that they were picked from, into one significance, and a logistic link into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize, slices

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """docs_per_class bounds the labelled sample of each class that the model is fitted on."""

    docs_per_class: int = 8000
    prior: float = 5.0  # pseudo-documents of the Dirichlet priors
    drift: float = 1.5  # taken off every token's log-odds, so that clean text drifts down
    caution: float = 1.64  # standard errors of a token's log-odds that are held back, on either side
    stems: tuple[int, ...] = (4, 5, 6)
    stem_docs: int = 10  # toxic documents that a stem must be in to speak for unseen words
    stem_impurity: float = 0.02  # and its clean documents, as a share of those, at most
    threshold: float = 0.7
    shown_evalue: float = 0.5  # segments up to this E-value are given as passages


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    settings: Settings
    rate: float = 1.0  # Karlin-Altschul lambda
    size: float = 1e-3  # and K
    slope: float = 0.0
    offset: float = -30.0
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def score(self, word: str) -> float:
        """A token's log-odds less the drift; without evidence of its own, its stem's, else none."""
        if (s := self.words.get(word)) is None:
            s = next((x for n in reversed(self.settings.stems) if len(word) > n and (x := self.stems.get(word[:n]))), 0.0)
        s -= self.settings.drift
        if len(self.seen) > 150_000:
            self.seen.clear()
        self.seen[word] = s
        return s


def segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of (start, end, score) items, each once; linear time.

    Runs of negative items may be given as one item, which changes no maximal segment.
    """
    # each candidate: (start, end, total before it, total through it), with a link to the
    # nearest earlier candidate whose total before is smaller
    found: list[list] = []
    links: list[int] = []
    total = 0.0
    for start, end, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        item = [start, end, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = links[j]
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                links.append(j)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:], links[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def text_segments(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """(tokens, maximal segments as token ranges) of a whole text; every occurrence of every token scores."""
    words = WORD.findall(text.lower())
    seen, score = model.seen, model.score
    values = [seen[w] if w in seen else score(w) for w in words]
    items, last, gap = [], 0, 0.0
    for i, v in enumerate(values):
        if v > 0:
            if i > last:
                items.append((last, i, gap))
            items.append((i, i + 1, v))
            last, gap = i + 1, 0.0
        else:
            gap += v
    return len(words), segments(items)


def significance(n: int, scores: list[float], model: Model) -> float:
    """-ln of the chance of the best sum of the r best segments, over r."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += model.rate * s - math.log(max(model.size * n, 1e-12))
        if r == 1:
            # P = 1 - exp(-e^-x), in full where the approximation below is not yet good
            best = max(best, -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total)
        elif total > r:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def text_score(text: str, model: Model) -> tuple[float, int, list[tuple[int, int, float]]]:
    n, found = text_segments(text, model)
    x = significance(n, [s for *_, s in found], model) if found else 0.0
    z = model.slope * math.log1p(x) + model.offset
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), n, found


def passages(text: str, n: int, found: list[tuple[int, int, float]], model: Model) -> list[dict]:
    """Character ranges of the significant segments, with their E-values."""
    found = [(a, b, s, e) for a, b, s in found if (e := model.size * n * math.exp(-model.rate * s)) <= model.settings.shown_evalue]
    if not found:
        return []
    # lower() can change the length of a few letters' text; ranges are of the lower-cased text then
    at = [m.span() for m in WORD.finditer(text.lower())]
    return [{"start": at[a][0], "end": at[b - 1][1], "score": s, "evalue": e} for a, b, s, e in found]


def evidence(t: Column, c: Column, toxic: int, clean: int, settings: Settings) -> Column:
    """A term's log-odds under Dirichlet priors, moved towards zero by `caution` standard errors."""
    pooled = settings.prior / (toxic + clean)
    odds = F.log((t / F.lit(float(toxic)) + pooled) / (c / F.lit(float(clean)) + pooled))
    held = settings.caution / F.sqrt(F.greatest(F.lit(1.0), F.when(odds > 0, t).otherwise(c).cast("double")))
    return F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - held)


def _rate(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum p e^(lambda s) = 1 over a clean text's tokens; the rest score -drift."""
    s, p = np.append(scores - drift, -drift), np.append(shares, 0.0)
    p[-1] = max(0.05, 1 - p[:-1].sum())
    p /= p.sum()
    low, high = 1e-4, 5.0
    value = lambda x: float((p * np.exp(np.minimum(x * s, 500.0))).sum()) - 1
    if value(high) < 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset by Newton's method with step halving, the classes weighted alike."""
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    X, b, keep = np.stack([x, np.ones_like(x)], 1), np.zeros(2), ridge * np.array([1.0, 0.01])

    def loss(b: np.ndarray) -> float:
        z = X @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (keep * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -60, 60)))
        g = X.T @ (w * (p - y)) + keep * b
        step = np.linalg.solve((X * (w * p * (1 - p))[:, None]).T @ X + np.diag(keep), g)
        scale = 1.0
        while scale > 1e-6 and loss(b - scale * step) > loss(b):
            scale /= 2
        b = b - scale * step
        if scale <= 1e-6 or abs(scale * step).max() < 1e-9:
            break
    return float(max(b[0], 0.0)), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled docs; labels holds the ids to learn from (null ids and labels are left out).

    At most docs_per_class rows of each class, picked by a hash of the id, are read, whole;
    that bounds the broadcast list of ids, the terms with evidence, and what else reaches the
    driver, a few numbers a document. Equal texts count once. Without documents of both classes
    the model scores every text as clean.
    """
    ids = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    ids = ids.select("id", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    pick = [ids.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(settings.docs_per_class) for k in (0, 1)]
    sample = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where(F.col("text").isNotNull())
    sample = sample.join(F.broadcast(pick[0].unionAll(pick[1])), "id").select("y", "text").dropDuplicates(["text", "y"])
    sample = materialize(sample, "toxicity-sample")
    stems = settings.stems

    def count(batches):
        counts: Counter = Counter()
        occurrences: Counter = Counter()
        n = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                n[y] += 1
                tokens = WORD.findall(text.lower())
                words = set(tokens)
                if not y:
                    occurrences.update("w" + w for w in tokens)
                counts.update(("w" + w, y) for w in words)
                counts.update(("s" + p, y) for p in {w[:k] for w in words for k in stems if len(w) > k})
        counts["n", 0], counts["n", 1] = n
        terms = sorted({t for t, _ in counts})
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "t": pa.array([counts[t, 1] for t in terms], pa.int64()), "c": pa.array([counts[t, 0] for t in terms], pa.int64()), "k": pa.array([occurrences[t] for t in terms], pa.int64())})

    totals = sample.mapInArrow(count, "term string, t long, c long, k long").groupBy("term").agg(*(F.sum(x).alias(x) for x in ("t", "c", "k")))
    totals = materialize(totals, "toxicity-terms")
    n = totals.where("term = 'n'").first()
    if n is None or not n["t"] or not n["c"]:
        return Model({}, {}, settings)
    weight, stem = evidence(F.col("t"), F.col("c"), n["t"], n["c"], settings), F.col("term").startswith("s")
    # a term without evidence of its own stays on the executors: its tokens score by stem or drift
    told = (~stem & (F.col("w") != 0)) | (stem & (F.col("w") > settings.drift) & (F.col("t") >= settings.stem_docs) & (F.col("c") <= settings.stem_impurity * F.col("t")))
    rows = totals.where("term != 'n'").select("term", "k", weight.alias("w"), "t", "c").where(told).select("term", "k", "w").collect()
    model = Model({r[0][1:]: r[2] for r in rows if r[0][0] == "w"}, {r[0][1:]: r[2] for r in rows if r[0][0] == "s"}, settings)

    def scan(batches):
        for batch in batches:
            found = [text_segments(t, model) for t in batch.column("text").to_pylist()]
            best = [max((s for *_, s in x), default=0.0) for _, x in found]
            x = [significance(k, [s for *_, s in x], model) for k, x in found]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "n": pa.array([k for k, _ in found], pa.int64()), "s": pa.array(best, pa.float64()), "x": pa.array(x, pa.float64())})

    def scanned() -> list:
        return sorted(map(tuple, sample.mapInArrow(scan, "y int, n long, s double, x double").collect()))

    clean = [(k, s) for y, k, s, _ in scanned() if y == 0]
    tokens = max(1.0, sum(k for k, _ in clean))
    # words weigh by the documents that have them, but the scan meets every occurrence
    words = [(w, (k + 0.5) / tokens) for term, k, w in rows if term[0] == "w"]
    model.rate = _rate(np.array([w for w, _ in words]), np.array([p for _, p in words]), settings.drift)
    mean = sum(k * math.exp(-model.rate * s) for k, s in clean) / len(clean)
    model.size = 1 / max(mean, 1e-9)
    final = scanned()
    model.slope, model.offset = _logistic(np.log1p([x for *_, x in final]), np.array([float(y) for y, *_ in final]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", with_passages: bool = False) -> DataFrame:
    """docs with score, n_segments and, if asked for, passages (start, end, score, evalue).

    A null or empty text has no segment and so the lowest score. Texts are read whole. Repeated
    rows score alike. Columns of docs with the names of the new ones give way to them.
    """
    extra = {"score": "double", "n_segments": "int"} | ({"passages": "array<struct<start:int,end:int,score:double,evalue:double>>"} if with_passages else {})
    position = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches):
        for batch in slices(batches, position):
            texts = [t or "" for t in batch.column(position).to_pylist()]
            got = [text_score(t, model) for t in texts]
            out = [pa.array([s for s, *_ in got], pa.float64()), pa.array([len(f) for *_, f in got], pa.int32())]
            if with_passages:
                out.append(pa.array([passages(t, n, f, model) for t, (_, n, f) in zip(texts, got)], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *extra])

    return map_arrow(docs, run, extra)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those that score the model's threshold or more, columns unchanged.

    The rows are filtered where they are scored: no join, so ids may repeat or be null.
    """
    position = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, position):
            keep = pa.array([text_score(t or "", model)[0] < model.settings.threshold for t in batch.column(position).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return map_arrow(docs, run)
