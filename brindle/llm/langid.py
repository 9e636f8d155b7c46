"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of bitmasks stands for the filters of all languages: a slot holds, for each
language, its filter's bit. The AND of an n-gram's slots gives all languages that contain it
in one lookup. Each language's hits are counted over the whole text and corrected for its
filter's false-positive rate; the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize, slices

UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    """docs_per_lang bounds the sample that the filters are fitted on (expected documents of
    each language, whole texts). A filter takes every n-gram of the sample that occurs
    least_count times and meets least_share."""

    sizes: tuple[int, ...] = (3, 4)
    docs_per_lang: int = 1500
    least_count: int = 3
    least_share: float = 0.25  # of the largest relative frequency that any language has
    least_slots: int = 1 << 18
    slots_per_gram: int = 24  # of the largest filter, rounded up to a power of two
    probes: int = 3


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # slots (a power of two) x words of 64 languages
    settings: Settings
    prior: str = UNKNOWN
    prior_share: float = 0.0
    false_rates: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        fill = np.array([np.mean((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.langs))])
        self.false_rates = fill**self.settings.probes


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_hashes(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, index of its text, whether each text has a letter).

    N-grams are of lower-case letters, with one mark for what is not a letter at their ends;
    all positions of all texts count.
    """
    # \x00 between the texts is no letter, so no n-gram's inside crosses from one to the next
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts)
    code = np.frombuffer(("\0" + joined + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(code == 0) - 1
    letter = _is_letter()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    hashes, owners = [], []
    for n in sizes:
        if len(code) < n:
            continue
        last = len(code) - n + 1
        inside = np.ones(last, bool)
        for k in range(1, n - 1):
            inside &= letter[k : k + last]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ code[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[at + 1])
    has = np.zeros(len(texts) + 1, bool)
    has[owner[letter]] = True
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has[: len(texts)]
    return np.concatenate(hashes), np.concatenate(owners), has[: len(texts)]


def _probes(h: np.ndarray, slots: int, settings: Settings):
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(settings.probes):
        yield ((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def _pieces(texts: list[str], at_most: int = 2_000_000):
    """Runs of texts of a bounded number of characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > at_most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings = Settings()) -> Filters:
    """Filters from docs with a language; rows are sampled by a hash of the id.

    Counts of the languages and of the sample's n-grams are gathered; both are bounded, by
    the number of languages and by the sample.
    """
    labelled = docs.where(column(text_col).isNotNull() & column(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(column(lang_col)).count().collect()}
    if not counts:
        return Filters([], np.zeros((settings.least_slots, 1), np.uint64), settings)
    langs = sorted(counts)
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, settings.docs_per_lang / counts[lang])))))
    unit = F.shiftrightunsigned(F.xxhash64(column(id_col)), 11) / F.lit(float(1 << 53))
    sample = labelled.where(unit < share[column(lang_col)]).select(column(lang_col).alias("lang"), column(text_col).alias("text"))
    sizes = settings.sizes

    def count(batches):
        for batch in batches:
            of = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for lang in sorted(set(of)):
                own = texts[of == lang].tolist()
                for a, b in _pieces(own):
                    h, n = np.unique(gram_hashes(own[a:b], sizes)[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(h), pa.string()), "gram": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams.where(F.col("n") >= settings.least_count), "language-grams")
    # only what a filter will hold comes to the driver; the rule is applied where the counts are
    totals = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    if totals:
        total = F.create_map(*(x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(float(n)))))
        grams = grams.withColumn("share", F.col("n") / total[F.col("lang")])
        grams = grams.withColumn("largest", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= settings.least_share * F.col("largest"))
    entries = grams.select("lang", "gram").toPandas()
    own = {lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in entries.groupby("lang")}
    slots = max(settings.least_slots, 1 << (max((len(h) for h in own.values()), default=1) * settings.slots_per_gram - 1).bit_length())
    masks = np.zeros((slots, (len(langs) + 63) // 64), np.uint64)
    for i, lang in enumerate(langs):
        for slot in _probes(own.get(lang, np.zeros(0, np.uint64)), slots, settings):
            masks[slot, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    prior = min(langs, key=lambda lang: (-counts[lang], lang))
    return Filters(langs, masks, settings, prior, counts[prior] / sum(counts.values()))


def classify(texts: list[str], filters: Filters) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the winner's share of the corrected counts.

    A text without a letter, or with nothing learned, is `und` with score 0. Where no n-gram is
    known the language most often learned stands, with its share. Ties go to the first by name.
    """
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not filters.langs:
        return langs, scores
    for a, b in _pieces(texts):
        h, owner, has = gram_hashes(texts[a:b], filters.settings.sizes)
        mask = None
        for slot in _probes(h, len(filters.masks), filters.settings):
            mask = filters.masks[slot] if mask is None else mask & filters.masks[slot]
        n = np.bincount(owner, minlength=b - a).astype(float)
        hits = np.empty((b - a, len(filters.langs)))
        for i in range(len(filters.langs)):
            bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owner, weights=bit, minlength=b - a)
        f = filters.false_rates
        hits = np.maximum(0.0, (hits - n[:, None] * f) / np.maximum(1e-9, 1 - f))
        best, total = hits.argmax(1), hits.sum(1)
        for k in np.flatnonzero(has):
            langs[a + k] = filters.langs[best[k]] if total[k] > 0 else filters.prior
            scores[a + k] = float(hits[k, best[k]] / total[k]) if total[k] > 0 else filters.prior_share
    return langs, scores


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; texts are read whole, in Arrow batches.

    Repeated rows get equal answers; other columns pass through, but for ones of the names
    lang_pred and score, which give way to the answers. A null text is empty.
    """
    position = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, position):
            texts = [t or "" for t in batch.column(position).to_pylist()]
            langs, scores = classify(texts, filters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, run, {"lang_pred": "string", "score": "double"})
