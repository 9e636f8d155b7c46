"""Personal data by weak supervision.

Base spans come from fixed patterns and their checks. Beside them, looser candidates and all
base matches, passed or failed, are put to labelers (pattern, gazetteer or checksum, context,
boundary, shape) that vote yes, no or nothing. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability by kind; a logistic span classifier is then
trained on the estimated labels, with features of its own. It adds candidates that lie outside
the base spans.

Main path: DataFrame functions only. What reaches the driver are counts of patterns of votes and
features, whose number is bounded by their combinations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, materialize, running

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that Java's matcher neither backtracks nor starts again inside
# a run that has failed as a whole; their matches are those of
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+                                  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser or tighter forms that the base patterns miss: swallowed by a longer match, or disguised.
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++(?:@|\x20?(?:\[at\]|\(at\))\x20?)[\p{L}\p{N}-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20.-]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])",
}

#: No pattern above matches a text without one of these.
TRIGGER = r"[0-9@]|\[at\]|\(at\)"

CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write to|reach)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|from)[^\n]{0,8}$",
    "card": r"(?i)(?:card|visa|master|amex|karte|carte|tarjeta|payment)[^\n]{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|cell|telefon|appel)[^\n]{0,12}$",
}
AGAINST = r"(?i)(?:\bversion|\bv|\bsection|\bchapter|\bisbn|\border|\binvoice|\bserial|\bsku|#)[.: ]{0,2}$"
#: Top-level domains: two letters are a country's, these are for all.
TLDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "dev", "app", "online", "cloud", "email", "tech", "site", "store", "blog", "example", "test")
#: Country calling codes by the numbering plan: zones of one digit, the codes of two digits, and
#: first two digits that all codes of three digits share.
CALLING = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-69]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9]"
LABELERS = ("pattern", "gazetteer", "context", "boundary", "shape")


@dataclass(frozen=True)
class Settings:
    accuracy: float = 0.8  # of a labeler that votes, before any data
    weight: float = 10.0  # pseudo-votes that stand behind it
    rounds: int = 60
    ridge: float = 0.1
    least: float = 0.9  # probability from which a candidate is added


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(ds: Column) -> Column:
        twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        one = F.transform(ds, lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, twice(d)).otherwise(d)))
        return F.aggregate(one, F.lit(0), lambda a, x: a + x)

    return let(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), total) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    low, high = (12, 19) if kind == "card" else (9, 15)

    def check(d: Column) -> Column:
        fits = F.length(d).between(low, high)
        return F.when(fits, luhn(d)).otherwise(F.lit(False)) if kind == "card" else fits

    return let(digits(m), check)


def by(kind: str, f):
    """f for spans of one kind."""
    return lambda s: f(kind, s)


_SPAN = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, and 24 characters before and one after."""
    # the gaps between matches give the places: no built-in returns them
    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
            zero = F.lit(0).cast("long")
            starts = running(steps, zero, lambda a, b: a + b)

            def build(at: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    start = F.get(at, i) + F.length(F.get(gaps, i))
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

                return F.transform(found, one)

            return let(starts, build)

        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def masked(text: Column, spans: Column) -> Column:
    """The text with sorted spans overwritten by as many bars; its length stays."""
    return rebuild(text, spans, lambda s: F.repeat(F.lit("\x01"), (s["end"] - s["start"]).cast("int")))


def rebuild(text: Column, spans: Column, put) -> Column:
    """The text with each of its spans, sorted by start, replaced; overlaps go with the first."""
    zero = F.lit(0).cast("long")

    def join(from_: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.get(from_, i)
            return F.when(s["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), put(s))).otherwise(F.lit(""))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), zero, lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(let(ends, join))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)) if no is not None else F.lit(False), -1).otherwise(0)


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a span, in the order of LABELERS."""
    m, before, after = s["m"], s["before"], s["after"]
    plain = F.regexp_replace(F.regexp_replace(m, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(](?:dot|\.)[\])]\x20?|\[?\.\]?", ".")
    n = F.length(digits(m))
    if kind == "email":
        pattern = _vote(plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), ~plain.rlike(r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+$"))
        gazetteer = _vote(F.lower(F.element_at(F.split(plain, r"\."), -1)).rlike("^(?:[a-z]{2}|" + "|".join(TLDS) + ")$"))
        shape = _vote(~m.contains(" "), F.length(m) > 254)
    elif kind == "ip":
        pattern = _vote(passes("ip", plain), ~passes("ip", plain))
        gazetteer = _vote(~plain.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), plain.rlike(r"^0\."))
        shape = _vote(~plain.rlike(r"(?:^|\.)0[0-9]"), plain.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        pattern = _vote(n.between(13, 19), (n < 12) | (n > 19))
        gazetteer = F.when(n.between(12, 19), F.when(luhn(digits(m)), 1).otherwise(-1)).otherwise(-1)
        shape = _vote(m.rlike(r"^[0-9]{15,16}$|^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$"), m.rlike(r"[0-9]{20}|(?:^|[\x20-])[0-9]{1,2}[\x20-]"))
    else:
        pattern = _vote(m.startswith("+") & n.between(9, 15), (n < 9) | (n > 15))
        gazetteer = _vote(F.regexp_extract(m, r"^\+?([0-9]+)", 1).rlike(f"^(?:{CALLING})"), m.startswith("+0"))
        shape = _vote(m.rlike(r"[\x20().-]") & ~m.rlike(r"[\x20.-]{2}"), m.rlike(r"[0-9]{16}"))
    context = _vote(before.rlike(CONTEXT[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST))
    boundary = _vote(~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"^[\p{L}\p{N}_]"), before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]"))
    return [pattern, gazetteer, context, boundary, shape]


#: What the span classifier sees of a span beside the votes, as small numbers: how long it is, how
#: many digits it has, how its parts are set off, how many distinct digits, and what stands around.
FEATURES = {"length": 5, "digits": 5, "marks": 4, "distinct": 4, "left": 4, "right": 4}


def features(s: Column) -> list[Column]:
    """The features of a span, in the order of FEATURES; each is below its number."""
    m, before = s["m"], s["before"]
    n = F.length(digits(m))
    steps = lambda x, *at: sum((F.when(x >= a, 1).otherwise(0) for a in at[1:]), F.when(x >= at[0], 1).otherwise(0))
    around = lambda c: F.when(c == "", 0).when(c.rlike(r"[\s]"), 1).when(c.rlike(r"[\p{L}\p{N}_]"), 2).otherwise(3)
    return [
        steps(F.length(m), 9, 14, 20, 40),
        steps(n, 1, 9, 12, 16),
        steps(F.length(F.regexp_replace(m, r"[\p{L}\p{N}]+", "")), 1, 3, 5),
        steps(F.size(F.array_distinct(F.split(digits(m), ""))), 2, 4, 7),
        around(F.right(before, F.lit(1))),
        around(s["after"]),
    ]


def _pattern_key(kind: str, s: Column) -> Column:
    """One number for the kind, features and votes of a span."""
    sizes = [*FEATURES.values(), *(3 for _ in LABELERS)]
    digits_ = [*features(s), *(v + 1 for v in votes(kind, s))]
    return reduce(lambda acc, x: acc * x[0] + x[1], zip(sizes, digits_), F.lit(KINDS.index(kind)).cast("long"))


def _decode(key: int) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    """Kind, votes and features of a key."""
    out = []
    for size in [*(3 for _ in LABELERS), *reversed(FEATURES.values())]:
        key, r = divmod(key, size)
        out.append(r)
    k = len(LABELERS)
    return KINDS[key], tuple(r - 1 for r in reversed(out[:k])), tuple(reversed(out[k:]))


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __pii_t (text, never null), __pii_all, __pii_ok and __pii_more: structs by kind of the
    base matches, those that pass, and the looser candidates outside what passes."""
    t = F.col("__pii_t")
    on = F.col("__pii_on")
    empty = F.array().cast(_SPAN)
    df = docs.withColumn("__pii_t", F.coalesce(column(text_col), F.lit(""))).withColumn("__pii_on", t.rlike(TRIGGER))
    df = df.withColumn("__pii_all", F.struct(*(F.when(on, matches(t, BASE[k])).otherwise(empty).alias(k) for k in KINDS)))
    df = df.withColumn("__pii_ok", F.struct(*(F.filter(F.col("__pii_all")[k], by(k, lambda k, s: passes(k, s["m"]))).alias(k) for k in KINDS)))
    flat = F.array_sort(F.flatten(F.array(*(F.transform(F.col("__pii_ok")[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))))
    df = df.withColumn("__pii_flat", flat)
    df = df.withColumn("__pii_rest", F.when(on, masked(t, F.col("__pii_flat"))).otherwise(F.lit("")))
    more = (F.when(on, matches(F.col("__pii_rest"), LOOSE[k])).otherwise(empty).alias(k) for k in KINDS)
    return df.withColumn("__pii_more", F.struct(*more))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each pattern of votes and features occurs among base matches and candidates of all documents."""
    return found_counts(candidates(docs.select(column(text_col).alias("text")), "text"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, all spans of each text: (kind, span, whether it matches the base
    pattern, whether it passes the base check, its pattern of votes and features, what it is to be valid).

    This is the one pass over the texts: training and finding both read the spans, so a caller
    that does both writes them once.
    """
    names = docs.columns
    df = _with_spans(docs.toDF(*(f"c{i}" for i in range(len(names)))), f"c{names.index(text_col)}")

    def out(k: str, base: bool):
        def one(s: Column) -> Column:
            ok = passes(k, s["m"]) if base else F.lit(False)
            return F.struct(F.lit(KINDS.index(k)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), ok.alias("ok"), _pattern_key(k, s).alias("key"), (F.lit(False) if base else _valid(k, s)).alias("valid"))

        return one

    spans = F.flatten(F.array(*(F.transform(F.col(c)[k], out(k, c == "__pii_all")) for k in KINDS for c in ("__pii_all", "__pii_more"))))
    none = F.array().cast(_CANDIDATES)
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.when(F.col("__pii_on"), spans.cast(_CANDIDATES)).otherwise(none).alias(SPANS))


def found_counts(found: DataFrame) -> dict[int, int]:
    """How often each pattern occurs in candidates(); their number is bounded by the features' combinations."""
    rows = found.select(F.explode(F.transform(SPANS, lambda s: s["key"])).alias("k")).groupBy("k").count().collect()
    return {r[0]: r[1] for r in rows}


def estimate(counts: dict[int, int], settings: Settings = Settings()) -> dict[tuple, float]:
    """Chance that a span of each kind and votes is true: Dawid-Skene by kind, with abstentions.

    Pseudo-votes of the stated accuracy start and steady the estimate, so that few or one-sided
    data cannot turn a labeler round.
    """
    answers: dict[tuple, float] = {}
    for kind in KINDS:
        own = {}
        for key, n in counts.items():
            of, v, _ = _decode(key)
            if of == kind:
                own[v] = (v, n + own.get(v, (v, 0))[1])
        if not own:
            continue
        weight, accuracy = settings.weight, settings.accuracy

        def prior(y: int, v: int) -> float:
            # nothing said is as likely for either; a vote is right with the stated accuracy
            return 0.4 if v == 0 else 0.6 * (accuracy if (v > 0) == (y > 0) else 1 - accuracy)

        truth = {key: 1 / (1 + math.exp(-1.5 * sum(v))) for key, (v, _) in own.items()}
        for _ in range(settings.rounds):
            share = (weight / 2 + sum(n * truth[k] for k, (_, n) in own.items())) / (weight + sum(n for _, n in own.values()))
            rate = {}
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    mass = {v: weight * prior(y, v) for v in (-1, 0, 1)}
                    for k, (v, n) in own.items():
                        mass[v[j]] += n * (truth[k] if y else 1 - truth[k])
                    total = sum(mass.values())
                    rate |= {(j, y, v): x / total for v, x in mass.items()}
            for k, (v, _) in own.items():
                z = math.log(share / (1 - share)) + sum(math.log(rate[j, 1, x] / rate[j, 0, x]) for j, x in enumerate(v))
                truth[k] = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        answers |= {(kind, v): p for v, p in truth.items()}
    return answers


def _inputs(v: tuple[int, ...], f: tuple[int, ...]) -> list[float]:
    """The classifier's inputs: votes for and against, and one for each value of each feature."""
    own = [float(x == k) for x, size in zip(f, FEATURES.values()) for k in range(size)]
    return [1.0, *(float(x == 1) for x in v), *(float(x == -1) for x in v), *own]


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a small positive definite a, by elimination."""
    rows = [[*r, y] for r, y in zip(a, b)]
    n = len(rows)
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i])]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def train(counts: dict[int, int], settings: Settings = Settings()) -> dict[str, list[float]]:
    """Weights of the span classifier by kind: ridge logistic regression on the estimated labels, by Newton's method."""
    truth, weights = estimate(counts, settings), {}
    for kind in KINDS:
        rows = [(_inputs(v, f), n, truth[kind, v]) for key, n in sorted(counts.items()) for of, v, f in [_decode(key)] if of == kind]
        k = 1 + 2 * len(LABELERS) + sum(FEATURES.values())
        w = [0.0] * k
        for _ in range(40 if rows else 0):
            g = [settings.ridge * x for x in w]
            h = [[settings.ridge * (i == j) for j in range(k)] for i in range(k)]
            for x, n, y in rows:
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x))))))
                on = [i for i, a in enumerate(x) if a]
                for i in on:
                    g[i] += n * (p - y)
                    for j in on:
                        h[i][j] += n * p * (1 - p)
            step = _solve(h, g)
            # steps are held to 3 so that a far start cannot throw the search off
            hold = min(1.0, 3.0 / max(1e-12, max(map(abs, step))))
            w = [a - hold * b for a, b in zip(w, step)]
            if max(map(abs, step)) < 1e-7:
                break
        weights[kind] = w
    return weights


def _chance(key: Column, weights: dict[str, list[float]]) -> Column:
    """The classifier's probability of a span with this pattern."""
    k = len(LABELERS)

    def score(kind: str) -> Column:
        w, z, rest = weights[kind], F.lit(weights[kind][0]), key
        parts = []
        for size in [*(3 for _ in LABELERS), *reversed(FEATURES.values())]:
            parts.append(F.pmod(rest, F.lit(size)))
            rest = F.floor(rest / size)
        for j in range(k):
            x = parts[k - 1 - j]
            z = z + F.when(x == 2, w[1 + j]).when(x == 0, w[1 + k + j]).otherwise(0.0)
        at = 1 + 2 * k
        for size, x in zip(FEATURES.values(), reversed(parts[k:])):
            z = z + F.get(F.array(*(F.lit(y) for y in w[at : at + size])), x.cast("int"))
            at += size
        return 1 / (1 + F.exp(-z))

    span = math.prod(FEATURES.values()) * 3**k
    own = F.floor(key / span)
    return reduce(lambda x, i: x.when(own == i, score(KINDS[i])), range(1, len(KINDS)), F.when(own == 0, score(KINDS[0])))


def _valid(kind: str, s: Column) -> Column:
    """What a span must be whatever the votes: the check of its kind on its plain form."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return passes("ip", F.regexp_replace(s["m"], r"[\[\]]", ""))
    return passes(kind, s["m"])


_OUT = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
_CANDIDATES = "array<struct<rank:int,start:bigint,end:bigint,base:boolean,ok:boolean,key:bigint,valid:boolean>>"
#: The column that candidates() adds; one of that name in the input is not allowed.
SPANS = "__brindle_pii_candidates"


def decide(found: DataFrame, weights: dict[str, list[float]], settings: Settings = Settings()) -> DataFrame:
    """candidates() with pii_base and pii_spans in place of the candidates."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    out = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(kinds, s["rank"]).alias("kind"))
    base = F.sort_array(F.transform(F.filter(SPANS, lambda s: s["ok"]), out)).cast(_OUT)
    added = F.filter(SPANS, lambda s: s["ok"] | (~s["base"] & s["valid"] & (_chance(s["key"], weights) >= settings.least)))
    spans = F.sort_array(F.transform(added, out)).cast(_OUT)
    stay = [c for c in found.columns if c not in (SPANS, "pii_base", "pii_spans")]
    return found.select(*(column(c) for c in stay), base.alias("pii_base"), spans.alias("pii_spans"))


def find(docs: DataFrame, weights: dict[str, list[float]], text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with pii_base and pii_spans: arrays of (start, rank, end, kind), sorted by start and kind.

    Places are code points, end exclusive; pii_spans holds pii_base and what the classifier
    adds. A null text is empty, and a text of any length is read whole. Rows are independent, so
    repeated rows get equal spans. Columns of docs named pii_base or pii_spans give way.
    """
    return decide(candidates(docs, text_col), weights, settings)


def show(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: dict[str, list[float]] | None = None, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlaps go with
    the first span, and what overlaps further goes with it. Null texts stay null. Without weights
    the classifier is trained on docs, whose spans are then written once for both."""
    own = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index(text_col)
    found = candidates(own, f"c{at}")
    if weights is None:
        found = materialize(found, "pii-candidates")
        weights = train(found_counts(found), settings)
    df = decide(found, weights, settings)
    text = rebuild(F.col(f"c{at}"), F.col("pii_spans"), lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    return df.select(*(text.alias(c) if i == at else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
