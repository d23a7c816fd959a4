"""Document quality rules with risk-controlled thresholds.

A few measures of each whole text are compared with cutoffs. Cutoffs are chosen by stratum (language). A stratum's path is a sequence of ``STRICTNESS`` steps,
each with a cutoff for every rule, from lax to strict: at each step a rule rejects as much as it can while the share of bad documents it rejects is
``lift`` times that of the unlabelled ones, and the lift falls from ``FIRST_LIFT`` to ``last_lift``. The path looks at no good document. Labelled
holdouts of good ones are then tested along it in this fixed order, each step on the exact binomial (Clopper-Pearson) upper bound of the
share of good documents that its cutoffs together reject; the first bound above ``risk`` ends the sequence. A fixed sequence needs no correction among its own
steps and the rules of a step are tested as one, so Bonferroni over strata is all that is left: with probability ``1 - delta`` every stratum
loses at most ``risk`` of its good documents to the cutoffs. Of the steps that passed, the one with the most bad documents rejected
less ``weight`` times the good ones wins.

Strata of fewer than ``least_good`` good labels, and those beyond the ``max_strata`` with the most, are one stratum together: they share
their labels, their path and the promise. If that has too few labels too, it has no cutoff.

Fixed limits come first (``base_failed``): under 20 words, or over 30 percent of words in repeated 8-word windows.

Defined results: null text has no words and fails the limits; a null language is a stratum of its own, apart from the empty one; labels
without a document, with nulls, or of a repeated id count once per matching row; without labels no cutoff is set;
other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, prepare, slices

#: Cutoffs are multiples of ``1 / STEPS`` of a measure between 0 and 1.
STEPS = 100
#: Steps of a path, and the lift of the first.
STRICTNESS, FIRST_LIFT = 1000, 100.0
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long"
_share = lambda x, y: x / F.greatest(y, F.lit(1))
#: Each rule's measure, which grows as documents get worse, over the columns that ``c`` gives by name.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "symbols": lambda c: F.least(_share(c("n_symbols"), c("n_words")), F.lit(1.0)),
    "repeats": lambda c: _share(c("n_repeat_words"), c("n_words")),
    "duplicate_lines": lambda c: _share(c("n_dup_lines"), c("n_lines")),
    "capitals": lambda c: _share(c("n_upper"), c("n_letters")),
    "long_words": lambda c: F.least(_share(c("word_chars"), c("n_words")) / 50, F.lit(1.0)),
}


def _bin(rule: str, c: Callable[[str], Column]) -> Column:
    return F.ceil(RULES[rule](c) * STEPS).cast("int")


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    marks[:n] += again
    marks[width : width + n] -= again
    return int((np.cumsum(marks) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of ``FEATURES`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    data = np.frombuffer(raw, np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    letters = int(((data >= 97) & (data <= 122)).sum()) + upper
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
        len(lines),
        letters,
        upper,
    )


def with_features(docs: DataFrame, column: str = "quality_features") -> DataFrame:
    """All columns and a struct of the counts."""
    prepare(docs.sparkSession)
    schema = StructType([*docs.schema, *StructType.fromDDL(f"`{column}` struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")])
    at = docs.columns.index("text")
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure(t or "") for t in b.column(at).cast(pa.string()).to_pylist()]
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(counts, names)], [*b.schema.names, column])

    return docs.mapInArrow(add, schema)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and the counts."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    return with_features(rows).select("doc_id", "stratum", "quality_features.*")


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def upper_bound(rejected: int, good: int, delta: float) -> float:
    """Exact upper limit of the rejected share: the largest share under which so few would still have probability ``delta``."""
    if rejected >= good:
        return 1.0
    low, high = rejected / good, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_share(good - rejected, rejected + 1, 1 - mid) > delta else (low, mid)
    return high


def base_failed(c: Callable[[str], Column] = F.col) -> Column:
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


@dataclass(frozen=True)
class Cutoffs:
    """For each rule the largest bin that passes: of strata of their own, and of all others."""

    own: dict[str | None, dict[str, int]] = field(default_factory=dict)
    others: dict[str, int] = field(default_factory=dict)


def path(unlabelled: dict[str, np.ndarray], bad: dict[str, np.ndarray], last_lift: float) -> list[dict[str, int]]:
    """The cutoffs of each step that changes any, from the histograms of a stratum's unlabelled and bad documents."""
    now, out, tails = dict.fromkeys(RULES, STEPS), [], {}
    for rule in RULES:
        u, b = (np.cumsum(x[rule][::-1])[::-1] for x in (unlabelled, bad))  # u[k]: documents of bin k or above
        tails[rule] = (u[1:] * max(b[0], 1), b[1:] * max(u[0], 1))
    for step in range(STRICTNESS):
        lift = FIRST_LIFT * (last_lift / FIRST_LIFT) ** (step / (STRICTNESS - 1))
        for rule, (of_u, of_b) in tails.items():
            passing = np.flatnonzero((of_b > 0) & (of_b >= lift * of_u))
            if len(passing):
                now[rule] = min(now[rule], int(passing[0]))
        if not out or out[-1] != now:
            out.append(dict(now))
    return out


def chosen(steps: list[dict[str, int]], good: np.ndarray, bad: np.ndarray, risk: float, level: float, weight: float) -> dict[str, int]:
    """The cutoffs of the best step that passes; ``good[k]`` and ``bad[k]`` documents are first rejected at step k, the last entry never."""
    total, best = int(good.sum()), (0.0, {})
    for k, cutoffs in enumerate(steps, 1):
        lost = int(good[: k + 1].sum())
        # The bound is over the risk if so few rejections would be likelier than the level where the risk is the true share.
        if lost >= total or _beta_share(total - lost, lost + 1, 1 - risk) > level:
            break
        gain = float(bad[: k + 1].sum()) - weight * lost
        if gain > best[0]:
            best = (gain, cutoffs)
    return best[1]


def calibrate(
    measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, weight: float = 4.0, last_lift: float = 1.25, least_good: int = 200, max_strata: int = 1000
) -> Cutoffs:
    """Cutoffs by stratum. What leaves the executors are histograms of at most ``max_strata + 1`` strata."""
    marks = labels.where("doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("good")).where("good IS NOT NULL")
    bins = F.array(*[_bin(name, F.col) for name in RULES]).alias("bins")
    rows = measured.where(~base_failed()).select("doc_id", "stratum", bins).join(marks, "doc_id", "left").select("stratum", "bins", "good")
    rows = cut(rows.groupBy("stratum", "bins", "good").count(), "rule-bins")
    large = rows.where("good").groupBy("stratum").agg(F.sum("count").alias("n")).where(F.col("n") >= least_good).orderBy(F.desc("n"), "stratum").limit(max_strata)
    own = [r["stratum"] for r in large.collect()]
    named = rows.sparkSession.createDataFrame([(x, k) for k, x in enumerate(own)], "name string, number int")
    placed = rows.join(F.broadcast(named), F.col("stratum").eqNullSafe(F.col("name")), "left").select(F.coalesce("number", F.lit(-1)).alias("group"), "bins", "good", "count")

    tables: dict[tuple[int, bool], dict[str, np.ndarray]] = {}
    tall = placed.where("NOT good OR good IS NULL").select("group", "good", "count", F.posexplode("bins").alias("rule", "bin"))
    names = list(RULES)
    for r in tall.groupBy("group", "good", "rule", "bin").agg(F.sum("count").alias("n")).collect():
        kind = tables.setdefault((r["group"], r["good"] is not None), {x: np.zeros(STEPS + 2, np.int64) for x in names})
        kind[names[r["rule"]]][r["bin"]] += r["n"]
    none = {x: np.zeros(STEPS + 2, np.int64) for x in names}
    paths = {g: path(tables.get((g, False), none), tables.get((g, True), none), last_lift) for g in [*range(len(own)), -1]}
    # The step at which each bin of each rule is first rejected.
    first = [(g, [[next((k for k, x in enumerate(steps, 1) if b > x[name]), STRICTNESS + 1) for b in range(STEPS + 1)] for name in names]) for g, steps in paths.items()]
    lookup = F.broadcast(rows.sparkSession.createDataFrame(first, "group int, first array<array<int>>"))
    step = F.array_min(F.zip_with("first", "bins", lambda x, b: x[b]))
    counts = placed.where("good IS NOT NULL").join(lookup, "group").groupBy("group", "good", step.alias("step")).agg(F.sum("count").alias("n"))
    held: dict[tuple[int, bool], np.ndarray] = {}
    for r in counts.collect():
        held.setdefault((r["group"], r["good"]), np.zeros(STRICTNESS + 2, np.int64))[r["step"]] += r["n"]
    level = delta / max(1, len({g for g, good in held if good}))
    zero = np.zeros(STRICTNESS + 2, np.int64)
    found = {g: chosen(paths[g], held.get((g, True), zero), held.get((g, False), zero), risk, level, weight) for g in paths}
    return Cutoffs({x: found[k] for k, x in enumerate(own)}, found[-1])


def kept(cutoffs: Cutoffs, c: Callable[[str], Column] = F.col, stratum: Column | None = None) -> Column:
    """Whether a document with these counts passes the limits and its stratum's cutoffs."""
    stratum = F.col("stratum") if stratum is None else stratum
    failed = base_failed(c)
    for rule in RULES:
        limit = F.lit(cutoffs.others.get(rule, STEPS))
        named = {x: y.get(rule, STEPS) for x, y in cutoffs.own.items()}
        entries = [F.lit(v) for x, y in named.items() if x is not None for v in (x, y)]
        own = F.coalesce(F.try_element_at(F.create_map(*entries), stratum), limit) if entries else limit
        failed = failed | (_bin(rule, c) > F.when(stratum.isNull(), named.get(None, limit)).otherwise(own))
    return ~failed


def assess(docs: DataFrame, labels: DataFrame, **kw: float) -> DataFrame:
    """``features`` with ``base_failed`` and ``kept``; features are written once and used for labels and verdicts."""
    measured = cut(features(docs), "quality-features")
    cutoffs = calibrate(measured, labels, **kw)
    return measured.select("*", base_failed().alias("base_failed"), kept(cutoffs).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **kw: float) -> DataFrame:
    """The documents that are kept, with all their columns; texts are measured in place and never shuffled."""
    cutoffs = calibrate(cut(features(docs), "quality-features"), labels, **kw)
    f = "__quality_features"
    return with_features(docs, f).where(kept(cutoffs, lambda name: F.col(f)[name], F.col("lang").cast("string"))).drop(f)
