"""Document quality by hierarchical empirical Bayes.

A document classifier gives evidence from the text alone: a logistic model of style counts for low quality and
one of a learned lexicon for toxicity. Sites then speak: evidence (the label where there is one, else the
classifier's probability) is summed by path and host with grouped aggregation, hosts shrink toward the global
rate and paths toward their host, each with a strength set by the spread between sites (method of moments), so
sparse sites fall back on what is above them. The logit of a path's posterior against the global one shifts the
document's logit. A document is kept when the probability that it is both of quality and not toxic is at least
``threshold``.

The classifier is fitted on at most ``sample_rows`` labelled documents, taken in order of a hash of the id;
sums over sites cover every document. ``host`` and ``path`` are columns, ``source`` and ``lang`` for documents. Up to ``broadcast_sites``
sites are broadcast; beyond it verdicts are joined to the documents by id and a hash of the text, so a site that holds many of them is not one group.

Defined results: null text is an empty text; null hosts and paths are sites of their own, apart from empty ones; labels with nulls
are not used; with labels of one kind only (or none) that kind's share is all the evidence; of labels that
repeat an id the worse counts; equal rows get equal scores; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, cut, prepare, slices
from .quality_rules import measure

#: ASCII other than letters separates the words of the lexicon.
_NOT_LETTERS = r"[\x00-@\[-`{-\x7f]+"
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
LABELS = ("low", "toxic")


@dataclass
class Model:
    """What the executors need: a lexicon, and weights for each label."""

    lexicon: dict[bytes, float] = field(default_factory=dict)
    low: list[float] = field(default_factory=list)
    toxic: list[float] = field(default_factory=list)

    def vectors(self, text: str) -> tuple[list[float], list[float]]:
        n, chars, symbols, dup, repeat, lines, letters, upper = measure(text)
        w, shares = max(n, 1), [0.0] * 6
        shares[0] = min(symbols / w, 2.0)
        shares[1] = dup / max(lines, 1)
        shares[2] = repeat / w
        shares[3] = upper / max(letters, 1)
        shares[4] = min(chars / w, 40.0) / 10
        shares[5] = min(letters / max(chars, 1), 1.0)
        style = [1.0, *shares, *(x * x for x in shares), *(min(10 * x, 1.0) for x in shares[:4]), math.log1p(n) / 5, 1.0 if n < 20 else 0.0]
        words = set(text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split())
        found = [self.lexicon[x] for x in self.lexicon.keys() & words]
        return style, [1.0, sum(found) / 5, max(found, default=0.0) / 5, min(len(found), 5) / 2]

    def logits(self, text: str) -> tuple[float, float]:
        style, words = self.vectors(text)
        return sum(a * b for a, b in zip(self.low, style, strict=True)), sum(a * b for a, b in zip(self.toxic, words, strict=True))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> list[float]:
    """Newton's method with a ridge on all but the intercept; labels of one kind give the smoothed share alone."""
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    w[0] = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return w.tolist()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _labels(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max((F.col("quality") != 1).cast("int")).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, lexicon_words: int = 2_000, least_gain: float = 20.0) -> Model:
    """The document classifier from a bounded sample of labelled rows."""
    prepare(docs.sparkSession)
    sample = _labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = cut(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id"), "classifier-sample")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = total["n"], total["t"]
    model = Model()
    if 0 < t < n:
        words = rows.select("toxic", F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), _NOT_LETTERS))).alias("word")).where("word <> ''")
        counts = words.groupBy("word").agg(F.sum("toxic").alias("k"), F.count("*").alias("m")).where("k >= 3")
        a, b = (F.col("k") + 0.5) / (t + 1.0), (F.col("m") - F.col("k") + 0.5) / (n - t + 1.0)
        expected, other = F.col("m") * t / n, F.col("m") * (n - t) / n
        gain = 2 * (F.col("k") * F.log(F.col("k") / expected) + F.when(F.col("m") > F.col("k"), (F.col("m") - F.col("k")) * F.log((F.col("m") - F.col("k")) / other)).otherwise(0.0))
        best = counts.select("word", F.log(a / b).alias("weight"), gain.alias("gain")).where((F.col("weight") > 1) & (F.col("gain") >= least_gain)).orderBy(F.desc("gain"), "word").limit(lexicon_words)
        model.lexicon = {r["word"].encode(): r["weight"] for r in best.collect()}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [model.vectors(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both]), pa.array([x[1] for x in both]), b.column(1), b.column(2)], ["style", "words", "low", "toxic"])

    data = rows.select("text", "low", "toxic").mapInArrow(vectors, "style array<double>, words array<double>, low int, toxic int").toPandas()
    style, words = Model().vectors("")
    as_matrix = lambda x, width: np.array(x.tolist(), float).reshape(-1, width)
    model.low = fit_logistic(as_matrix(data["style"], len(style)), data["low"].to_numpy(float))
    model.toxic = fit_logistic(as_matrix(data["words"], len(words)), data["toxic"].to_numpy(float))
    return model


def with_evidence(docs: DataFrame, model: Model, column: str = "__evidence") -> DataFrame:
    """All columns and a struct with the classifier's logit for each label."""
    prepare(docs.sparkSession)
    schema = StructType([*docs.schema, *StructType.fromDDL(f"`{column}` struct<low:double,toxic:double>")])
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [model.logits(x or "") for x in b.column(at).cast(pa.string()).to_pylist()]
            parts = [pa.array([x[k] for x in both], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(parts, list(LABELS))], [*b.schema.names, column])

    return docs.mapInArrow(add, schema)


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, label: str, rate: float) -> float:
    """Pseudo-observations that a site's parent is worth: what is left of the spread of site rates beyond sampling noise."""
    r = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col(label) / F.col("n") - rate, 2)).alias("spread"), F.count("*").alias("k")).first()
    if not r["n"] or r["k"] < 2:
        return 50.0
    noise = rate * (1 - rate) * r["k"] / r["n"]
    between = max(r["spread"] / r["n"] - noise, 1e-6)
    return min(max(rate * (1 - rate) / between - 1, 2.0), 1e4)


def site_shifts(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, path`` and the shift of each label's logit at that site."""
    known = _labels(labels).select("doc_id", *[F.col(k).alias(f"is_{k}") for k in LABELS])
    soft = evidence.join(known, "doc_id", "left").select("host", "path", *[F.coalesce(F.col(f"is_{k}").cast("double"), _probability(F.col(k))).alias(k) for k in LABELS])
    paths = cut(soft.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in LABELS]), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in LABELS])
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in LABELS]).first()
    both = paths.alias("p").join(hosts.alias("h"), "host")
    out = []
    for k in LABELS:
        rate = min(max((total[k] or 0.0) / max(total["n"] or 0, 1), 1e-4), 1 - 1e-4)
        of_host, of_path = _strength(hosts, k, rate), _strength(paths, k, rate)
        host = (F.col(f"h.{k}") + of_host * rate) / (F.col("h.n") + of_host)
        path = (F.col(f"p.{k}") + of_path * host) / (F.col("p.n") + of_path)
        out.append((_logit(F.least(F.greatest(path, F.lit(1e-4)), F.lit(1 - 1e-4))) - math.log(rate / (1 - rate))).alias(f"shift_{k}"))
    return cut(both.select("host", "p.path", *out), "site-shifts")


def _sites(docs: DataFrame, host: str, path: str) -> list[Column]:
    """Names as keys that are never null: ``=name``, and the empty string for null."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, broadcast_sites: int = 100_000, **kw: int) -> DataFrame:
    """``doc_id, p_low, p_toxic`` (text alone), ``score`` (with the site's shift) and ``kept``."""
    model = fit(docs, labels, **kw)
    rows = docs.select("doc_id", *_sites(docs, host, path), F.col("text").cast("string").alias("text"))
    evidence = cut(with_evidence(rows, model).select("doc_id", "host", "path", "__evidence.*"), "evidence")
    shifts = site_shifts(evidence, labels)
    small = shifts.limit(broadcast_sites + 1).count() <= broadcast_sites
    rated = evidence.join(F.broadcast(shifts) if small else shifts, ["host", "path"])
    score = _good(F.col("low"), F.col("toxic"))
    return rated.select("doc_id", _probability(F.col("low")).alias("p_low"), _probability(F.col("toxic")).alias("p_toxic"), score.alias("score"), (score >= threshold).alias("kept"))


def _good(low: Column, toxic: Column) -> Column:
    return (1 - _probability(low + F.col("shift_low"))) * (1 - _probability(toxic + F.col("shift_toxic")))


def drop_rejected(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, broadcast_sites: int = 100_000, **kw: int) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = fit(docs, labels, **kw)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *_sites(docs, host, path), text.alias("text"))
    evidence = cut(with_evidence(rows, model).select("doc_id", "text_hash", "host", "path", "__evidence.*"), "evidence")
    shifts = site_shifts(evidence, labels)
    if shifts.limit(broadcast_sites + 1).count() > broadcast_sites:
        bad = evidence.join(shifts, ["host", "path"]).where(~(_good(F.col("low"), F.col("toxic")) >= threshold))
        bad = cut(bad.select("doc_id", "text_hash", "host", "path").distinct(), "rejected").alias("b")
        own = dict(zip(("host", "path"), _sites(docs, host, path), strict=True))
        kept = docs.withColumns({"__doc_id": F.col("doc_id"), "__text_hash": F.xxhash64(text), "__host": own["host"], "__path": own["path"]})
        same = F.col("__doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("__text_hash") == F.col("b.text_hash")) & (F.col("__host") == F.col("b.host")) & (F.col("__path") == F.col("b.path"))
        return kept.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shifts = shifts.select(F.struct("host", "path").alias("__site"), F.struct("shift_low", "shift_toxic").alias("__shift"))
    rated = with_evidence(docs, model).withColumn("__site", F.struct(*_sites(docs, host, path))).join(F.broadcast(shifts), "__site")
    p = lambda k: _probability(F.col("__evidence")[k] + F.col("__shift")[f"shift_{k}"])
    return rated.where((1 - p("low")) * (1 - p("toxic")) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
