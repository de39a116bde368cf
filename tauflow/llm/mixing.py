"""Mixing to target weights with soft membership, by DataFrame functions only.

Domains are the pairs (quality, toxic) of the labels table. A naive Bayes classifier over hashed words, trained on at most
``SAMPLE`` labelled texts of each domain (a documented, bounded sample, no held-out rows), gives every document a
posterior over the domains; long texts count as at most about ``EFFECTIVE`` independent words. A document of n words and
posterior p, taken at rate r, adds r * n * p[d] expected words to domain d. The rates are the least-squares solution
under r >= 0 of "totals equal targets", found by projected gradient from r = 1. Squares are measured by the inverse of the
domains' Gram matrix (4 x 4, words times posterior times posterior, summed on the cluster); in that measure the gradient has a
Lipschitz constant of 1, so the step length is 1. Each step is drawn on by the one before (Nesterov's momentum, dropped when the
squares grow). Steps go on until every total is within ``CLOSE`` of its target, or, where no rates can meet the targets, until a
step of the projected gradient moves the rates by less than ``STILL`` of their size: then they are the least-squares solution.
Column ``met`` says which. After ``STEPS`` steps without either an error is raised.

The Gram matrix and the totals are sums over the documents' unrounded posteriors, a Spark aggregate per step over a narrow
table. A rate is a function of the posterior and of the steps taken, so it is computed
in the row that needs it; no table of rates is joined or sent anywhere.

The wanted total is chosen so that the domain of the largest target keeps its words (rate about 1). Domains without words get no share.
Null and empty texts have no words and the prior as posterior; without labels all rates are 1. Rows of equal doc_id and text
share one result and each get their row. Other columns are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import kept_for_reuse, labelled_sample, packed

#: (quality, toxic) of each domain, and the wanted shares of words.
DOMAINS = ((0, 0), (0, 1), (1, 0), (1, 1))
TARGETS = (0.04, 0.01, 0.93, 0.02)
SAMPLE, BUCKETS, EFFECTIVE, STEPS, CLOSE, STILL = 2000, 1 << 14, 200.0, 2000, 1e-3, 1e-6
_D = range(len(DOMAINS))


def _words(text: Column) -> Column:
    """Words of a text, and an empty word for each further space in a row."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.split(plain, " ")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[float]]:
    """(bucket, l0, l1, ...): log likelihood of each bucket per domain, BUCKETS rows; and the domains' log priors."""
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    usable = usable.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("domain"))
    sizes = {r.domain: r.n for r in usable.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    sample = labelled_sample(docs, usable, "domain", SAMPLE, tuple(_D))
    found = sample.select("label", F.explode(_words(F.col("text"))).alias("w")).where("w <> ''").groupBy("label", _bucket(F.col("w")).alias("bucket"))
    found = found.agg(F.count(F.lit(1)).alias("n"))
    wide = found.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("label") == d, F.col("n"))), F.lit(0)).alias(f"c{d}") for d in _D])
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(wide, "bucket", "left").na.fill(0)
    sums = wide.agg(*[F.coalesce(F.sum(f"c{d}"), F.lit(0)).alias(f"s{d}") for d in _D]).first()
    table = every.select("bucket", *[F.log((F.col(f"c{d}") + 0.5) / (sums[d] + 0.5 * BUCKETS)).alias(f"l{d}") for d in _D])
    # A domain without a single word to learn from is left out, unless all are.
    known = [sums[d] > 0 or not any(sums) for d in _D]
    return table, [log((sizes.get(d, 0) + 0.5) / (total + 2.0)) if known[d] else -1e6 for d in _D]


def posteriors(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, _key, copies, n_tokens and the posterior k0, k1, ... (sum 1).

    The classifier learns from the labelled texts of ``training``, by default of ``docs``.
    """
    table, priors = train(docs if training is None else training, labels)
    text = F.coalesce("text", F.lit(""))
    # A null word stands for the row itself, so that rows without words stay.
    all_words = F.concat(F.array(F.lit(None).cast("string")), _words(F.col("text")))
    # Two steps: beside explode, the hash of the text would be worked out anew for every word.
    rows = docs.select("doc_id", F.xxhash64(text).alias("_key"), all_words.alias("_words"))
    words = rows.select("doc_id", "_key", F.explode("_words").alias("w")).where("w is null or w <> ''")
    words = words.select("doc_id", "_key", F.when(F.col("w").isNull(), -1).otherwise(_bucket(F.col("w"))).alias("bucket"))
    met = words.join(F.broadcast(table), "bucket", "left")  # BUCKETS rows, less than 1 MB
    summed = met.groupBy("doc_id", "_key").agg(
        F.count_if(F.col("bucket") == -1).alias("copies"), F.count_if(F.col("bucket") != -1).alias("n"),
        *[F.coalesce(F.sum(f"l{d}"), F.lit(0.0)).alias(f"l{d}") for d in _D],
    )
    n = F.col("n") / F.col("copies")
    weight = F.when(F.col("n") > 0, n * EFFECTIVE / (n + EFFECTIVE) / F.col("n")).otherwise(0.0)
    logs = summed.select("doc_id", "_key", "copies", n.cast("bigint").alias("n_tokens"), *[(F.col(f"l{d}") * weight + priors[d]).alias(f"l{d}") for d in _D])
    top = F.greatest(*[f"l{d}" for d in _D])
    logs = logs.select("doc_id", "_key", "copies", "n_tokens", *[F.exp(F.col(f"l{d}") - top).alias(f"e{d}") for d in _D])
    whole = sum((F.col(f"e{d}") for d in _D), F.lit(0.0))
    return logs.select("doc_id", "_key", "copies", "n_tokens", *[(F.col(f"e{d}") / whole).alias(f"k{d}") for d in _D])


def _shares() -> list[Column]:
    return [F.col(f"k{d}") for d in _D]


@dataclass
class Fit:
    """Steps taken (gradient in the domains, momentum after it), the totals they lead to, and whether these are the wanted ones."""

    steps: list[list[float]] = field(default_factory=list)
    wanted: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    met: bool = True


def _walk(steps: list[list[float]]) -> Column:
    """After the steps: the rate projected last, the rate to go on from, and how far the last step of the gradient went."""
    start = F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("rate"), F.lit(0.0).alias("moved"))
    if not steps:
        return start
    shares = F.array(*_shares())
    history = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")  # one constant, however many steps

    def go(s: Column, step: Column) -> Column:
        down = sum((F.get(shares, F.lit(d)) * F.get(step, F.lit(d)) for d in _D), F.lit(0.0))
        new = F.greatest(F.lit(0.0), s.rate - down)
        on = F.greatest(F.lit(0.0), new + F.get(step, F.lit(len(DOMAINS))) * (new - s.last))
        return F.struct(new.alias("last"), on.alias("rate"), (new - s.rate).alias("moved"))

    return F.aggregate(history, start, go)


def _rate(found: Fit) -> Column:
    """Rate of a document by its posterior."""
    return _walk(found.steps).getField("rate")


def fit(found: DataFrame, targets: tuple[float, ...] = TARGETS) -> Fit:
    """Projected gradient; each step is one aggregate over all documents."""
    cells = found.select(*[f"k{d}" for d in _D], (F.col("n_tokens") * F.col("copies")).cast("double").alias("n"))
    shares, pairs = _shares(), [(a, b) for a in _D for b in _D]
    total = lambda rows, *columns: np.array([float(x or 0.0) for x in rows.agg(*[F.sum(F.col("n") * c) for c in columns]).first()])
    sums = total(cells, *shares, *[shares[a] * shares[b] for a, b in pairs])
    own, gram = sums[: len(DOMAINS)], sums[len(DOMAINS) :].reshape(len(DOMAINS), -1)
    wanted = np.where(own > 0, targets, 0.0)
    if wanted.sum() <= 0:
        return Fit()
    lead = int(wanted.argmax())
    goal, inverse = wanted / wanted[lead] * own[lead], np.linalg.pinv(gram, hermitian=True)
    close = CLOSE * np.where(goal > 0, goal, np.maximum(own, 1.0))
    steps: list[list[float]] = []
    least, pace = np.inf, 1.0
    while len(steps) <= STEPS:
        state = _walk(steps)
        walked = cells.withColumn("_s", state)
        *reached, size, moved = total(walked, *[s * F.col("_s.rate") for s in shares], F.col("_s.last") ** 2, F.col("_s.moved") ** 2)
        gaps = np.array(reached) - goal
        met = bool(np.all(np.abs(gaps) <= close))
        if met or steps and moved <= STILL**2 * size:
            return Fit(steps, goal.tolist(), list(reached), met)
        down = inverse @ gaps
        squares = float(gaps @ down)
        pace = 1.0 if squares > least else pace
        least, after = squares, (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        steps.append([*down.tolist(), (pace - 1) / after])
        pace = after
    raise RuntimeError(f"the rates do not settle within {STEPS} steps")


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, training: DataFrame | None = None
) -> DataFrame:
    """One row per document row: doc_id, _key, n_tokens, posterior per domain (p_<quality><toxic>), rate, met (targets are met)."""
    found = kept_for_reuse(posteriors(docs, labels, training))
    fitted = fit(found, targets)
    shares = [F.round(s, 6).alias(f"p_{q}{t}") for s, (q, t) in zip(_shares(), DOMAINS)]
    rated = found.withColumn("rate", F.round(_rate(fitted), 6))
    one_each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return rated.select("doc_id", "_key", "n_tokens", *shares, "rate", F.lit(fitted.met).alias("met"), one_each).drop("_copy")


def mix_documents(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Documents with their ``rate``, the weight with which a loader draws them (0: not at all). No row is dropped;
    an older column ``rate`` is replaced."""
    rates = document_rates(docs, labels, training=training)
    rates = rates.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), F.col("rate").alias("_rate")).distinct()
    rows = packed(docs).withColumn("_text", F.xxhash64(F.coalesce(F.col("_doc.text"), F.lit(""))))
    rows = rows.join(rates, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")))
    return rows.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != "rate"], F.col("_rate").alias("rate"))
