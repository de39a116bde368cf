"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A token is a run of word characters or a run of other visible characters. Each token and each pair of
neighbours is hashed into one of ``BUCKETS`` weights; a pair of equal tokens gets one bucket of its own,
whatever the token, and so does a triple whose ends are equal. The value of a bucket is its count over the root of the number of n-grams, so a score
is a sparse dot product over the n-grams of the text. Training sees at most ``SAMPLE`` labelled texts of
either label (a documented, bounded sample), one update per text and pass, in one task; the model is
BUCKETS float32 numbers (1 MB), which bounds what is broadcast.

Null and empty texts have no n-grams and get the score of the bias; without any usable label every score
is 0.5. Very long texts are scored whole; repeated rows each get their row. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import held_out, labelled_sample, record

BUCKETS, SAMPLE, PASSES, CUTOFF = 1 << 18, 4000, 4, 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_SAME, _ENDS = 0x5BD1E995, 0x27D4EB2F
_hashes: dict[str, int] = {}


def ngram_buckets(text: str | None) -> np.ndarray:
    """Bucket of each n-gram of the text, repeats included."""
    tokens = _TOKENS.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    if len(_hashes) > 500_000:
        _hashes.clear()
    known = []
    for t in tokens:
        h = _hashes.get(t)
        if h is None:
            h = _hashes[t] = zlib.crc32(t.encode())
        known.append(h)
    one = np.array(known, np.int64)
    two = np.where(one[:-1] == one[1:], _SAME, (one[:-1] * 31 + one[1:]) * 0x9E3779B1 >> 17)
    three = np.full(np.count_nonzero(one[2:] == one[:-2]), _ENDS)
    return np.concatenate([one, two, three]) & (BUCKETS - 1)


def train_ftrl(texts, labels, passes: int = PASSES) -> np.ndarray:
    """Weights of the buckets and, last, the bias (follow-the-regularised-leader, proximal, per coordinate)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        w = (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    rows = [(*np.unique(b, return_counts=True), len(b)) for b in map(ngram_buckets, texts)]
    for _ in range(passes):
        for (at, count, total), y in zip(rows, labels):
            i = np.append(at, BUCKETS)
            x = np.append(count / np.sqrt(total) if total else count, 1.0)
            w = weights(i)
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y
            g = error * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> np.ndarray:
    """Train on the bounded sample, in one task of the cluster."""

    def fit(batches: Iterator[pd.DataFrame]):
        rows = pd.concat([pd.DataFrame({"text": [], "label": [], "doc_id": []}), *batches])
        # An order that mixes the labels and does not depend on how the rows were read.
        rows["by"] = [zlib.crc32(str(int(d)).encode()) for d in rows["doc_id"]]
        rows = rows.sort_values(["by", "doc_id"])
        yield pd.DataFrame({"model": [train_ftrl(rows["text"], rows["label"].astype(float)).tobytes()]})

    sample = labelled_sample(docs, labels, "quality", bound)
    rows = sample.coalesce(1).mapInPandas(fit, record(model="binary")).collect()
    model = rows[0].model if rows else bytes(4 * (BUCKETS + 1))
    return np.frombuffer(model, np.float32)


def quality_score(spark, model: np.ndarray):
    """Column function: probability that a text is of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        sums = np.empty(len(texts))
        for k, text in enumerate(texts):
            b = ngram_buckets(text)
            sums[k] = w[BUCKETS] + (w[b].sum(dtype=np.float64) / np.sqrt(len(b)) if len(b) else 0.0)
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, text: Column | str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 if the score reaches ``cutoff``)."""
    score = quality_score(docs.sparkSession, train(docs, labels))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
