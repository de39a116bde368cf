"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are lower-cased runs of word characters. The vector space holds all terms of the examples. A term weighs its inverse
document frequency among the examples, the collection that is searched, times the strength of its dependence on the label (phi over the examples, plus
``FLOOR``, so every term counts): long neutral texts do not drown few telling words, and no term is left out. Exact copies count
once. Examples are at most ``SAMPLE`` texts of either label (a documented, bounded sample). The index keeps, for each term, its
examples in blocks of ``BLOCK`` with the largest weight of each block. A query sums these bounds per block, visits blocks
from the highest bound down, some at a time, and stops when no block can beat the k-th best cosine: the top k are
exact. Terms that more than one in ``OFTEN`` examples hold are multiplied as a dense matrix for many texts at once.

The score is the weighted share of label 1 among the k nearest: each vote weighs 1 / (0.05 + distance)
times the number of labelled rows its example stands for, and one vote at distance 1 for the overall
share of label 1. Texts without any term (null and empty ones, too) get that share. Without any usable label all
scores are 0; an empty table gives an empty result. Evidence: ids of the nearest examples and the weightiest terms met. Ties are decided by the smaller id;
very long texts are scored whole; repeated rows each get their row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import held_out, kept_for_reuse, labelled_sample, record

SAMPLE, FLOOR, OFTEN, BLOCK, NEIGHBOURS, CUTOFF = 4000, 1e-3, 8, 256, 15, 0.5
_AT_ONCE, _FIRST = 32, 4
_WORDS = re.compile(r"\w+")
VOTES = record(score="double", evidence="longs", terms="string")


def terms_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first..end-1, one range after the other."""
    sizes = end - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Index:
    """Examples as unit vectors over ``terms``: rare terms as cells (a term's examples in one block), frequent ones dense."""

    terms: dict[str, int]
    idf: np.ndarray  # weight of each term
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # labelled rows that each example stands for
    share: float
    cells: np.ndarray  # where each term's cells begin (terms + 1)
    block: np.ndarray  # of each cell
    largest: np.ndarray  # largest weight in each cell
    parts: np.ndarray  # where each cell's postings begin (cells + 1)
    examples: np.ndarray  # of each posting
    weights: np.ndarray  # of each posting
    frequent: np.ndarray  # row of each term in ``dense``, or -1
    dense: np.ndarray  # frequent terms x examples, up to whole blocks

    def __post_init__(self):
        self.names = list(self.terms)

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, number = Counter(words), self.terms.get
        at = np.array([number(w, -1) for w in counts], np.int64)
        order = np.argsort(at)[np.count_nonzero(at < 0) :]
        at, n = at[order], np.fromiter(counts.values(), np.int64, len(counts))[order]
        x = (1.0 + np.log(n)) * self.idf[at]
        return at, x / np.sqrt(x @ x) if len(at) else x

    def nearest(self, at, x: np.ndarray, k: int = NEIGHBOURS, common: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0: (cosine, example). ``common``: what the frequent terms add."""
        at = np.asarray(at, np.int64)
        row = self.frequent[at]
        if common is None:
            common = x[row >= 0] @ self.dense[row[row >= 0]]
        by_block = common.reshape(-1, BLOCK)
        first, end = self.cells[at[row < 0]], self.cells[at[row < 0] + 1]
        cells, q = _ranges(first, end), np.repeat(x[row < 0], end - first)
        block = self.block[cells]
        bounds = by_block.max(axis=1) + np.bincount(block, q * self.largest[cells], len(by_block))
        order, best, done = np.argsort(-bounds, kind="stable"), [], 0
        while done < len(order):
            least = best[-1][0] if len(best) == k else 0.0
            take = order[done : done + _FIRST] if not done else order[done:]
            done += len(take)
            take = take[(bounds[take] > 0) & (bounds[take] + 1e-9 >= least)]
            if not len(take):
                break
            wanted = np.zeros(len(order), bool)
            wanted[take] = True
            held = wanted[block]
            first, end = self.parts[cells[held]], self.parts[cells[held] + 1]
            at_postings = _ranges(first, end)
            adds = np.repeat(q[held], end - first) * self.weights[at_postings]
            scores = (np.bincount(self.examples[at_postings], adds, common.size) + common).reshape(-1, BLOCK)[take].ravel()
            hits = np.flatnonzero((scores > 0) & (scores + 1e-9 > least))
            if len(hits) > k:
                hits = hits[scores[hits] + 1e-9 >= np.partition(scores[hits], len(hits) - k)[len(hits) - k]]
            best += [(round(float(scores[h]), 12), int(take[h // BLOCK]) * BLOCK + int(h % BLOCK)) for h in hits]
            best = sorted(best, key=lambda s: (-s[0], s[1]))[:k]
        return best

    def vote(self, texts: list[str | None]) -> list[tuple[float, list[int], str]]:
        vectors = [self.vector(terms_of(t)) for t in texts]
        queries = np.zeros((len(texts), len(self.dense)))
        for i, (at, x) in enumerate(vectors):
            row = self.frequent[at]
            queries[i, row[row >= 0]] = x[row >= 0]
        out = []
        for (at, x), common in zip(vectors, queries @ self.dense):
            near = self.nearest(at, x, common=common) if len(at) else []
            for_one, total = self.share / 1.05, 1 / 1.05
            for cosine, e in near:
                v = self.votes[e] / (0.05 + 1.0 - min(cosine, 1.0))
                for_one, total = for_one + v * self.labels[e], total + v
            telling = np.argsort(-x, kind="stable")[:20].tolist()
            out.append((for_one / total, [int(self.ids[e]) for _, e in near[:5]], " ".join(self.names[at[i]] for i in telling)))
        return out


def build_index(ids, labels, vectors, terms: dict[str, int], idf: np.ndarray, rows_per_label: tuple[int, int]) -> Index:
    """Index of the examples; ``vectors`` are (terms, weights) of unit length."""
    labels = np.asarray(labels, np.int64)
    sizes = np.maximum(np.bincount(labels, minlength=2)[:2], 1)
    votes = np.maximum(np.asarray(rows_per_label)[labels] / sizes[labels], 1.0) if len(labels) else np.zeros(0)
    total, n = sum(rows_per_label), len(labels)
    examples = np.repeat(np.arange(n), [len(at) for at, _ in vectors])
    held = np.concatenate([np.zeros(0, np.int64), *[np.asarray(at, np.int64) for at, _ in vectors]])
    weights = np.concatenate([np.zeros(0), *[x for _, x in vectors]])
    counts = np.bincount(held, minlength=len(terms))
    often = np.flatnonzero((counts * OFTEN > n) & (counts > BLOCK // 4))
    frequent = np.full(len(terms), -1, np.int64)
    frequent[often] = np.arange(len(often))
    dense = np.zeros((len(often), -(-n // BLOCK) * BLOCK))
    inside = frequent[held] >= 0
    dense[frequent[held[inside]], examples[inside]] = weights[inside]
    order = np.flatnonzero(~inside)
    order = order[np.argsort(held[order], kind="stable")]
    held, examples, weights = held[order], examples[order], weights[order]
    block = examples // BLOCK
    begins = np.flatnonzero(np.diff(held, prepend=-1) | np.diff(block, prepend=-1))
    largest = np.maximum.reduceat(weights, begins) if len(begins) else np.zeros(0)
    cells = np.searchsorted(held[begins], np.arange(len(terms) + 1))
    return Index(
        terms, idf, np.asarray(ids, np.int64), labels, votes, rows_per_label[1] / total if total else 0.0, cells, block[begins], largest,
        np.append(begins, len(held)), examples, weights, frequent, dense,
    )


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Index:
    """Weigh the terms and index the examples; term counts and vectors are computed on the cluster.

    What reaches the driver is bounded by the examples: their different terms, and the vectors of 2 * ``bound`` texts.
    """
    distinct = F.pandas_udf(lambda texts: pd.Series([sorted(set(terms_of(t))) for t in texts]), "array<string>")
    sample = kept_for_reuse(labelled_sample(docs, labels, "toxic", bound).groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")))
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    rows = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = (
        sample.select("label", F.explode(distinct("text")).alias("term"))
        .groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    ).toArrow().sort_by("term")
    terms = {t: i for i, t in enumerate(found["term"].to_pylist())}
    a, b, n = found["a"].to_numpy().astype(float), found["b"].to_numpy().astype(float), float(n0 + n1)
    spread = (a + b) * (n - a - b) * n0 * n1
    phi = np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.where(spread > 0, spread, 1.0)) * (spread > 0)
    idf = (np.log((n + 1) / (a + b + 1)) + 1) * (phi + FLOOR)
    space = docs.sparkSession.sparkContext.broadcast(build_index([], [], [], terms, idf, (0, 0)))

    def vectors(batches):
        for texts in batches:
            made = [space.value.vector(terms_of(t)) for t in texts["text"]]
            keep = [i for i, (at, _) in enumerate(made) if len(at)]
            if keep:
                yield pd.DataFrame({
                    "doc_id": texts["doc_id"].iloc[keep], "label": texts["label"].iloc[keep],
                    "at": [made[i][0].tobytes() for i in keep], "x": [made[i][1].tobytes() for i in keep],
                })

    held = sample.mapInPandas(vectors, record(doc_id="long", label="int", at="binary", x="binary")).collect()
    sample.unpersist()
    space.destroy()  # nothing is left that could need it again
    held.sort(key=lambda r: r.doc_id)
    weights = (rows.get(0, 0), rows.get(1, 0))
    index = build_index(
        [r.doc_id for r in held], [r.label for r in held], [(np.frombuffer(r.at, np.int64), np.frombuffer(r.x)) for r in held], terms, idf, weights
    )
    # Examples without any term stand for rows, too: a vote counts for rows of all examples of its label.
    index.votes = np.maximum(np.array(weights)[index.labels] / np.maximum(np.array([n0, n1]), 1)[index.labels], 1.0)
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, text: Column | str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, evidence (example ids), terms met."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf(VOTES)
    def votes(texts: pd.Series) -> pd.DataFrame:
        rows = [r for i in range(0, len(texts), _AT_ONCE) for r in shared.value.vote(texts.iloc[i : i + _AT_ONCE].tolist())]
        return pd.DataFrame(rows, columns=VOTES.names)

    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), votes(text).alias("_v"))
    return scored.select(
        "doc_id", "held_out", "_v.score", (F.col("_v.score") >= cutoff).cast("int").alias("predicted"), "_v.evidence", "_v.terms"
    )
