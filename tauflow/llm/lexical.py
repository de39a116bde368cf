"""Ranked lexical search: many queries against all documents, with shared work done once.

Queries are taken in blocks of bounded size (``BLOCK`` terms in all), each against all documents. For a block:

1. Every document's query terms are counted and written once: (doc_id, n_terms, term numbers, occurrences). Term
   numbers index the block's vocabulary, which is bounded by the block and shipped to the tasks. One aggregate gives
   the number of documents, of all their terms, and of documents with each term.
2. Shared term sets are mined among the items. Terms that occur in the same items form one leaf. Then the pair of
   nodes that most items have in common becomes a node of its own, again and again, while two items share a pair. The
   result is a directed graph of sums whose sinks are the items.
3. A batch of documents is scored along that graph: a leaf's accumulator is the sum of its terms' contributions, a
   node's the sum of two others', computed once however many items use it; it is dropped after its last use.
4. Each task keeps the best ``TOP`` documents of each item; the candidates are ranked in two steps, so no task gets
   more than a bounded number of rows for an item.

All arithmetic on scores is in 64-bit integers. Contributions are never negative, so a score of 0 means no row.

Null and empty texts have no terms: such documents are not counted and never found, such items find nothing. Texts are
taken whole. Equal scores go by ascending doc_id, null last; repeated document rows are rows of their own, with equal
scores at successive ranks. Items of equal id are one item with the terms of all its texts; null is an id like any
other. An empty table on either side gives an empty result. Only doc_id, item_id and text are read, so no other column
can clash.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tauflow.llm.common import record, shared_folder
from tauflow.llm.word_bytes import words, words_of

TOP = 10
#: Terms of all items of a block together, repeats between items included; bounds what is shipped and the mining.
BLOCK = 50_000
#: Accumulator cells (documents x nodes) held at once; only memory depends on it.
CELLS = 1 << 22
#: Parts an item's candidates are ranked in before the last step.
PARTS = 64
#: Nodes of an item among which pairs are mined, the most used first; only the work shared depends on it, not the scores.
MINED = 256
TERMS = record(n="long", terms="ints", times="ints")
NO_ID = np.iinfo(np.int64).max


@dataclass
class Sharing:
    """A graph of sums: leaves hold terms, every further node adds two earlier ones, every item adds some nodes."""

    leaf: np.ndarray  # of each term
    leaves: int
    sums: list[tuple[int, int]]  # the two parts of nodes leaves, leaves + 1, ...
    items: list[list[int]]  # nodes whose sum is the item's score

    def additions(self) -> int:
        return len(self.sums) + sum(max(0, len(nodes) - 1) for nodes in self.items)


def mine_sharing(items: list[set[int]], terms: int) -> Sharing:
    """Leaves are the sets of terms that occur in the same items; then the most frequent pair of nodes is joined, again and again."""
    holders: dict[int, list[int]] = defaultdict(list)
    for i, own in enumerate(items):
        for term in own:
            holders[term].append(i)
    leaf, by_holders = np.zeros(terms, np.int32), {}
    for term in range(terms):
        leaf[term] = by_holders.setdefault(tuple(holders[term]), len(by_holders))
    nodes = [set() for _ in items]
    for holder, node in by_holders.items():
        for i in holder:
            nodes[i].add(node)
    sums, leaves = [], len(by_holders)
    uses = Counter(n for own in nodes for n in own)
    shared = {n for n, times in uses.items() if times > 1}
    pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, own in enumerate(nodes):
        both = sorted(heapq.nlargest(MINED, own & shared, key=lambda n: (uses[n], -n)))
        for j, a in enumerate(both):
            for b in both[j + 1 :]:
                pairs[a, b].add(i)
    heap = [(-len(users), pair) for pair, users in pairs.items() if len(users) > 1]
    heapq.heapify(heap)
    while heap:
        times, (a, b) = heapq.heappop(heap)
        users = {i for i in pairs[a, b] if a in nodes[i] and b in nodes[i]}
        if len(users) < 2:
            continue
        if len(users) < -times:  # fewer than when it was put there
            heapq.heappush(heap, (-len(users), (a, b)))
            pairs[a, b] = users
            continue
        node = leaves + len(sums)
        sums.append((a, b))
        new: dict[int, set[int]] = defaultdict(set)
        for i in users:
            nodes[i] -= {a, b}
            for other in nodes[i] & shared:
                new[other].add(i)
            nodes[i].add(node)
        shared.add(node)
        for other, both in new.items():
            if len(both) > 1:
                pairs[other, node] = both
                heapq.heappush(heap, (-len(both), (other, node)))
    return Sharing(leaf, leaves, sums, [sorted(own) for own in nodes])


def item_scores(sharing: Sharing, docs: np.ndarray, terms: np.ndarray, parts: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of all documents of the batch), from the contributions of (document, term) pairs."""
    left = Counter(n for pair in sharing.sums for n in pair) + Counter(n for own in sharing.items for n in own)
    cell = docs * sharing.leaves + sharing.leaf[terms]
    order = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[order], return_index=True)
    flat = np.zeros(n_docs * sharing.leaves, np.int64)
    if len(cells):
        flat[cells] = np.add.reduceat(parts[order], first)
    table = flat.reshape(n_docs, sharing.leaves).T.copy()
    held: dict[int, np.ndarray] = dict(enumerate(table))

    def take(node: int) -> np.ndarray:
        left[node] -= 1
        return held[node] if left[node] else held.pop(node)

    for k, (a, b) in enumerate(sharing.sums):
        held[sharing.leaves + k] = take(a) + take(b)
    for item, nodes in enumerate(sharing.items):
        if nodes:
            yield item, sum((take(n) for n in nodes[1:]), start=take(nodes[0]))


def _term_counts(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id and each document's number of terms, query terms and their occurrences."""

    @F.pandas_udf(TERMS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        absent = len(number)
        for texts in batches:
            n, terms, times = [], [], []
            for own, counts in words_of(texts):
                found = np.fromiter((number.get(w, absent) for w in own), np.int64, len(own))
                text = np.repeat(np.arange(len(counts)), counts)[found < absent]
                keys, occurrences = np.unique(text * absent + found[found < absent], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(1, len(counts)) * absent) if absent else []
                n += counts.tolist()
                terms += np.split((keys % max(absent, 1)).astype(np.int32), cuts) if absent else [keys[:0]] * len(counts)
                times += np.split(occurrences.astype(np.int32), cuts) if absent else [keys[:0]] * len(counts)
            yield pd.DataFrame({"n": n, "terms": terms, "times": times}, columns=TERMS.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), counted("text").alias("_t")).select("doc_id", "_t.*").where("n > 0")


def _weights(counts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents with a term, number of all their terms."""
    total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    weights = np.zeros(terms, np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a block's terms
        weights[row["term"]] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * row["count"] + 1)))
    return weights, total.docs, total.words


def _best(counts: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_words: int, top: int) -> DataFrame:
    """Each task's best documents of each item: (item, doc_id, score)."""
    per_batch = max(1, CELLS // max(1, sharing.leaves + len(sharing.sums)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, len(batch), per_batch):
                rows = batch.iloc[at : at + per_batch]
                lengths = np.fromiter(map(len, rows["terms"]), np.int64, len(rows))
                doc = np.repeat(np.arange(len(rows)), lengths)
                terms, times = (np.concatenate(rows[c].to_list()).astype(np.int64) for c in ("terms", "times"))
                m = 100 - 90 + (90 * rows["n"].to_numpy(np.int64) * n_docs) // n_words
                parts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
                ids = np.array([NO_ID if pd.isna(x) else x for x in rows["doc_id"]], np.int64)
                for item, scores in item_scores(sharing, doc, terms, parts, len(rows)):
                    old_scores, old_ids = best.get(item, (scores[:0], ids[:0]))
                    floor = old_scores[-1] if len(old_scores) == top else 1
                    found = np.flatnonzero(scores >= floor)
                    if not len(found):
                        continue
                    if len(found) > 4 * top:  # the kth best and all its ties suffice
                        found = found[scores[found] >= np.partition(scores[found], -top)[-top]]
                    both, both_ids = np.append(old_scores, scores[found]), np.append(old_ids, ids[found])
                    order = np.lexsort((both_ids, -both))[:top]
                    best[item] = both[order], both_ids[order]
        parts = [pd.DataFrame({"item": item, "doc_id": ids, "score": scores}) for item, (scores, ids) in best.items()]
        if parts:
            yield pd.concat(parts)

    return counts.mapInPandas(search, record(item="int", doc_id="long", score="long"))


def _ranked(candidates: DataFrame, top: int) -> DataFrame:
    """The best of each item over all tasks' candidates; first within parts of an item, then within the item."""
    order = [F.desc("score"), F.asc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))
    fewer = candidates.withColumn("_part", part).withColumn("_r", within).where(F.col("_r") <= top).drop("_r", "_part")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return fewer.withColumn("rank", rank).where(F.col("rank") <= top)


def _search_block(spark: SparkSession, docs: DataFrame, items: list[tuple[object, set[bytes]]], kind: T.DataType, top: int, folder: str) -> DataFrame:
    vocabulary = sorted(set().union(*(own for _, own in items)))
    number = {term: i for i, term in enumerate(vocabulary)}
    _term_counts(docs, number).write.parquet(folder)
    counts = spark.read.parquet(folder)
    weights, n_docs, n_words = _weights(counts, len(number))
    sharing = mine_sharing([{number[term] for term in own} for _, own in items], len(number))
    ranked = _ranked(_best(counts, sharing, weights, n_docs, n_words, top), top)
    names = spark.createDataFrame(
        [(i, item_id) for i, (item_id, _) in enumerate(items)],
        T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
    doc_id = F.when(F.col("doc_id") < int(NO_ID), F.col("doc_id")).alias("doc_id")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    size = F.size(F.array_distinct(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).cast("bigint")
    total = items.agg(F.coalesce(F.sum(F.greatest(size, F.lit(1))), F.lit(0)).alias("n")).first().n
    blocks = -(-total // block)
    found = None
    for b in range(blocks):  # one pass over the documents for each block
        own: dict[object, set[bytes]] = defaultdict(set)
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text")
        for row in rows.toLocalIterator():
            own[row.item_id].update(words(row.text))
        if own := {item_id: terms for item_id, terms in own.items() if terms}:
            folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
            part = _search_block(spark, docs, sorted(own.items(), key=str), kind, top, folder)
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = [T.StructField("item_id", kind), *record(rank="int", doc_id="long", score="long").fields]
        return spark.createDataFrame([], T.StructType(schema))
    return found
