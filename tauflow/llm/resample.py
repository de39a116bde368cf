"""Importance resampling towards a target distribution.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The
CRC of a run follows from those of its words (a CRC of joined bytes is the first one moved on by the second's
length, exclusive or the second), so features are never spelled out: numpy works on the words' CRCs and lengths.
Bucket counts of each partition are summed by Spark; at most ``BUCKETS`` gains reach the driver and the tasks.

Weights and scores are written once, with a row number. The cut-off is found by bisection of the numbers (score, then
doc_id among rows of that score, then row number among rows of that id): every step is an exact count job over the
written table with ``WAYS - 1`` thresholds at once, so 64-bit keys need at most 13 jobs and no row is sorted. Rows
beyond the cut-off are dealt out by key ranges, sorted within their range and numbered; the ranges' sizes give the
rank of each row. All other rows keep a null rank and are not moved.

Null texts have no words and no features; so do empty ones: weight 0, never drawn. Texts are taken whole. Equal scores
go by doc_id (null last), equal rows by row number: of repeated rows each is a row of its own. With no documents the
result is empty; without benchmark texts T and t are 0. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import record, shared_folder
from tauflow.llm.word_bytes import words_of

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: A bisection step compares so many parts at once.
WAYS = 32
#: Words shorter than this share one table of moved CRCs; only time depends on it.
SHORT = 64
LAST_ID = (1 << 63) - 1
COUNTS = record(bucket="long", n="long")
MEASURES = record(n_words="long", n_features="long", weight="long")


@lru_cache(4096)
def _moved(length: int) -> np.ndarray:
    """Four rows of 256: what each byte of a CRC turns into when ``length`` further bytes follow (the four are XORed)."""
    if length > 1:
        return _move(_moved(length // 2), _moved(length - length // 2))
    zeros = bytes(length)
    start = zlib.crc32(zeros)  # CRCs are affine; the constant part is that of zeros alone
    return np.array([[zlib.crc32(zeros, byte << shift) ^ start for byte in range(256)] for shift in (0, 8, 16, 24)], np.uint32)


def _move(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


@cache
def _short_moves() -> np.ndarray:
    return np.array([_moved(length) for length in range(SHORT)]).reshape(-1)


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined bytes from the CRCs of both parts and the second part's lengths."""
    table, at = _short_moves(), np.where(length < SHORT, length, 0) << 10
    out = second ^ table[at + (first & 255)]
    for i in (1, 2, 3):
        out ^= table[at + 256 * i + (first >> (8 * i) & 255)]
    for i in np.flatnonzero(length >= SHORT).tolist():
        out[i] = second[i] ^ _move(first[i : i + 1], _moved(int(length[i])))[0]
    return out


def feature_buckets(words: list[bytes], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: the buckets of all runs inside one text, and the number of the text of each."""
    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    run = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    yield run % BUCKETS, text
    length = np.fromiter(map(len, words), np.int64, n) + 1
    # a word with a space before it: the space's CRC moved on by the word
    spaced = _joined(np.full(n, zlib.crc32(b" "), np.uint32), run, length - 1)
    for more in range(1, LONGEST):
        if n <= more:
            return
        run = _joined(run[:-1], spaced[more:], length[more:])
        inside = text[more:] == text[:-more]
        yield run[inside] % BUCKETS, text[more:][inside]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """Features of all texts by bucket: (bucket, n), without empty buckets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, counts in words_of(batch["text"]):
                for buckets, _ in feature_buckets(words, counts):
                    total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    return texts.select("text").mapInPandas(count, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the documents; one number for each bucket."""
    totals = []
    for texts in (docs, target):
        n = np.zeros(BUCKETS, np.int64)
        for row in bucket_counts(texts).collect():  # at most BUCKETS rows
            n[row.bucket] = row.n
        totals.append(n)
    s, t = (x.astype(float) for x in totals)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row per document row."""

    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for words, counts in words_of(texts):
                n, weight = np.zeros((2, len(counts)), np.int64)
                for buckets, text in feature_buckets(words, counts):
                    n += np.bincount(text, minlength=len(counts))
                    ends = np.cumsum(np.bincount(text, minlength=len(counts)))
                    sums = np.append(0, np.cumsum(gains[buckets]))[np.append(0, ends)]
                    weight += np.diff(sums)
                parts.append(np.column_stack([counts, n, weight]))
            yield pd.DataFrame(np.concatenate(parts or [np.zeros((0, 3), np.int64)]), columns=MEASURES.names)

    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return docs.select("doc_id", measured("text").alias("_m"), noise.alias("_noise")).select(
        "doc_id", "_m.*", (F.col("_m.weight") + F.col("_noise")).alias("score"))


def _nth(rows: DataFrame, key: str, n: int) -> tuple[int, int]:
    """The n-th smallest ``key`` (from 1) and how many rows lie below it, by bisection with exact counts."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        steps = sorted({low + (high - low) * i // WAYS for i in range(1, WAYS)} - {low} | {high})
        counts = rows.where(F.col(key).between(low, high)).agg(
            *[F.count_if(F.col(key) < F.lit(step)).alias(f"c{i}") for i, step in enumerate(steps)]).first()
        under = sum(1 for c in counts if below + c < n)  # thresholds with fewer than n rows below them
        below += counts[under - 1] if under else 0
        low, high = steps[under - 1] if under else low, steps[under] - 1 if under < len(steps) else high
    return low, below


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (1 for the highest score) to floor(percent * N / 100) of the N rows with enough words, null to all others."""
    spark = scored.sparkSession
    folder = f"{shared_folder(spark)}/resample-{uuid.uuid4().hex}"
    row = F.monotonically_increasing_id()  # kept with the row by the write
    keyed = scored.withColumns({
        "_down": -F.col("score"), "_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), "_row": row})
    keyed.write.parquet(f"{folder}/scored")
    keyed = spark.read.parquet(f"{folder}/scored")
    usable = keyed.where(F.col("n_words") >= least_words)
    keys = ("_down", "_id", "_row")
    wanted = percent * usable.count() // 100
    names = scored.columns
    if not wanted:
        return keyed.select(*names, F.lit(None).cast("bigint").alias("rank"))
    drawn, rows, left = F.lit(False), usable, wanted
    equal = F.col("n_words") >= least_words
    for key in keys:
        cut, below = _nth(rows, key, left)
        drawn = drawn | (equal & (F.col(key) < cut))
        equal = equal & (F.col(key) == cut)
        rows, left = rows.where(F.col(key) == cut), left - below
    drawn = drawn | equal  # row numbers are unique
    ordered = keyed.where(drawn).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{folder}/drawn")
    placed = spark.read.parquet(f"{folder}/drawn")
    part = F.shiftright("_place", 33)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each range
    starts = [(p, s - n) for (p, n), s in zip(sizes, accumulate(n for _, n in sizes))]
    starts = spark.createDataFrame(starts, "_part bigint, _start bigint")
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    ranked = placed.join(F.broadcast(starts), part == F.col("_part")).select(*names, (F.col("_start") + within + 1).alias("rank"))
    return keyed.where(~drawn).select(*names, F.lit(None).cast("bigint").alias("rank")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_features, weight, score, rank, n_words."""
    drawn = draw(weigh(docs, bucket_gains(docs, target)), percent)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
