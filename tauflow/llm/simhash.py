"""SimHash near-duplicates by multi-index hashing.

Fingerprint of a text: lower-case A-Z, words are runs without white space, shingles are four words joined by
a space (fewer words: the whole sequence), hashed by XXH64 with seed 42; a bit is set if it is set in over half of the
hashes. No words: fingerprint zero.

Equal fingerprints are one row first, however many copies there are. The 64 bits are cut into segments so
that two fingerprints within the distance agree in one segment up to a small radius (distance divided by
segments): every fingerprint looks up all values within that radius of each of its segments in the table
of segments, and the whole distance is verified inside the join, which puts out links only. Up to 2^24
different fingerprints there are three segments (radius 1 for distance 4); beyond, two (radius 2), so that a
segment's value stays rare; both find every link.

Null texts count as empty. A null doc_id takes part but is never a component's id unless the component has
no other; repeated rows each get their row; ties need no rule. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.llm.common import cut, packed
from tauflow.llm.graph import connected_components

SHINGLE, SEED, DISTANCE, FEW = 4, 42, 4, 1 << 24
_CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """Fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    pieces = list(zip(starts, ends[SHINGLE - 1 :].tolist())) or [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(pieces), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces[at : at + _CHUNK]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(pieces))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def near_links(prints: DataFrame, distance: int = DISTANCE, segments: int = 3) -> DataFrame:
    """Links (a < b) between different fingerprints (column ``fp``, distinct) that differ in at most ``distance`` bits."""
    radius = distance // segments
    parts = [
        (i, F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1), _flips(width, radius))
        for i, (shift, width) in enumerate(_segments(segments))
    ]

    def key(i: int, value: Column) -> Column:
        return F.struct(F.lit(i).cast("byte").alias("segment"), value.alias("value"))

    table = prints.select(F.col("fp").alias("b"), F.explode(F.array(*[key(i, v) for i, v, _ in parts])).alias("key"))

    def around(i: int, value: Column, flips: list[int]) -> Column:
        masks = F.array(*[F.lit(f).cast("bigint") for f in flips])
        return F.transform(masks, lambda mask: key(i, value.bitwiseXOR(mask)))

    probes = prints.select(F.col("fp").alias("a"), F.explode(F.concat(*[around(*p) for p in parts])).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    probes = probes.select("a", F.col("key.segment").alias("s"), F.col("key.value").alias("v"))
    table = table.select("b", F.col("key.segment").alias("ts"), F.col("key.value").alias("tv"))
    return probes.join(table, (F.col("s") == F.col("ts")) & (F.col("v") == F.col("tv")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: Column | str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = cut(docs.select("doc_id", fingerprint(text).alias("fp")))
    return rows.join(_components(rows, distance), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id) for the fingerprints of ``rows`` (doc_id, fp); root tells components apart, whatever the ids."""
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(prints.select("fp"), distance, 3 if prints.count() <= FEW else 2)
    roots = connected_components(links)
    linked = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(of_root, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Keep one row of each component: the one with the smallest doc_id (nulls last), then text hash; columns as they were.

    Ids need not be unique: rows of one id with unlike texts are in components of their own.
    """
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = cut(docs.select("doc_id", hashed.alias("_text"), fingerprint("text").alias("fp")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    first = rows.join(_components(rows, distance), "fp").groupBy("root").agg(F.min(place).alias("f"))
    first = first.select(F.col("f.doc_id").alias("_id"), F.col("f._text").alias("_of"))
    whole = packed(docs).withColumn("_text", F.xxhash64(F.coalesce(F.col("_doc.text"), F.lit(""))))
    found = whole.join(first, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left_semi")
    order = Window.partitionBy("_doc.doc_id", "_text").orderBy(F.col("_doc.text").asc_nulls_last())
    return found.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("_doc.*")
