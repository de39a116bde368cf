"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII. A window is ``WINDOW`` consecutive
words of an item (all words of an item that has fewer). Of every six consecutive 5-gram hashes the least is
kept, in documents and items alike; a shared window has all its six 5-grams in common, so it shares the least
one: no shared window is missed. Every hit is then extended to the windows around it, whose words are compared as
text. Items of fewer than ``WINDOW`` words are looked up by the hash of all their words; this is done only for
the lengths that occur.

Fingerprints and windows of the benchmark are broadcast if their counted number is at most ``FEW``; beyond,
the (document, position, hash) rows are shuffled and only documents with hits are read again.

Null texts have no words; items without words have no window; repeated or null ids: rows of equal id and text
share one result and each get their row; items of equal id count once. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import cut, packed

WINDOW, GRAM, FEW = 10, 5, 200_000
SPAN = WINDOW - GRAM + 1

_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Words of a text as an array; every other ASCII character becomes a space."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " "), "")


def _hash_at(hashes: str, at: Column, n: int) -> Column:
    """Hash of the n words from position ``at`` (from 1)."""
    return F.xxhash64(*[F.get(F.col(hashes), at + (j - 1)) for j in range(n)])


def _starts(n: int) -> Column:
    """Positions at which n words begin; empty if there are fewer words."""
    last = F.col("n_words") - (n - 1)
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _numbered(n: int, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.struct(F.lit(n).alias("n"), i.alias("i")))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Add n_words, word and 5-gram hashes, and the winnowed positions to rows with ``words``."""
    rows = rows.withColumn("n_words", F.size("words"))
    rows = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_g", F.transform(_starts(GRAM), lambda i: _hash_at("_h", i, GRAM)))
    least = F.transform(_starts(WINDOW), lambda i: F.least(*[F.get(F.col("_g"), i + (j - 1)) for j in range(SPAN)]))
    rows = rows.withColumn("_m", least)
    # A gram is kept if it is the least of any window around it.
    kept = F.filter(
        _starts(GRAM),
        lambda i: F.exists(
            F.slice(F.col("_m"), F.greatest(i - (SPAN - 1), F.lit(1)), F.least(i, F.lit(SPAN))),
            lambda m: m == F.get(F.col("_g"), i - 1),
        ),
    )
    return rows.withColumn("_at", F.when(F.size("_m") > 0, kept).otherwise(F.array().cast("array<int>")))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(hashes to look up, windows by text with their items, lengths of items shorter than a window)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = cut(with_fingerprints(items))
    short = [r.n_words for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]
    long_prints = items.select(F.lit(WINDOW).alias("n"), F.explode("_at").alias("i"), "_g").select(
        "n", F.get("_g", F.col("i") - 1).alias("hash")
    )
    prints = [long_prints]
    for n in sorted(short):
        prints.append(items.where(F.col("n_words") == n).select(F.lit(n).alias("n"), _hash_at("_h", F.lit(1), n).alias("hash")))
    hashes = prints[0]
    for p in prints[1:]:
        hashes = hashes.unionByName(p)
    size = F.least("n_words", F.lit(WINDOW))
    spans = items.select("item_id", "words", size.alias("n"), F.explode(F.sequence(F.lit(1), F.col("n_words") - size + 1)).alias("i"))
    windows = spans.select(F.array_join(F.slice("words", F.col("i"), F.col("n")), " ").alias("window"), "n", "item_id")
    return cut(hashes.distinct()), cut(windows.groupBy("window", "n").agg(F.collect_set("item_id").alias("items"))), short


def find_contamination(docs: DataFrame, benchmark: DataFrame, few: int = FEW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans, _text.

    ``spans`` are the hit stretches of words: start (from 0) and end; ``_text`` is the hash of the text that was judged.
    """
    hashes, windows, short = benchmark_windows(benchmark)
    small = windows.count() <= few and hashes.count() <= few
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("_text"), words_of(F.col("text")).alias("words"))
    rows = with_fingerprints(base)
    # Position 0 stands for the row itself, so that rows without a hit stay.
    wanted = [_numbered(WINDOW, F.col("_at")), *[_numbered(n, _starts(n)) for n in sorted(short)]]
    itself = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")))
    rows = rows.select("doc_id", "_text", "n_words", "words", "_h", "_g", F.explode(F.concat(itself, *wanted)).alias("_p"))
    rows = rows.select("doc_id", "_text", "n_words", "words", "_h", "_g", F.col("_p.n").alias("n"), F.col("_p.i").alias("i"))
    hashed = F.when(F.col("n") == WINDOW, F.get("_g", F.col("i") - 1))
    for n in short:
        hashed = hashed.when(F.col("n") == n, _hash_at("_h", F.col("i"), n))
    rows = rows.withColumn("hash", F.coalesce(hashed, F.lit(0)))
    prints = hashes.select(F.col("n").alias("_n"), F.col("hash").alias("_hash"))
    meets = (F.col("n") == F.col("_n")) & (F.col("hash") == F.col("_hash"))
    if small:
        found = rows.join(F.broadcast(prints), meets, "left").where(F.col("_n").isNotNull() | (F.col("n") == 0))
    else:
        met = rows.where("n > 0").select("doc_id", "_text", "n", "i", "hash").join(prints, meets, "left_semi")
        met = met.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("n", "i")).alias("_met"))
        met = met.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "_met")
        again = base.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
        places = F.concat(itself, F.coalesce("_met", F.array().cast("array<struct<n:int,i:int>>")))
        again = again.select("doc_id", "_text", F.size("words").alias("n_words"), "words", F.explode(places).alias("_p"))
        found = again.select("doc_id", "_text", "n_words", "words", F.col("_p.n").alias("n"), F.col("_p.i").alias("i"))
    first = F.when(F.col("n") == WINDOW, F.greatest(F.col("i") - (SPAN - 1), F.lit(1))).otherwise(F.col("i"))
    last = F.when(F.col("n") == WINDOW, F.least(F.col("i"), F.col("n_words") - (WINDOW - 1))).otherwise(F.col("i"))
    extended = found.select(
        "doc_id", "_text", "n_words", "words", "n", (F.col("n") == 0).cast("int").alias("_row"),
        F.explode(F.when(F.col("n") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(0)))).alias("start"),
    ).select(
        "doc_id", "_text", "n_words", "_row", "start", F.col("n").alias("_size"),
        F.when(F.col("n") > 0, F.array_join(F.slice("words", F.greatest("start", F.lit(1)), F.greatest("n", F.lit(1))), " ")).alias("_window"),
    )
    met = (F.col("_window") == F.col("window")) & (F.col("_size") == F.col("n"))
    checked = extended.join(F.broadcast(windows) if small else windows, met, "left")
    checked = checked.where((F.col("_row") == 1) | F.col("window").isNotNull())
    hit = F.when(F.col("window").isNotNull(), F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("n")).alias("end")))
    grouped = checked.groupBy("doc_id", "_text").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.sum("_row").cast("int").alias("_rows"),
        F.array_sort(F.collect_set(hit)).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("items").cast("array<string>"))))).alias("item_ids"),
    )
    # Join overlapping stretches; hits are in order of their start.
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def grow(spans: Column, s: Column) -> Column:
        top = F.element_at(spans, -1)
        joined = F.concat(
            F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(top.start.alias("start"), F.greatest(top.end, s.end).alias("end")))
        )
        return F.when((F.size(spans) > 0) & (s.start <= F.get(spans, F.size(spans) - 1).end), joined).otherwise(F.concat(spans, F.array(s)))

    spans = F.when(F.size("_hits") > 0, F.aggregate("_hits", nothing, grow)).otherwise(nothing)
    out = grouped.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"),
        "item_ids", "spans", "_text", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"),
    ).drop("_copy")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, columns as they were; each text of an id, or of none, is judged by itself."""
    found = find_contamination(docs, benchmark).where("contaminated")
    found = found.select(F.col("doc_id").alias("_bad"), F.col("_text").alias("_of")).distinct()
    rows = packed(docs).withColumn("_text", F.xxhash64(F.coalesce(F.col("_doc.text"), F.lit(""))))
    rows = rows.join(found, F.col("_doc.doc_id").eqNullSafe(F.col("_bad")) & (F.col("_text") == F.col("_of")), "left_anti")
    return rows.select("_doc.*")
