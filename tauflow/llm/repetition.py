"""Quality rules by repetition coverage.

A text's words become numbers; hashes of all runs of 3 and of 5 to 10 words roll over them in numpy (the
hash of n words is that of n - 1 words times a base plus the next word), and the characters of words
inside later occurrences of a run are measured against all word characters, as are repeated lines. Longer
runs are looked at only where runs of five words repeat, since a repeated longer run holds one.

Null has no words; empty texts fail the base rule; texts are taken whole; repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import record

# Largest share of word characters in repeated runs of so many words, in repeated lines,
# share of repeated lines, and of symbols per word.
MOST_IN_RUNS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
MOST_LINE_CHARS, MOST_LINES, MOST_SYMBOLS = 0.30, 0.50, 0.10
SYMBOLS, SPACES = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"

BASE = np.uint64(0x9E3779B97F4A7C15)
MEASURES = record(
    n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long",
    base_failed="boolean", kept="boolean", run_share="double", line_share="double",
)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits (an invertible mix, so different words stay different)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _repeats(codes: np.ndarray, later_only: bool) -> np.ndarray:
    """Which entries occur more than once (or, ``later_only``, occurred before)."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    marked = np.zeros(len(codes), bool)
    marked[order[1:][same]] = True
    if not later_only:
        marked[order[:-1][same]] = True
    return marked


def _covered(marked: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the marked runs of ``n`` words."""
    edges = np.zeros(words + 1, np.int64)
    edges[: len(marked)] += marked
    edges[n:] -= marked[: words + 1 - n]
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()  # bytes split exactly at the six white-space characters
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup_lines, dup_line_chars, lines = set(), 0, 0, 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += len(line) - sum(line.count(c) for c in SPACES)
                seen.add(line)
    repeat_words, run_share, over = 0, 0.0, False
    if n >= 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].reshape(-1)
        triples = pairs[:-1] * len(known) + ids[2:]  # exact: pairs are numbered below n
        repeated = _repeats(triples, later_only=False)
        if repeated.any():
            repeat_words = int(_covered(repeated, 3, n).sum())
            chars = np.array([len(w.decode()) for w in known])[ids]
            hashes = value = _mixed(ids)
            for size in range(2, max(MOST_IN_RUNS) + 1):
                if size > n:
                    break
                value = value[:-1] * BASE + hashes[size - 1 :]
                if size in MOST_IN_RUNS:
                    later = _repeats(value, later_only=True)
                    if not later.any():
                        break
                    share = float(chars[_covered(later, size, n)].sum()) / word_chars
                    run_share = max(run_share, share)
                    over |= share > MOST_IN_RUNS[size]
    base_failed = n < 50 or 100 * repeat_words > 50 * n
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    over |= line_share > MOST_LINE_CHARS or dup_lines > MOST_LINES * lines or n_symbols > MOST_SYMBOLS * n
    return n, word_chars, n_symbols, dup_lines, repeat_words, base_failed, not (base_failed or over), run_share, line_share


@F.pandas_udf(MEASURES)
def repetition_measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES.names)


def apply_quality_rules(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """One row per document row: doc_id, the base counts, base_failed, kept, and the two measured shares."""
    return docs.select("doc_id", repetition_measures(text).alias("_m")).select("doc_id", "_m.*")
