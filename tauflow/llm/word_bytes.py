"""Words of whole texts as bytes: runs of a-z, 0-9 and anything beyond ASCII, with A-Z lower-cased and nothing else changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))
#: Bytes of text worked on together; only memory depends on it.
CHUNK = 1 << 21


def words(text: str | None) -> list[bytes]:
    """Words of one text. UTF-8 bytes of characters beyond ASCII are all 128 or more, so bytes split where characters do."""
    return text.encode().translate(_TO_WORDS).split() if isinstance(text, str) else []


def words_of(texts: pd.Series) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of successive texts end to end, and the number of words of each text, in chunks of bounded size (or one text)."""
    joined, counts, size = [], [], 0
    for text in texts:
        own = words(text)
        joined += own
        counts.append(len(own))
        size += len(text) if isinstance(text, str) else 0
        if size >= CHUNK:
            yield joined, np.array(counts, np.int64)
            joined, counts, size = [], [], 0
    if counts:
        yield joined, np.array(counts, np.int64)
