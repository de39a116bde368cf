"""Many streams in one state: a stateful Python step costs milliseconds per key, whatever the key's rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1 << 10
# No leading underscore: such names do not reach a stateful Python step.
BUCKET = "bucket_of_stream"


def bucket_of(keys: Sequence[str]) -> Column:
    """A stream's bucket. Running queries depend on it: a checkpoint is of no use under another number of buckets."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def streams_of(rows: pd.DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[pd.DataFrame, list[tuple]]:
    """The rows by stream and order, and (key, from, to) of each stream. Null is a key like any other."""
    keys = list(keys)
    codes = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    at = np.lexsort([*[rows[c].to_numpy() for c in reversed(order)], codes])
    rows, codes = rows.iloc[at], codes[at]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    first = [tuple(None if pd.isna(k) else k for k in key) for key in rows[keys].iloc[starts].itertuples(index=False, name=None)]
    return rows, list(zip(first, starts.tolist(), [*starts[1:].tolist(), len(rows)]))
