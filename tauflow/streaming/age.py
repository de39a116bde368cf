"""Running Age of Information: mean and percentile of every stream, kept up to date as events arrive.

State of a stream, whatever its length: the last time, the number, sum and sum of squares of the gaps, and a histogram of gap
lengths by their ``BITS`` leading bits (count and sum for each bin, so at most 64 * 2^(BITS - 1) bins and a relative width
of 2^-(BITS - 1)). The mean is that of the batch operator; the percentile is solved inside the bin that
holds it, so it is off by at most the bin's width. A time that goes back gives no gap, but the clock follows it.

Events of a micro-batch are taken in order of arrival. Streams share ``BUCKETS`` states by a hash of their keys, so that many
short streams cost no state call and no Arrow batch each. A task holds the events that one bucket has in one
micro-batch, which ``maxFilesPerTrigger`` of the source bounds, and the bucket's states.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tauflow.streaming.buckets import BUCKET, bucket_of, streams_of

BITS, P = 11, 0.95
NS_PER_MS = 1e6

_long = T.LongType()
#: Streams of the bucket, pickled: last time, number, sum and sum of squares of the gaps, bins by their lows.
STATE = T.StructType([T.StructField("streams", T.BinaryType())])


def bin_low(gap: int) -> int:
    """Least gap of the bin: the leading bits, with zeros after them."""
    return gap >> (shift := max(0, gap.bit_length() - BITS)) << shift


def bin_high(low: int) -> int:
    return low + (1 << max(0, low.bit_length() - BITS)) - 1


def histogram_percentile(lows: Sequence[int], counts: Sequence[int], sums: Sequence[int], p: float = P) -> float | None:
    """The age not exceeded for a share ``p`` of the time: exact between bins, else off by less than a bin; None without a positive gap."""
    n_left, total = sum(counts), sum(sums)
    if total <= 0:
        return None
    target, below = p * total, 0
    for low, count, own in sorted(zip(lows, counts, sums)):
        if below + own + bin_high(low) * (n_left - count) >= target:
            return min((target - below) / n_left, bin_high(low))
        n_left, below = n_left - count, below + own
    return float(bin_high(max(lows)))


def stream_age(arrivals: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_recv_ns", "seq"), p: float = P) -> DataFrame:
    """(keys, n_gaps, last_ts_ns, aoi_mean_ms, aoi_p95_ms) of each stream with news, after every micro-batch."""
    keys, order = list(keys), list(order)
    fields = {f.name: f for f in arrivals.schema}
    out = T.StructType([fields[k] for k in keys] + [
        T.StructField("n_gaps", _long), T.StructField("last_ts_ns", _long), T.StructField("aoi_mean_ms", T.DoubleType()),
        T.StructField("aoi_p95_ms", T.DoubleType())])

    def advanced(known: tuple | None, times: np.ndarray) -> tuple:
        if known is None:
            n = total = squares = 0
            bins = {}
        else:
            last, n, total, squares, bins = known
            times = np.append(np.int64(last), times)
        gaps = np.diff(times)
        for gap, count in zip(*(x.tolist() for x in np.unique(gaps[gaps >= 0], return_counts=True))):
            n, total, squares = n + count, total + gap * count, squares + gap * gap * count
            own = bins.setdefault(bin_low(gap), [0, 0])
            own[0] += count
            own[1] += gap * count
        return int(times[-1]), n, total, squares, bins

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streams, rows = pickle.loads(state.get[0]) if state.exists else {}, []
        events = pd.concat(list(batches), ignore_index=True)
        events, runs = streams_of(events, keys, order)
        times = events["ts_ns"].to_numpy(np.int64)
        for stream, a, b in runs:
            last, n, total, squares, bins = streams[stream] = advanced(streams.get(stream), times[a:b])
            age = histogram_percentile(list(bins), [c for c, _ in bins.values()], [s for _, s in bins.values()], p)
            mean = squares / (2 * total) / NS_PER_MS if total > 0 else None
            rows.append((*stream, n, last, mean, None if age is None else age / NS_PER_MS))
        state.update((pickle.dumps(streams),))
        yield pd.DataFrame(rows, columns=out.names)

    bucketed = arrivals.select(bucket_of(keys).alias(BUCKET), *dict.fromkeys([*keys, *order, "ts_ns"]))
    return bucketed.groupBy(BUCKET).applyInPandasWithState(update, out, STATE, "update", GroupStateTimeout.NoTimeout)
