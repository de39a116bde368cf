"""Send on delta: which readings of a stream are worth sending, for any number of settings at once.

Readings are shuffled once by stream, sorted, and run through the step batch by batch with the state
carried along, so a task holds one Arrow batch whatever the length of the stream; all settings of a
sweep are run in that one pass instead of once per setting over multiplied rows.

A stream too long for one task is cut into time slices. What the step needs at the start of a slice
is the forecast and the time of the last message, and both can be had without running the earlier
slices one after the other, with the same bits as a sequential run:

- the forecast after a slice hardly depends on the one before it: the step is monotone in the forecast, so if
  runs over the slice's last rows from just below the least and just above the largest reading of the stream
  end in the same double, every start does. A slice after which they differ (few rows, small alpha) is joined
  with the next one;
- given the forecasts, the last message of a slice depends only on the last one before it, as a
  step function (it matters only until the first possible message); folding the step functions gives
  the time of the last message before every slice.

Then all slices run in parallel. Readings pass through Python as Arrow tables, so no number is ever converted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.functions.quantize import quantize, sensor_range
from tauflow.operators.sequence import MAX_ROWS, SLICE, cut_long_streams
from tauflow.operators.trigger import PERIODIC, Trigger, replay
from tauflow.schemas import STREAM
from tauflow.session import staged

_SEED, _LAST, _CUT = "_seed", "_last_sent", "_cut"
_NEVER = -(2**63) + 1
_NO_LIMIT = 2**63 - 1
_TAIL = 1 << 14
# A first slice of at most so many rows is run row by row: arrays cost more than they save.
_FEW_ROWS = 512


def usable(value: Column, valid: Column | None = None) -> Column:
    """Readings that count: flagged valid and finite. Others change no state, so they can be left out."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return finite if valid is None else finite & valid


def send_on_delta(
    samples: DataFrame,
    triggers: Sequence[Trigger],
    keys: Sequence[str] = STREAM,
    value: str = "x",
    valid: str | None = None,
    max_rows: int | None = MAX_ROWS,
    keep_slices: bool = False,
) -> DataFrame:
    """Events of each stream under each trigger that applies to its sensor.

    Adds ``setting`` (position in ``triggers``), the quantized ``val``, ``pred``, ``res``, ``tau``, ``kbits``,
    ``policy`` and ``reason`` to the columns of the reading; ``keys`` must contain ``sensor``. With ``keep_slices`` and a
    stream that was cut, column ``_slice`` tells the slice of the reading, so that a later step need not cut again.
    """
    keys, triggers = list(keys), list(triggers)
    rows = samples.where(usable(F.col(value), None if valid is None else F.col(valid)))
    rows = rows.drop("policy", "pred", "res", "tau", "kbits", "val", "reason", "setting")
    rows = cut_long_streams(rows.withColumn(value, F.col(value).cast("double")), keys, max_rows=max_rows)
    if SLICE in rows.columns:
        rows, seeds = _slice_states(rows, keys, value, triggers)
        rows = _with_seeds(rows if keep_slices else rows.drop(_CUT), seeds)
    else:
        rows = rows.withColumn(SLICE, F.lit(None).cast("bigint"))
        rows = rows.withColumn(_SEED, F.lit(None).cast("int")).withColumn(_LAST, F.lit(None).cast("bigint"))
    carried = [c for c in (*samples.columns, _CUT) if c in rows.columns]
    out = T.StructType(
        [f for f in rows.schema if f.name in carried]
        + [
            T.StructField("setting", T.IntegerType()),
            T.StructField("pred", T.DoubleType()),
            T.StructField("res", T.DoubleType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    sent = _in_stream_order(rows, keys).mapInArrow(_sender(keys, value, triggers, carried), out)
    return with_setting(sent, value, triggers).withColumnRenamed(_CUT, SLICE)


def with_setting(sent: DataFrame, value: str, triggers: Sequence[Trigger]) -> DataFrame:
    """Add the settings' columns and the quantized value to what the step has chosen."""
    table = F.array(*[
        F.struct(
            F.lit(float(t.tau)).alias("tau"), F.lit(t.kbits).alias("kbits"), F.lit(t.policy).alias("policy"),
            F.lit(t.vmin).cast("double").alias("vmin"), F.lit(t.vmax).cast("double").alias("vmax"),
        )
        for t in triggers
    ])
    used = sent.withColumn("_t", F.get(table, F.col("setting")))
    vmin, vmax = sensor_range(F.col("sensor"), F.col("_t.vmin"), F.col("_t.vmax"))
    return used.select(
        *[c for c in sent.columns],
        quantize(F.col(value), F.col("_t.kbits"), vmin, vmax).getField("q").alias("val"),
        F.col("_t.tau").alias("tau"),
        F.col("_t.kbits").alias("kbits"),
        F.col("_t.policy").alias("policy"),
    )


def _in_stream_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, SLICE]
    # Seed rows of a slice sort before its readings.
    return rows.repartition(*by).sortWithinPartitions(*by, F.col(_SEED).isNull(), "ts_ns", "seq")


def _with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = rows.withColumn(_SEED, F.lit(None).cast("int")).withColumn(_LAST, F.lit(None).cast("bigint"))
    return rows.unionByName(seeds, allowMissingColumns=True)


def _longs(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _pieces(batch: pa.RecordBatch, keys: list[str]):
    """(key, from, to) of each run of rows of one stream slice in a sorted batch."""
    slices = _longs(batch, SLICE, -1)
    changed = np.append(True, slices[1:] != slices[:-1])
    columns = []
    for k in keys:
        codes = batch.column(k).dictionary_encode()
        numbers = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changed[1:] |= numbers[1:] != numbers[:-1]
        columns.append(batch.column(k))
    starts = np.flatnonzero(changed)
    values = [c.take(pa.array(starts)).to_pylist() for c in columns] + [slices[starts].tolist()]
    return list(zip(zip(*values), starts.tolist(), [*starts[1:].tolist(), batch.num_rows]))


def _sender(keys: list[str], value: str, triggers: list[Trigger], carried: list[str]):
    sensor_at = keys.index("sensor")

    def send(batches):
        current, states = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            times, values = _longs(batch, "ts_ns").tolist(), _doubles(batch, value).tolist()
            seeds, lasts = _longs(batch, _SEED, -1).tolist(), batch.column(_LAST)
            rows, settings, preds, residuals, reasons = [], [], [], [], []
            for key, a, b in _pieces(batch, keys):
                if key != current:
                    current = key
                    states = {i: (None, None) for i, t in enumerate(triggers) if t.applies_to(key[sensor_at])}
                while a < b and seeds[a] >= 0:
                    states[seeds[a]] = (values[a], lasts[a].as_py())
                    a += 1
                for i, (forecast, last_sent) in states.items():
                    at, p, r, why, *states_i = replay(triggers[i], times[a:b], values[a:b], forecast, last_sent)
                    states[i] = tuple(states_i)
                    rows += [a + j for j in at]
                    settings += [i] * len(at)
                    preds += p
                    residuals += r
                    reasons += why
            taken = batch.select(carried).take(pa.array(rows, pa.int64()))
            added = [pa.array(settings, pa.int32()), pa.array(preds, pa.float64()), pa.array(residuals, pa.float64()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *added], names=[*carried, "setting", "pred", "res", "reason"])

    return send


# ---- start states of the slices of long streams


def _slice_states(rows: DataFrame, keys: list[str], value: str, triggers: list[Trigger]) -> tuple[DataFrame, DataFrame]:
    """The rows, slices joined where needed (``_cut``: as they were), and seed rows (keys, slice, value = forecast, last message).

    There is a seed for every setting and slice but a stream's first. Streams that are not cut have slice null. Rows and the
    table of slices are written once, as three passes read them; nothing here has a cost per stream but its rows.
    """
    rows = staged(rows, "sliced-readings")
    long_rows = rows.where(F.col(SLICE).isNotNull()).select(*keys, SLICE, "ts_ns", "seq", value)
    key_fields = [f for f in rows.schema if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    slice_fields = [*key_fields, T.StructField(SLICE, T.LongType())]

    def schema(*extra):
        return T.StructType([*slice_fields, *[T.StructField(n, t) for n, t in extra]])

    longs = T.ArrayType(T.LongType())
    no_seed = long_rows.withColumn(_SEED, F.lit(None).cast("int"))

    # Least and largest reading of the stream come as the first two rows of each of its slices.
    stream = Window.partitionBy(*keys)
    bounds = long_rows.groupBy(*keys, SLICE).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    both = F.array(F.min("_low").over(stream), F.max("_high").over(stream))
    bounds = bounds.select(*keys, SLICE, both.alias("_both")).select(*keys, SLICE, F.posexplode("_both").alias(_SEED, value))
    bounded = no_seed.unionByName(bounds, allowMissingColumns=True)
    ends = _in_stream_order(bounded, keys).mapInArrow(
        _slice_ends(keys, value, triggers), schema(("ends", T.ArrayType(T.DoubleType())))
    )
    joined = staged(_joined_slices(ends, keys, triggers), "joined-slices")

    def renumbered(df: DataFrame, parts: DataFrame, how: str) -> DataFrame:
        there = parts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_of"), "_part")
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)] + [F.col(SLICE) == F.col("_of")]
        moved = df.join(there, reduce(Column.__and__, same), how)
        return moved.withColumn(SLICE, F.coalesce("_part", SLICE)).select(*df.columns)

    starts = joined.where((F.col(SLICE) == F.col("_part")) & F.col("starts").isNotNull())
    seeds = starts.select(*keys, SLICE, "_final", F.posexplode("starts").alias(_SEED, value)).where(F.col(value).isNotNull())
    # Nothing follows a stream's final slice, so its last message is not needed.
    followed = renumbered(no_seed, joined.where(~F.col("_final")), "inner")
    followed = followed.unionByName(seeds.where(~F.col("_final")).drop("_final"), allowMissingColumns=True)
    steps = _in_stream_order(followed, keys).mapInArrow(
        _last_sent_steps(keys, value, triggers), schema((_SEED, T.IntegerType()), ("until", longs), ("sent", longs))
    )
    # The seed of a slice comes before the step of that slice.
    by = [*keys, _SEED, SLICE]
    turns = seeds.drop("_final").unionByName(steps, allowMissingColumns=True)
    turns = turns.repartition(*keys, _SEED).sortWithinPartitions(*by, F.col("until").isNotNull())
    states = turns.mapInArrow(
        _fold_last_sent(keys, value), schema((_SEED, T.IntegerType()), (value, T.DoubleType()), (_LAST, T.LongType()))
    )
    return renumbered(rows.withColumn(_CUT, F.col(SLICE)), joined, "left"), states


def _joined_slices(ends: DataFrame, keys: list[str], triggers: list[Trigger]) -> DataFrame:
    """Slices with ``_part``, the first slice of those joined; ``starts``, the forecasts before it where they are known; ``_final``.

    A slice starts a part if the forecasts after the slice before it are known for all settings of the sensor.
    """
    in_order = Window.partitionBy(*keys).orderBy(SLICE)
    before = ends.withColumn("_before", F.lag("ends").over(in_order))
    known = F.col("_before").isNotNull()
    for i, t in enumerate(triggers):
        end = F.get("_before", F.lit(i))
        applies = F.lit(True) if t.sensor is None else F.col("sensor").eqNullSafe(F.lit(t.sensor))
        known = known & (~applies | (end.isNotNull() & ~F.isnan(end)))
    before = before.withColumn("_known", known).withColumn("_first", F.lag(SLICE).over(in_order).isNull())
    part = F.max(F.when(F.col("_known") | F.col("_first"), F.col(SLICE))).over(in_order)
    found = before.withColumn("_part", part).withColumn("_final", F.col("_part") == F.max("_part").over(Window.partitionBy(*keys)))
    return found.select(*keys, SLICE, "_part", "_final", F.when(F.col("_known"), F.col("_before")).alias("starts"))


def _after(alpha: float, forecast: float, values: list) -> float:
    """Forecast after some readings; the arithmetic is that of the step."""
    keep = 1.0 - alpha
    for x in values:
        forecast = alpha * x + keep * forecast
    return forecast


def _slice_ends(keys: list[str], value: str, triggers: list[Trigger]):
    """Per slice the forecast after it for each setting, null where it depends on the one before it.

    Only the last rows of a slice are held; a stream's first slice is run as a whole, batch by batch.
    """
    sensor_at = keys.index("sensor")

    def finish(key, first, tail, low, high):
        out = []
        margin = (abs(low) + abs(high) + 1.0) * 1e-9
        for i, t in enumerate(triggers):
            if not t.applies_to(key[sensor_at]):
                out.append(None)
            elif first is not None:
                out.append(first[i])
            else:
                below, above = _after(t.alpha, low - margin, tail), _after(t.alpha, high + margin, tail)
                out.append(below if below == above else None)
        return out

    def ends(batches):
        current, first, tail, low, high = None, None, [], 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            seed, values = _longs(batch, _SEED, -1).tolist(), _doubles(batch, value).tolist()
            for key, a, b in _pieces(batch, keys):
                if key != current:
                    if current is not None:
                        done.append([*current, finish(current, first, tail, low, high)])
                    current, first, tail = key, None, []
                while a < b and seed[a] >= 0:
                    low, high = (values[a], high) if seed[a] == 0 else (low, values[a])
                    a += 1
                if key[-1] == 0 and a < b:
                    if first is None:
                        first = [values[a]] * len(triggers)
                        a += 1
                    first = [_after(t.alpha, f, values[a:b]) for t, f in zip(triggers, first)]
                else:
                    tail = (tail + values[a:b])[-_TAIL:]
            if done:
                yield _as_batch(done, batch, keys, [("ends", pa.list_(pa.float64()))])
        if current is not None:
            yield _as_batch([[*current, finish(current, first, tail, low, high)]], batch, keys, [("ends", pa.list_(pa.float64()))])

    return ends


def _as_batch(rows: list, like: pa.RecordBatch, keys: list[str], extra: list) -> pa.RecordBatch:
    """Rows of keys, slice and the ``extra`` (name, type) columns; keys have the types they have in ``like``."""
    kinds = [*[like.schema.field(k).type for k in keys], pa.int64(), *[kind for _, kind in extra]]
    arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, SLICE, *[name for name, _ in extra]])


def last_sent_steps(trigger: Trigger, times: np.ndarray, exceeds: np.ndarray, is_first: bool):
    """How the last message of a slice depends on the last one before it.

    Returns ascending ``until`` and ``sent``: if the message before the slice was sent at or before
    ``until[j]`` (and after ``until[j - 1]``), the slice's last message is sent at ``sent[j]``; after the
    last ``until``, the slice sends nothing.
    """
    n = len(times)
    index = np.arange(n)
    if trigger.policy == PERIODIC:
        return np.array([_NO_LIMIT]), times[-1:]
    guard, silence = trigger.guard_ns, trigger.heartbeat_ns
    # Next message after one at each row: first row above tau once the guard has passed, or the heartbeat.
    next_exceeding = np.append(np.minimum.accumulate(np.where(exceeds, index, n)[::-1])[::-1], n)
    following = next_exceeding[np.maximum(np.searchsorted(times, times + guard), index + 1)]
    until = np.where(exceeds, times - guard, _NEVER - 1)
    if silence is not None:
        wait = max(silence, guard)
        following = np.minimum(following, np.maximum(np.searchsorted(times, times + wait), index + 1))
        until = np.maximum(until, times - wait)
    if is_first and trigger.bootstrap:
        until[0] = _NO_LIMIT
    # Follow the chains to their ends, doubling the stride.
    end = np.where(following < n, following, index)
    while not np.array_equal(end, end[end]):
        end = end[end]
    best = np.maximum.accumulate(until)
    steps = np.flatnonzero(until > np.append(_NEVER - 1, best[:-1]))
    if len(steps):
        # A message before the slice is no later than its first row.
        enough = np.searchsorted(until[steps], times[0])
        steps = steps[: enough + 1]
    return until[steps], times[end[steps]]


def _last_sent_steps(keys: list[str], value: str, triggers: list[Trigger]):
    sensor_at = keys.index("sensor")

    def finish(key, seeds, times, values):
        times, values = np.concatenate(times), np.concatenate(values)
        out = []
        for i, t in enumerate(triggers):
            if not t.applies_to(key[sensor_at]):
                continue
            forecast, keep = seeds.get(i), 1.0 - t.alpha
            if forecast is None and len(times) <= _FEW_ROWS:  # a stream's first slice: nothing was sent before it
                last = replay(t, times.tolist(), values.tolist(), None, None)[-1]
                out.append([*key, i, *([[], []] if last is None else [[_NO_LIMIT], [last]])])
                continue
            start, rest = (values[0], values[1:]) if forecast is None else (forecast, values)
            run = list(accumulate(rest.tolist(), lambda f, x, a=t.alpha, k=keep: a * x + k * f, initial=float(start)))[:-1]
            expected = np.array(([float(start)] if forecast is None else []) + run)
            until, sent = last_sent_steps(t, times, np.abs(values - expected) > t.tau, forecast is None)
            out.append([*key, i, until.tolist(), sent.tolist()])
        return out

    def steps(batches):
        longs = pa.list_(pa.int64())
        extra = [(_SEED, pa.int32()), ("until", longs), ("sent", longs)]
        current, seeds, times, values = None, {}, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            seed, ts, x = _longs(batch, _SEED, -1).tolist(), _longs(batch, "ts_ns"), _doubles(batch, value)
            for key, a, b in _pieces(batch, keys):
                if key != current:
                    if times:
                        done += finish(current, seeds, times, values)
                    current, seeds, times, values = key, {}, [], []
                while a < b and seed[a] >= 0:
                    seeds[seed[a]] = float(x[a])
                    a += 1
                if a < b:
                    times.append(ts[a:b])
                    values.append(x[a:b])
            if done:
                yield _as_batch(done, batch, keys, extra)
        if times and (made := finish(current, seeds, times, values)):
            yield _as_batch(made, batch, keys, extra)

    return steps


def _fold_last_sent(keys: list[str], value: str):
    """Goes through the slices of each stream and setting in order: a seed is given the last message before its slice, a step moves it on."""

    def fold(batches):
        current, last = None, _NEVER
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            columns = [batch.column(c).to_pylist() for c in (*keys, SLICE, _SEED, value, "until", "sent")]
            for *key, number, setting, forecast, until, sent in zip(*columns):
                if (key, setting) != current:
                    current, last = (key, setting), _NEVER
                if until is None:
                    out.append([*key, number, setting, forecast, None if last == _NEVER else last])
                    continue
                step = bisect_left(until, last)
                if step < len(until):
                    last = sent[step]
            if out:
                yield _as_batch(out, batch, keys, [(_SEED, pa.int32()), (value, pa.float64()), (_LAST, pa.int64())])

    return fold
