"""Send on delta over a stream of readings, with the batch step and one small state per stream."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tauflow.operators.delta import usable, with_setting
from tauflow.operators.trigger import Trigger, replay
from tauflow.schemas import STREAM
from tauflow.session import STATE_STORE

_STATE = T.StructType([
    T.StructField("forecast", T.ArrayType(T.DoubleType())),
    T.StructField("last_sent", T.ArrayType(T.LongType())),
])


class _Sender(StatefulProcessor):
    """Per stream: forecast and time of the last message, one of each per setting."""

    def __init__(self, triggers: list[Trigger], value: str, carried: list[str], sensor_at: int):
        self.triggers, self.value, self.carried, self.sensor_at = triggers, value, carried, sensor_at

    def init(self, handle):
        self.state = handle.getValueState("sender", _STATE)

    def handleInputRows(self, key, rows, timer_values):
        n = len(self.triggers)
        forecasts, last_sent = self.state.get() if self.state.exists() else ([None] * n, [None] * n)
        forecasts, last_sent = list(forecasts), list(last_sent)
        batch = pd.concat(list(rows)).sort_values(["ts_ns", "seq"], kind="stable")
        times, values = batch["ts_ns"].astype("int64").tolist(), batch[self.value].tolist()
        for i, trigger in enumerate(self.triggers):
            if trigger.applies_to(key[self.sensor_at]):
                at, preds, residuals, reasons, forecasts[i], last_sent[i] = replay(
                    trigger, times, values, forecasts[i], last_sent[i]
                )
                yield batch[self.carried].take(at).assign(setting=i, pred=preds, res=residuals, reason=reasons)
        self.state.update((forecasts, last_sent))

    def close(self):
        pass


def stream_send_on_delta(
    samples: DataFrame, triggers: Sequence[Trigger], keys: Sequence[str] = STREAM, value: str = "x", valid: str | None = None
) -> DataFrame:
    """Streaming form of ``send_on_delta``: readings of a stream must arrive in time order across batches."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys, triggers = list(keys), list(triggers)
    rows = samples.where(usable(F.col(value), None if valid is None else F.col(valid)))
    rows = rows.drop("policy", "pred", "res", "tau", "kbits", "val", "reason", "setting")
    out = T.StructType([
        *rows.schema,
        T.StructField("setting", T.IntegerType()),
        T.StructField("pred", T.DoubleType()),
        T.StructField("res", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ])
    sent = rows.groupBy(*keys).transformWithStateInPandas(
        _Sender(triggers, value, rows.columns, keys.index("sensor")), out, outputMode="Append", timeMode="None"
    )
    return with_setting(sent, value, triggers)
