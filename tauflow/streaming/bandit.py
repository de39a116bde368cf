"""The bandit policy over a stream of states and outcomes, one set of arm models per stream.

Streams share states by a hash of their keys (``buckets``); a task holds one bucket's rows of a micro-batch and its models.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tauflow.operators.bandit import REPLAY_COLUMNS, ArmModels, PolicyConfig, replay_rows, with_context_and_reward
from tauflow.schemas import STREAM
from tauflow.session import STATE_STORE
from tauflow.streaming.buckets import BUCKET, bucket_of, streams_of

# Streams of the bucket, pickled: matrices, vectors and counts of their arms, and the decision that waits for its outcome.
_STATE = T.StructType([T.StructField("streams", T.BinaryType())])


class _Policy(StatefulProcessor):
    def __init__(self, configs: dict[str, PolicyConfig], names: list[str], keys: list[str]):
        self.configs, self.names, self.keys = configs, names, keys

    def init(self, handle):
        self.state = handle.getValueState("models", _STATE)

    def _models(self, stream: tuple, known: tuple | None) -> ArmModels:
        models = ArmModels(self.configs[stream[self.keys.index("sensor")]])
        if known is not None:
            models.a, models.b, models.counts, models.waiting = known
        return models

    def handleInputRows(self, key, rows, timer_values):
        streams = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        batch, runs = streams_of(pd.concat(list(rows), ignore_index=True), self.keys, ["ts_ns", "seq"])
        decided = []
        for stream, a, b in runs:
            models = self._models(stream, streams.get(stream))
            decided += replay_rows(models, batch.iloc[a:b])
            streams[stream] = models.a, models.b, models.counts, models.waiting
        self.state.update((pickle.dumps(streams),))
        columns = pd.DataFrame(decided, columns=[c.name for c in REPLAY_COLUMNS], index=batch.index)
        yield pd.concat([batch[self.names], columns], axis=1)

    def close(self):
        pass


def stream_bandit(log: DataFrame, configs: dict[str, PolicyConfig], keys: Sequence[str] = STREAM) -> DataFrame:
    """Streaming form of ``bandit_replay``."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys = list(keys)
    ready = with_context_and_reward(log.where(F.col("sensor").isin(*configs)), configs)
    carried = [f for f in log.schema if f.name not in {c.name for c in REPLAY_COLUMNS}]
    return ready.withColumn(BUCKET, bucket_of(keys)).groupBy(BUCKET).transformWithStateInPandas(
        _Policy(configs, [f.name for f in carried], keys),
        T.StructType([*carried, *REPLAY_COLUMNS]),
        outputMode="Append",
        timeMode="None",
    )
