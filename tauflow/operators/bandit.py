"""LinUCB policy: context, reward, per-arm model, scoring and replay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.schemas import SCENARIO, STREAM


@dataclass(frozen=True)
class Arm:
    tau: float
    kbits: int


# Recommended arms, tau by bit depth, per sensor and for any other sensor.
ARM_GRIDS = {
    "mic_rms": ((1.5, 2.5, 3.5, 4.5), (4, 6, 8)),
    "temp": ((0.05, 0.1, 0.2, 0.3), (6, 8, 10)),
}
OTHER_GRID = ((0.5, 1.0, 2.0), (6, 8))
# Context length, smallest scale, queue length that counts as 1.
DIMENSION = 6
MIN_SCALE = 1e-9
QUEUE_SCALE = 50.0


def default_arms(sensor: str) -> list[Arm]:
    taus, depths = ARM_GRIDS.get(sensor, OTHER_GRID)
    return [Arm(t, k) for t in taus for k in depths]


@dataclass(frozen=True)
class PolicyConfig:
    # The defaults of the policy.
    arms: tuple[Arm, ...]
    alpha: float = 0.75
    ridge: float = 1.0
    w_aoi: float = 1.0
    w_mae: float = 1.0
    w_rate: float = 1.0
    aoi_scale_ms: float = 1000.0
    mae_scale: float = 1.0
    rate_scale_bps: float = 1024.0
    res_scale: float = 1.0
    resvar_scale: float = 1.0
    aoi_max_ms: float = 5000.0
    mae_max: float = 2.0
    warmup_per_arm: int = 1
    safe_arm: Arm | None = None
    safe_index: int = field(init=False)

    def __post_init__(self):
        if not self.arms:
            raise ValueError("at least one arm is needed")
        object.__setattr__(self, "safe_index", self._find_safe())

    def _find_safe(self) -> int:
        """The named arm, or the one with the lowest tau and among those the most bits."""
        if self.safe_arm is None:
            return min(range(len(self.arms)), key=lambda i: (self.arms[i].tau, -self.arms[i].kbits))
        for i, arm in enumerate(self.arms):
            if abs(arm.tau - self.safe_arm.tau) < 1e-9 and arm.kbits == self.safe_arm.kbits:
                return i
        raise ValueError("safe_arm is not one of the arms")


def bandit_context(cfg: PolicyConfig, aoi: Column, res: Column, var: Column, loss: Column, queue: Column) -> Column:
    """Context vector: bias, age, residual, residual variance, loss, queue length, each scaled to about 1."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def scaled(x: Column, scale: float) -> Column:
        return x / F.lit(max(MIN_SCALE, scale))

    return F.array(
        one,
        scaled(aoi, cfg.aoi_scale_ms),
        scaled(F.abs(res), cfg.res_scale),
        scaled(F.greatest(var, zero), cfg.resvar_scale),
        F.least(F.greatest(loss, zero), one),
        F.greatest(queue, F.lit(0)) / F.lit(QUEUE_SCALE),
    )


def bandit_reward(cfg: PolicyConfig, aoi_ms: Column, mae: Column, rate_bps: Column) -> Column:
    """Negative weighted cost of an outcome."""
    cost = F.lit(0.0)
    for x, weight, scale in (
        (aoi_ms, cfg.w_aoi, cfg.aoi_scale_ms),
        (mae, cfg.w_mae, cfg.mae_scale),
        (rate_bps, cfg.w_rate, cfg.rate_scale_bps),
    ):
        cost = cost + F.lit(weight) * (x / F.lit(max(MIN_SCALE, scale)))
    return -cost


def bandit_fit(
    outcomes: DataFrame, keys: Sequence[str], ridge: float = 1.0, context: str = "context", reward: str = "reward"
) -> DataFrame:
    """Per arm: A = ridge * I + sum(x x'), b = sum(r x) and the number of tries.

    The 21 products of the upper triangle and the 6 reward products are plain sums, so each task
    adds up its rows first and the shuffle carries one row per arm and task.
    """
    x = [F.get(F.col(context), F.lit(i)) for i in range(DIMENSION)]
    upper = {(i, j): f"_a{i}{j}" for i in range(DIMENSION) for j in range(i, DIMENSION)}
    sums = [F.sum(x[i] * x[j]).alias(name) for (i, j), name in upper.items()]
    sums += [F.sum(F.col(reward) * x[i]).alias(f"_b{i}") for i in range(DIMENSION)]
    fitted = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("tries"), *sums)
    a = [
        F.col(upper[min(i, j), max(i, j)]) + (float(ridge) if i == j else 0.0)
        for i in range(DIMENSION)
        for j in range(DIMENSION)
    ]
    return fitted.select(
        *keys, "tries", F.array(*a).alias("a"), F.array(*[F.col(f"_b{i}") for i in range(DIMENSION)]).alias("b")
    )


def _solve(a: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, rhs)
    except np.linalg.LinAlgError:
        return np.zeros_like(rhs)


def bandit_theta(model: DataFrame) -> DataFrame:
    """Add ``theta`` = A^-1 b, ``a_inverse`` and ``a_diag``; zeros where A is singular. One small row per arm."""
    doubles = T.ArrayType(T.DoubleType())
    out = T.StructType([*model.schema, *[T.StructField(n, doubles) for n in ("theta", "a_inverse", "a_diag")]])

    def solve(batches):
        for batch in batches:
            thetas, inverses, diagonals = [], [], []
            for a, b in zip(batch["a"], batch["b"]):
                a, b = np.asarray(a, float).reshape(DIMENSION, DIMENSION), np.asarray(b, float)
                thetas.append(_solve(a, b))
                inverses.append(_solve(a, np.eye(DIMENSION)).ravel())
                diagonals.append(np.diag(a).copy())
            yield batch.assign(theta=thetas, a_inverse=inverses, a_diag=diagonals)

    return model.mapInPandas(solve, out)


def bandit_score(
    states: DataFrame, solved: DataFrame, keys: Sequence[str] = ("sensor",), alpha: float = 0.75, context: str = "context"
) -> DataFrame:
    """Add ``scores``: per arm theta'x + alpha * sqrt(x' A^-1 x), as structs (arm, score) in order of arm.

    All arms of a key travel as one array to the states, so no state row is multiplied. Models per sensor,
    profile or policy are a few rows by definition and are broadcast; models per device are joined by
    shuffle, as their number grows with the data. ``solved`` needs the column ``arm``.
    """
    keys = list(keys)
    theta = [F.get("theta", F.lit(i)) for i in range(DIMENSION)]
    inverse = [F.get("a_inverse", F.lit(k)) for k in range(DIMENSION * DIMENSION)]
    # x' A^-1 x as 21 products: the two halves of the matrix are added up beforehand.
    pairs = [(i, j) for i in range(DIMENSION) for j in range(i, DIMENSION)]
    weights = [
        inverse[DIMENSION * i + j] + (inverse[DIMENSION * j + i] if i != j else F.lit(0.0)) for i, j in pairs
    ]
    arm = F.struct("arm", F.struct(*[w.alias(f"t{i}") for i, w in enumerate(theta)],
                                   *[w.alias(f"q{i}{j}") for w, (i, j) in zip(weights, pairs)]).alias("w"))
    arms = solved.groupBy(*keys).agg(F.sort_array(F.collect_list(arm)).alias("_model"))
    if set(keys) <= set(SCENARIO):
        arms = F.broadcast(arms)
    x = [F.get(context, F.lit(i)) for i in range(DIMENSION)]
    features = {f"_x{i}": c for i, c in enumerate(x)}
    features |= {f"_x{i}{j}": x[i] * x[j] for i, j in pairs}

    def score(arm: Column) -> Column:
        w = arm.getField("w")
        mean = sum((w.getField(f"t{i}") * F.col(f"_x{i}") for i in range(1, DIMENSION)), w.getField("t0") * F.col("_x0"))
        square = sum((w.getField(f"q{i}{j}") * F.col(f"_x{i}{j}") for i, j in pairs[1:]), w.getField("q00") * F.col("_x00"))
        width = F.sqrt(F.greatest(square, F.lit(0.0)))
        return F.struct(arm.getField("arm").alias("arm"), (mean + alpha * width).alias("score"))

    # Generated columns are kept apart from the scoring, so each product is formed once per row, not per arm.
    prepared = states.select("*", *[c.alias(n) for n, c in features.items()]).join(arms, keys)
    return prepared.withColumn("scores", F.transform("_model", score)).drop("_model", *features)


def bandit_choose(scored: DataFrame) -> DataFrame:
    """Add the arm with the highest score; the lowest arm number wins ties."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s.getField("score"), (-s.getField("arm")).alias("arm"))))
    return scored.withColumn("_best", best).select(
        *scored.columns, (-F.col("_best.arm")).alias("chosen_arm"), F.col("_best.score").alias("best_score")
    ).drop("scores")


class ArmModels:
    """Running A and b of all arms of one stream; one decision may be waiting for its outcome."""

    def __init__(self, cfg: PolicyConfig):
        n = len(cfg.arms)
        self.cfg = cfg
        self.a = np.tile(np.eye(DIMENSION) * cfg.ridge, (n, 1, 1))
        self.b = np.zeros((n, DIMENSION))
        self.counts = np.zeros(n, dtype=np.int64)
        self.waiting = None

    def decide(self, aoi_ms: float, res: float, x: np.ndarray) -> tuple[int, str]:
        cold = np.flatnonzero(self.counts < self.cfg.warmup_per_arm)
        if aoi_ms >= self.cfg.aoi_max_ms or abs(res) >= self.cfg.mae_max:
            arm, why = self.cfg.safe_index, "guard"
        elif len(cold):
            arm, why = int(cold[0]), "warmup"
        else:
            arm, why = self._best(x), "score"
        self.counts[arm] += 1
        self.waiting = (arm, x)
        return arm, why

    def _best(self, x: np.ndarray) -> int:
        # One batched solve gives both A^-1 b and A^-1 x of every arm.
        sides = np.stack([self.b, np.broadcast_to(x, self.b.shape)], axis=2)
        try:
            solved = np.linalg.solve(self.a, sides)
        except np.linalg.LinAlgError:
            solved = np.stack([_solve(a, s) for a, s in zip(self.a, sides)])
        terms = x @ solved
        return int(np.argmax(terms[:, 0] + self.cfg.alpha * np.sqrt(np.maximum(terms[:, 1], 0.0))))

    def learn(self, reward: float) -> float:
        if self.waiting is None:
            return 0.0
        arm, x = self.waiting
        self.a[arm] += np.outer(x, x)
        self.b[arm] += reward * x
        self.waiting = None
        return reward


# No leading underscore: such names do not reach a stateful Python step.
CONTEXT, OUTCOME = "policy_context", "outcome_reward"
REPLAY_COLUMNS = [
    T.StructField("arm", T.IntegerType()),
    T.StructField("tau", T.DoubleType()),
    T.StructField("kbits", T.IntegerType()),
    T.StructField("rule", T.StringType()),
    T.StructField("reward", T.DoubleType()),
]


def replay_rows(models: ArmModels, rows: pd.DataFrame) -> list[tuple]:
    """Decide and learn row by row; a row without an outcome (null reward) leaves its decision waiting."""
    out = []
    for aoi, res, x, reward in zip(rows["state_aoi"], rows["state_res"], rows[CONTEXT], rows[OUTCOME]):
        arm, why = models.decide(aoi, res, np.asarray(x, float))
        learned = 0.0 if pd.isna(reward) else models.learn(float(reward))
        out.append((arm, models.cfg.arms[arm].tau, models.cfg.arms[arm].kbits, why, learned))
    return out


def with_context_and_reward(log: DataFrame, configs: dict[str, PolicyConfig], x: str = CONTEXT, r: str = OUTCOME) -> DataFrame:
    """Context and reward of each row of a state and outcome log, by the settings of its sensor."""
    context = reward = F.lit(None)
    for sensor, cfg in configs.items():
        mine = F.col("sensor") == sensor
        context = F.when(mine, bandit_context(cfg, *map(F.col, (
            "state_aoi", "state_res", "state_res_var", "state_loss", "state_q_len")))).otherwise(context)
        reward = F.when(mine, bandit_reward(cfg, *map(F.col, ("out_aoi_ms", "out_mae", "out_rate_bps")))).otherwise(reward)
    return log.withColumn(x, context).withColumn(r, reward)


def bandit_replay(log: DataFrame, configs: dict[str, PolicyConfig], keys: Sequence[str] = STREAM) -> DataFrame:
    """Run each stream's states and outcomes through its own policy, in time order.

    Every decision depends on all outcomes before it, so one stream is one sequence by nature. A task
    holds one Arrow batch and the arm models, not the stream; streams run in parallel.
    """
    keys = list(keys)
    ready = with_context_and_reward(log.where(F.col("sensor").isin(*configs)), configs)
    carried = [f for f in log.schema if f.name not in {c.name for c in REPLAY_COLUMNS}]
    names, sensor_at = [f.name for f in carried], keys.index("sensor")

    def run(batches):
        current, models = None, None
        for batch in batches:
            if batch.empty:
                continue
            changed = np.zeros(len(batch), bool)
            for k in keys:
                changed |= (batch[k] != batch[k].shift()).to_numpy()
            starts = np.flatnonzero(changed).tolist()
            decided = []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                key = tuple(batch[k].iloc[a] for k in keys)
                if key != current:
                    current, models = key, ArmModels(configs[key[sensor_at]])
                decided += replay_rows(models, batch.iloc[a:b])
            columns = pd.DataFrame(decided, columns=[c.name for c in REPLAY_COLUMNS], index=batch.index)
            yield pd.concat([batch[names], columns], axis=1)

    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, "ts_ns", "seq")
    return ordered.mapInPandas(run, T.StructType([*carried, *REPLAY_COLUMNS]))
