"""Sending settings and the per-stream step that decides which readings are sent.

The step is the only sequential part of the trigger; batch and streaming queries share it.
"""

from __future__ import annotations

from dataclasses import dataclass

NS_PER_S = 1e9
NS_PER_MS = 1e6
RESIDUAL, BOOTSTRAP, HEARTBEAT, PERIODIC = "residual", "bootstrap", "heartbeat", "periodic"


@dataclass(frozen=True)
class Trigger:
    """When to send: residual above ``tau``, first reading, or silence for ``heartbeat_s``.

    ``sensor`` limits the setting to one sensor. Policy ``periodic`` sends every valid reading.
    """

    alpha: float
    tau: float
    kbits: int
    heartbeat_s: float | None = 10.0
    min_emit_interval_ms: float = 0
    bootstrap: bool = True
    policy: str = "fixed_tau"
    sensor: str | None = None
    name: str = ""
    vmin: float | None = None
    vmax: float | None = None

    def __post_init__(self):
        if not 0.0 < self.alpha <= 1.0:
            raise ValueError("alpha must be above 0 and at most 1")
        if self.tau < 0:
            raise ValueError("tau must not be negative")
        if self.min_emit_interval_ms < 0:
            raise ValueError("min_emit_interval_ms must not be negative")
        if not 1 <= self.kbits <= 16:
            raise ValueError("kbits must be 1 to 16")

    @property
    def heartbeat_ns(self) -> int | None:
        return int(self.heartbeat_s * NS_PER_S) if self.heartbeat_s and self.heartbeat_s > 0 else None

    @property
    def guard_ns(self) -> int:
        return int(self.min_emit_interval_ms * NS_PER_MS)

    def applies_to(self, sensor: str) -> bool:
        return self.sensor is None or self.sensor == sensor


def replay(trigger: Trigger, times: list, values: list, forecast: float | None, last_sent: int | None):
    """Run valid readings of one stream in time order through the trigger.

    Returns the positions sent, with forecast, residual and reason of each, and the new state.
    """
    alpha, keep, tau = trigger.alpha, 1.0 - trigger.alpha, trigger.tau
    silence, guard, every = trigger.heartbeat_ns, trigger.guard_ns, trigger.policy == PERIODIC
    positions, forecasts, residuals, reasons = [], [], [], []
    for i, x in enumerate(values):
        expected = x if forecast is None else forecast
        residual = abs(x - expected)
        reason = None
        if every:
            reason = PERIODIC
        elif residual > tau:
            reason = RESIDUAL
        elif forecast is None and trigger.bootstrap:
            reason = BOOTSTRAP
        elif silence is not None and (last_sent is None or times[i] - last_sent >= silence):
            reason = HEARTBEAT
        if reason and not every and guard and last_sent is not None and times[i] - last_sent < guard:
            reason = None
        if reason:
            last_sent = times[i]
            positions.append(i)
            forecasts.append(expected)
            residuals.append(residual)
            reasons.append(reason)
        forecast = x if forecast is None else alpha * x + keep * forecast
    return positions, forecasts, residuals, reasons, forecast, last_sent
