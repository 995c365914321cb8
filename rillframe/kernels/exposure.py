"""A controller that keeps pictures evenly bright: which exposure and gain follow a metered level."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Metering:
    """Parameters; exposures in milliseconds. ``flicker_hz`` is the mains', 0 where lamps don't flicker."""

    target: float = 0.35
    deadband: float = 0.08
    damping: float = 0.25
    most: float = 0.5
    gains: tuple[float, float] = (1.0, 16.0)
    exposures: tuple[float, float] = (5.0, 17.0)
    flicker_hz: float = 60.0
    headroom: float = 0.1
    darkest: float = 1e-4

    @cached_property
    def allowed(self) -> tuple[float, ...]:
        """Exposures that take in whole flickers of a lamp, which is as bright in both halves of a period; else the shortest."""
        low, high = self.exposures
        flicker = 500.0 / self.flicker_hz if self.flicker_hz > 0 else math.inf
        found = tuple(round(k * flicker, 4) for k in range(1, int(high / flicker + 1e-6) + 1) if k * flicker >= low - 1e-6 * flicker)
        return found or (low,)

    @property
    def first(self) -> tuple[float, float]:
        """The setting to begin with."""
        return self.allowed[0], self.gains[0]

    def follow(self, level: float | None, exposure: float, gain: float) -> tuple[float, float]:
        """The setting after a metered level; the same if it is null, NaN or near enough in logarithms.

        Light moves by a damped part of the error, at most by the factor 1 + ``most``. Gain takes it at the shortest
        exposure with which it can; a longer exposure is left only for one that has ``headroom`` of gain to spare.
        """
        if level is None or math.isnan(level):
            return exposure, gain
        error = math.log(self.target / max(level, self.darkest))
        if abs(error) <= self.deadband:
            return exposure, gain
        limit = math.log1p(self.most)
        light = exposure * gain * math.exp(min(limit, max(-limit, self.damping * error)))
        reach = self.gains[1]
        shortest = next((e for e in self.allowed if light <= e * reach), self.allowed[-1])
        here = min(self.allowed, key=lambda e: abs(e - exposure))
        tight = shortest < here and light > shortest * reach * (1.0 - self.headroom)
        chosen = here if tight and abs(here - exposure) <= 0.05 else shortest
        return chosen, min(reach, max(self.gains[0], light / chosen))
