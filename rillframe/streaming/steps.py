"""Steps of the stateful stream operators: ``step(state, row) -> (state, rows out)``.

States are plain lists and numbers, so that they can be kept as JSON; rows are dicts. The same steps
run in a stream and in an ordered fold over a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from rillframe.kernels.exposure import Metering

Step = Callable[[Any, dict], tuple[Any, Iterable[tuple]]]


def pair_heads(window: int) -> Step:
    """Rows with ``side`` 0 or 1 and ``t``: heads within the window pair up, otherwise the older one falls. Out: left, right.

    Sides come in order of time, so what is more than the window older than a row of either side meets nothing any
    more and falls: a side that is silent doesn't make the other's queue grow.
    """

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        queues = state or [[], []]
        queues[row["side"]].append(row["t"])
        queues = [[t for t in q if t >= row["t"] - window] for q in queues]
        out = []
        while queues[0] and queues[1]:
            a, b = queues[0][0], queues[1][0]
            if abs(a - b) <= window:
                out.append((a, b))
                queues[0].pop(0)
                queues[1].pop(0)
            else:
                queues[a > b].pop(0)
        return queues, out

    return step


def nearest_in_ring(depth: int) -> Step:
    """Rows of side 1 fill a ring of ``depth`` times; each of side 0 takes the nearest, the oldest of equal ones. Out: left, right."""

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        ring = state or []
        if row["side"] == 1:
            return [*ring, row["t"]][-depth:], []
        return ring, [(row["t"], min(ring, key=lambda u: abs(u - row["t"])))] if ring else []

    return step


def bounded_queue(depth: int, drop: str) -> Step:
    """``op`` 'put' or 'take' on a queue of ``depth``; when full, 'newest' or 'oldest' falls. Out: t, dropped so far, at each take."""

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        held, dropped = state or [[], 0]
        if row["op"] == "take":
            return ([held[1:], dropped], [(held[0], dropped)]) if held else ([held, dropped], [])
        if len(held) < depth:
            return [[*held, row["t"]], dropped], []
        return [held if drop == "newest" else [*held[1:], row["t"]], dropped + 1], []

    return step


def mailbox(period: int) -> Step:
    """The latest value at a fixed rate, from the first row on. Out: tick, value, how often it was sent before.

    A tick without a new value repeats the last one; of several values between two ticks the last is sent. A gap
    may be of any number of ticks: they come out one by one.
    """

    def step(state: list | None, row: dict) -> tuple[list, Iterable[tuple]]:
        t, value = row["t"], row["v"]
        if state is None:
            return [t, value, 0], []
        tick, latest, sent = state
        due = max(0, (t - tick) // period)
        return [tick + due * period, value, 0], ((tick + k * period, latest, sent + k - 1) for k in range(1, due + 1))

    return step


def sequence() -> Step:
    """Numbers rows from 0. Out: number, t."""

    def step(state: int | None, row: dict) -> tuple[int, list[tuple]]:
        n = state or 0
        return n + 1, [(n, row["t"])]

    return step


def drift_warning(limit: float, every: int) -> Step:
    """Out: t and drift where it exceeds the limit, at most once in ``every``."""

    def step(state: int | None, row: dict) -> tuple[int | None, list[tuple]]:
        if abs(row["v"]) > limit and (state is None or row["t"] - state >= every):
            return row["t"], [(row["t"], row["v"])]
        return state, []

    return step


def exposure(metering: Metering | None = None) -> Step:
    """The controller of ``kernels.exposure``. Out: t, exposure, gain."""
    m = metering or Metering()

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        now = m.follow(row["v"], *(state or m.first))
        return [*now], [(row["t"], *now)]

    return step


def deferred_write(hold: int = 2) -> Step:
    """Settings asked for in ``exposure`` and ``gain``, written so that no picture is too bright.

    A single change is written at once. Where both change, what gives less light is written at once and the other
    ``hold`` rows later; until then nothing new is taken. Out: t, and the exposure and gain in effect.
    """

    def step(state: list | None, row: dict) -> tuple[list, list[tuple]]:
        wanted = [row["exposure"], row["gain"]]
        now, waiting = (wanted, None) if state is None else ([*state[0]], state[1])
        if waiting is not None:
            which, value, left = waiting
            waiting = [which, value, left - 1] if left > 1 else None
            if waiting is None:
                now[which] = value
        elif abs(wanted[0] - now[0]) > 1e-4 and abs(wanted[1] - now[1]) > 1e-3:
            later = 1 if wanted[0] < now[0] else 0
            now[1 - later] = wanted[1 - later]
            waiting = [later, wanted[later], hold]
        else:
            now = wanted
        return [now, waiting], [(row["t"], *now)]

    return step
