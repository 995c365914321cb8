"""Implausible readings: a hidden Markov model per source.

Each reading of a source is in one of four states: normal, spike, stuck or out of range. What is
observed of a reading is (a) how far it lies beyond both its neighbourhoods, in units of its source's
scatter, (b) whether it equals the reading before, and (c) whether it breaks a hard bound. The
forward-backward probabilities of the states, with the hard bounds, assign the flags; a last check
holds a spike to its longest length and a stuck run to its shortest.

A source may hold a large part of all rows, so no task takes a whole one. Readings are numbered per source
and field, and handled in blocks of consecutive numbers with a halo of readings on either side that is wider
than anything the model looks at; blocks and the pieces of the model begin at the same places whatever the
size of a block. What is a source's own, its scatter, its rate of equal readings and its period, comes from
a histogram added up per source. So where blocks are cut changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMAL, SPIKE, STUCK, RANGE = 0, 1, 2, 3
BINS_PER_E = 50
SIDE = 5
#: Steps on either side by which a clock's period is found.
STEPS = 15
#: Readings that the model is run over in one piece.
PIECE = 64
#: Sequence numbers within which readings are numbered in one task.
STRETCH = 1 << 16
EQUAL, NONE = -20_000, -10_000


@dataclass(frozen=True)
class SpikeModel:
    """Parameters; ``threshold`` is the deviation at which spike and normal are equally likely.

    ``clock``: values are times that advance by one period per sequence number, which may change in the course
    of a source; deviations are then counted in the periods found around, and a repeated time is a stuck one.
    ``block`` and ``halo`` are multiples of PIECE readings.
    """

    threshold: float = 10.0
    longest_spike: int | None = 2
    shortest_run: int = 10
    clock: bool = False
    enter_spike: float = 1e-3
    stay_spike: float = 0.38
    enter_stuck: float = 1e-4
    stay_stuck: float = 0.94
    block: int = 8192
    halo: int = PIECE


def sides(x: np.ndarray, width: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to ``width`` readings before and after each one; NaN where there are none."""
    n = len(x)
    before = np.full(n, np.nan)
    after = np.full(n, np.nan)
    if n > width:
        full = np.median(np.lib.stride_tricks.sliding_window_view(x, width), axis=1)
        before[width:] = full[:-1]
        after[: n - width] = full[1:]
    for i in range(1, min(width, n)):
        before[i] = np.median(x[:i])
    for i in range(max(0, n - width), n - 1):
        after[i] = np.median(x[i + 1 :])
    return before, after


def beyond_sides(x: np.ndarray, before: np.ndarray, after: np.ndarray, same_sign: bool = True) -> np.ndarray:
    """How far a reading lies beyond both neighbourhoods; 0 where it lies between them."""
    a, b = x - before, x - after
    a = np.where(np.isnan(a), b, a)
    b = np.where(np.isnan(b), a, b)
    out = np.minimum(np.abs(a), np.abs(b))
    if same_sign:
        out = np.where(np.sign(a) == np.sign(b), out, 0.0)
    return np.nan_to_num(out, nan=0.0)


def posteriors(z: np.ndarray, equal: np.ndarray, broken: np.ndarray, p_equal: float, m: SpikeModel, chunk: int = PIECE, lead: int = 16) -> np.ndarray:
    """State probabilities (n, 4) of one sequence by forward-backward.

    The sequence is cut into overlapping pieces which are run side by side; what a piece's ends don't
    know has faded after ``lead`` steps.
    """
    n = len(z)
    stay_n = 1 - 2 * m.enter_spike - m.enter_stuck
    trans = np.array([
        [stay_n, m.enter_spike, m.enter_stuck, m.enter_spike],
        [0.99 - m.stay_spike - 0.01, m.stay_spike, 0.01, 0.01],
        [0.99 - m.stay_stuck, 0.005, m.stay_stuck, 0.005],
        [0.58, 0.2, 0.01, 0.21],
    ])
    trans /= trans.sum(axis=1, keepdims=True)
    # The normal tail meets the flat spike density, with the cost of entering and leaving, at the threshold.
    flat = -np.log(200.0)
    cost = -(flat + np.log(trans[0, 1] / stay_n) + np.log(trans[1, 0]))
    tail = -cost * (np.minimum(z, 1e3 * m.threshold) / m.threshold) ** 2
    same, other = np.log(p_equal), np.log1p(-p_equal)
    eq_n = np.where(equal, same, other)
    # Within a stuck run a reading lies amid its like: the stuck state must not take in what is far off.
    logs = np.stack([tail + eq_n, flat + eq_n, tail + np.where(equal, np.log(0.999), np.log(0.001)), np.zeros(n)], axis=1)
    logs[:, RANGE] = np.where(broken, 0.0, -60.0)
    logs[broken, :RANGE] -= 60.0
    logs -= logs.max(axis=1, keepdims=True)
    emit = np.exp(np.maximum(logs, -300.0))

    pieces = -(-n // chunk)
    at = np.arange(pieces)[:, None] * chunk - lead + np.arange(chunk + 2 * lead)[None, :]
    inside = (at >= 0) & (at < n)
    e = np.where(inside[:, :, None], emit[np.clip(at, 0, n - 1)], 1.0)
    length = e.shape[1]
    start = np.array([0.99, 0.004, 0.002, 0.004])
    fwd = np.empty_like(e)
    cur = np.broadcast_to(start, (pieces, 4)) * e[:, 0]
    for k in range(length):
        if k:
            cur = (cur @ trans) * e[:, k]
        cur = cur / np.maximum(cur.sum(axis=1, keepdims=True), 1e-300)
        fwd[:, k] = cur
    bwd = np.ones((pieces, 4))
    post = np.empty((pieces, chunk, 4))
    for k in range(length - 1, -1, -1):
        if lead <= k < lead + chunk:
            p = fwd[:, k] * bwd
            post[:, k - lead] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        bwd = (bwd * e[:, k]) @ trans.T
        bwd = bwd / np.maximum(bwd.sum(axis=1, keepdims=True), 1e-300)
    return post.reshape(-1, 4)[:n]


def run_lengths(flag: np.ndarray) -> np.ndarray:
    """For each set flag the length of its run of set flags; 0 elsewhere."""
    out = np.zeros(len(flag), dtype=np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a
    return out


def off_clock(q: np.ndarray, x: np.ndarray, period: float, begins: bool) -> np.ndarray:
    """By how many periods times fit neither those before nor those after; ``period`` stands in where steps tell none.

    ``begins``: the first time is its source's first. With nothing before it, that is wrong only if the clock
    runs back after it.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n)
    steps = np.diff(x) / np.diff(q)
    steps = np.where(steps > 0, steps, period)
    around = np.concatenate([np.full(STEPS, period), steps, np.full(STEPS, period)])
    usual = np.median(np.lib.stride_tricks.sliding_window_view(around, STEPS), axis=1)
    # Steps up to the reading before, and from the reading after: a wrong time spoils none of them.
    before, after = usual[np.maximum(np.arange(n) - 1, 0)], usual[np.minimum(np.arange(n) + 1 + STEPS, len(usual) - 1)]
    out = np.full(n, np.inf)
    first_late = False
    for side, rate in ((-1, before), (1, after)):
        off = np.full((SIDE, n), np.nan)
        for k in range(1, min(SIDE, n - 1) + 1):
            here, there = (slice(k, n), slice(0, n - k)) if side < 0 else (slice(0, n - k), slice(k, n))
            off[k - 1, here] = x[here] - x[there] - rate[here] * (q[here] - q[there])
        full = ~np.isnan(off[-1])
        middle = np.full(n, np.nan)
        middle[full] = np.median(off[:, full], axis=0)
        some = ~full & ~np.isnan(off[0])
        middle[some] = np.nanmedian(off[:, some], axis=0)
        if side > 0:
            first_late = middle[0] > 0
        out = np.fmin(out, np.abs(middle) / rate)
    if begins and not first_late:
        out[0] = 0.0
    return np.where(np.isfinite(out), out, 0.0)


def flag_sequence(q: np.ndarray, x: np.ndarray, scale: float, p_equal: float, bound: float, m: SpikeModel, begins: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Flag codes (0 none, else a state) and the probability of not being normal, for sorted, distinct readings.

    ``scale`` is the source's scatter, or its period if its values are a clock's.
    """
    n = len(x)
    broken = np.abs(x) > bound
    x = np.clip(x, -1e15, 1e15)
    equal = np.zeros(n, dtype=bool)
    equal[1:] = x[1:] == x[:-1]
    if m.clock:
        z = off_clock(q, x, scale, begins) * (m.threshold / 2.0)
    else:
        z = beyond_sides(x, *sides(x)) / scale
    post = posteriors(z, equal, broken, p_equal, m)
    flag = np.zeros(n, dtype=np.int8)
    spike = (post[:, SPIKE] > 0.5) & ~broken
    if m.longest_spike is not None:
        spike &= run_lengths(spike) <= m.longest_spike
    stuck = equal & (post[:, STUCK] > 0.5)
    stuck &= run_lengths(equal) >= m.shortest_run - 1
    flag[spike] = SPIKE
    flag[stuck] = STUCK
    flag[broken] = RANGE
    return flag, 1.0 - post[:, NORMAL]


def _numbered(rows: DataFrame) -> DataFrame:
    """Distinct readings of each source and field with their number from 0, in order, and the reading before.

    Numbers are counted within stretches of sequence numbers; one row per stretch carries the count on.
    """
    keys = ["__src", "__f"]
    rows = rows.withColumn("__s", F.floor(F.col("__q") / F.lit(STRETCH))).repartition(*keys, "__s")
    rows = rows.groupBy(*keys, "__s", "__q").agg(F.min("__x").alias("__x"))
    order = Window.partitionBy(*keys, "__s").orderBy("__q")
    rows = rows.withColumns({"__n": F.row_number().over(order), "__px": F.lag("__x").over(order), "__pq": F.lag("__q").over(order)})
    counts = rows.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__count"))
    upto = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__s", F.coalesce(F.sum("__count").over(upto), F.lit(0)).alias("__before"))
    return rows.join(counts, [*keys, "__s"]).withColumn("__n", F.col("__n") + F.col("__before") - 1).drop("__s", "__before")


def _blocks(rows: DataFrame, m: SpikeModel) -> DataFrame:
    """Each reading once in its own block and, near a border, once in the neighbour's halo."""
    low, own, high = (F.floor((F.col("__n") + d) / F.lit(m.block)) for d in (-m.halo, 0, m.halo))
    near = F.filter(F.array_distinct(F.array(low, own, high)), lambda b: b >= 0)
    return rows.select("__src", "__f", "__n", "__q", "__x", F.explode(near).alias("__block"))


def _median(bins: DataFrame, per_e: float) -> DataFrame:
    """Per source and field the median of what was counted in logarithmic bins ``__b``, in ``__middle``."""
    w = Window.partitionBy("__src", "__f")
    bins = bins.withColumn("__cum", F.sum("__k").over(w.orderBy("__b"))).withColumn("__all", F.sum("__k").over(w))
    return bins.where(F.col("__cum") * 2 >= F.col("__all")).groupBy("__src", "__f").agg(F.exp(F.min("__b") / F.lit(per_e)).alias("__middle"))


def flag_implausible(df: DataFrame, *, source: str, seq: str, bounds: Mapping[str, float], model: SpikeModel | None = None, values: Mapping[str, Column] | None = None) -> DataFrame:
    """Flagged readings: ``source``, ``seq``, ``field``, ``flag`` ('spike', 'stuck', 'range'), ``probability``.

    ``bounds`` names the value columns and the hard bound of each one's magnitude.

    * Null and NaN values aren't readings and are skipped: the readings around them follow each other.
      Infinite values break every bound.
    * Rows with a null source or sequence number are left out; repeated rows of a sequence number count
      once (of differing values the smallest).
    * A source with too few readings to have a scatter has only stuck and out-of-range flags.
    * Empty tables give no rows; further columns are ignored.
    """
    m = model or SpikeModel()
    if m.halo < max(m.shortest_run, SIDE + STEPS + 2, 17) or m.block < m.halo or m.halo % PIECE or m.block % PIECE:
        raise ValueError(f"block and halo must be multiples of {PIECE}, and the halo wider than what the model looks at")
    fields = list(bounds)
    each = F.array(*(F.struct(F.lit(i).alias("__f"), (values[f] if values and f in values else F.col(f)).cast("double").alias("__x")) for i, f in enumerate(fields)))
    rows = df.select(F.col(source).cast("string").alias("__src"), F.col(seq).cast("long").alias("__q"), F.inline(each))
    rows = _numbered(rows.where("__src is not null and __q is not null and __x is not null and not isnan(__x)"))
    blocks = _blocks(rows, m)
    keys = ["__src", "__f", "__block"]

    if m.clock:
        step = F.try_divide(F.col("__x") - F.col("__px"), (F.col("__q") - F.col("__pq")).cast("double"))
        bin_of = F.round(F.log(F.when(step > 0, step)) * F.lit(4.0 * BINS_PER_E))
        bins = rows.groupBy("__src", "__f", bin_of.alias("__b")).agg(F.count(F.lit(1)).alias("__k"))
        period = _median(bins.where("__b is not null"), 4.0 * BINS_PER_E).select("__src", "__f", F.col("__middle").alias("__scale"))
        same = bins.groupBy("__src", "__f").agg(F.lit(1e-9).alias("__same"), F.sum("__k").alias("__all"))
        own = same.join(period, ["__src", "__f"], "left")
    else:

        def histogram(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
            n, x = _arrays(part, "__n", "__x")
            x = np.clip(x, -1e15, 1e15)
            here = n // m.block == key[2].as_py()
            before, after = sides(x)
            off = np.abs(x - (before + after) / 2)[here] if len(x) > 2 else np.empty(0)
            off = off[~np.isnan(off)]
            bin_of = np.where(off > 0, np.round(np.log(np.maximum(off, 1e-30)) * BINS_PER_E), NONE).astype(np.int64)
            b, k = np.unique(np.concatenate([bin_of, np.full(np.sum((x[1:] == x[:-1]) & here[1:]), EQUAL), np.full(here.sum(), EQUAL - 1)]), return_counts=True)
            return pa.table({"__src": pa.array([key[0].as_py()] * len(b), pa.string()), "__f": np.full(len(b), key[1].as_py(), dtype=np.int32), "__b": b.astype(np.int64), "__k": k.astype(np.int64)})

        # The bins of a source are bounded in number, whatever its size.
        bins = blocks.groupBy(*keys).applyInArrow(histogram, "__src string, __f int, __b long, __k long").groupBy("__src", "__f", "__b").agg(F.sum("__k").alias("__k"))
        scatter = _median(bins.where(F.col("__b") > NONE), float(BINS_PER_E)).select("__src", "__f", (F.col("__middle") / F.lit(0.6745)).alias("__scale"))
        count = {name: F.coalesce(F.sum(F.when(F.col("__b") == code, F.col("__k"))), F.lit(0)) for name, code in (("same", EQUAL), ("all", EQUAL - 1))}
        same = bins.groupBy("__src", "__f").agg(F.greatest(F.lit(1e-4), F.least(F.lit(0.1), F.try_divide(count["same"], count["all"]))).alias("__same"), count["all"].alias("__all"))
        own = same.join(scatter, ["__src", "__f"], "left")

    names = {SPIKE: "spike", STUCK: "stuck", RANGE: "range"}

    def flags(key: tuple[pa.Scalar, ...], part: pa.Table, of_source: pa.Table) -> pa.Table:
        n, q, x = _arrays(part, "__n", "__q", "__x")
        scale, same = (None, None) if not len(of_source) else (of_source["__scale"][0].as_py(), of_source["__same"][0].as_py())
        f = int(key[1].as_py())
        flag, p = np.empty(0, dtype=np.int8), np.empty(0)
        if len(x):
            flag, p = flag_sequence(q, x, (1.0 if m.clock else np.inf) if scale is None else scale, 1e-9 if m.clock else 1e-4 if same is None else same, bounds[fields[f]], m, begins=n[0] == 0)
        at = np.flatnonzero((flag > 0) & (n // m.block == key[2].as_py()))
        return pa.table({
            "source": pa.array([key[0].as_py()] * len(at), pa.string()), "seq": q[at], "field": pa.array([fields[f]] * len(at), pa.string()),
            "flag": pa.array([names[k] for k in flag[at]], pa.string()), "probability": p[at],
        })

    # Both sides of the cogroup are keyed by source, field and block; the rows' exchange is the one made above.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__all") - 1) / F.lit(m.block))))
    per_block = own.where("__all > 0").select(F.col("__src").alias("__t"), F.col("__f").alias("__g"), every.alias("__c"), "__scale", "__same")
    return blocks.groupBy(*keys).cogroup(per_block.groupBy("__t", "__g", "__c")).applyInArrow(flags, "source string, seq long, field string, flag string, probability double")


def _arrays(part: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a block in order of its readings' numbers."""
    order = np.argsort(part["__n"].to_numpy(), kind="stable")
    return [part[name].to_numpy()[order] for name in names]
