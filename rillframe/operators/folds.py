"""Operators whose next step depends on what was kept before.

Rows of an entity are taken in order by one pass over sorted partitions: whatever an entity's size, and
however much a row puts out, a task holds one batch of rows, a piece of what comes out and the entity's small state. Where the outcome before a point can't
matter after it, ``cut`` splits an entity there, so that its parts run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators.blocks import FRAMES, TIME_US, with_neighbours, with_running

Step = Callable[[Any, tuple], tuple[Any, Iterable[tuple]]]

#: Rows that are put out at a time.
PIECE = 10_000


def in_pieces(rows: Iterable[tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Tables of at most ``PIECE`` of the rows, which are taken as they are needed."""
    rows = iter(rows)
    while piece := list(islice(rows, PIECE)):
        yield pd.DataFrame(piece, columns=list(columns))


def ordered_fold(df: DataFrame, *, by: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Step, schema: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """``step(state, row)`` over the rows of each entity in order gives the new state and rows to put out.

    Rows put out begin with the entity's key. ``finish`` may put out more when the entity ends. Rows
    with a null key form an entity like others; empty tables give no rows. A step that puts out many rows
    may give them as an iterator.
    """
    names = df.columns
    keys = [names.index(c) for c in by]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        state, key = None, None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                now = tuple(row[k] for k in keys)
                if key is None or now != key:
                    if key is not None and finish:
                        yield from ((*key, *r) for r in finish(state))
                    state, key = start(), now
                state, rows = step(state, row)
                for r in rows:
                    yield (*key, *r)
        if key is not None and finish:
            yield from ((*key, *r) for r in finish(state))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_pieces(put(batches), [f.split()[0] for f in schema.split(",")])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def cut(df: DataFrame, *, by: Sequence[str], time: str, gap: int, out: str = "part", block: int = 600_000_000) -> DataFrame:
    """``df`` with ``out``: a number that grows at every row that follows the one before by ``gap`` or more; rows of one time share it.

    Entities are split by time block for this; the count of cuts in the blocks before is added up from
    one row per block.
    """
    keys = [F.col(c) for c in by]
    rows = df.withColumn("__b", F.floor(F.col(time) / F.lit(block)))
    inside = Window.partitionBy(*keys, "__b").orderBy(time)
    ends = rows.groupBy(*by, "__b").agg(F.max(time).alias("__hi"))
    over = Window.partitionBy(*keys).orderBy("__b")
    rows = rows.join(ends.select(*by, "__b", F.lag("__hi").over(over).alias("__carry")), [*by, "__b"])
    flag = F.coalesce((F.col(time) - F.coalesce(F.lag(time).over(inside), F.col("__carry")) >= gap).cast("int"), F.lit(0))
    rows = rows.withColumn("__f", flag)
    before = rows.groupBy(*by, "__b").agg(F.sum("__f").alias("__cuts"))
    before = before.select(*by, "__b", F.coalesce(F.sum("__cuts").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rows = rows.join(before, [*by, "__b"])
    return rows.withColumn(out, F.col("__base") + F.sum("__f").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__b", "__carry", "__f", "__base")


def keep_spaced(df: DataFrame, *, by: Sequence[str], start: str, end: str, event_id: str, span: int) -> DataFrame:
    """Events that start at least ``span`` after the end of the last one kept: entity, ``event_id``, start, end.

    An event that starts so long after all ends before it is kept whatever came before: entities are cut there.
    """

    def step(last: int | None, row: tuple) -> tuple[int | None, list[tuple]]:
        s, t, number = row[-3:]
        if last is None or s - last >= span:
            return t, [(number, s, t)]
        return last, []

    rows = df.select(*by, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__t"), F.col(event_id).alias("__id")).dropna()
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"{event_id} {types['__id']}", f"{start} bigint", f"{end} bigint"])
    order = ["__s", "__id"]
    rows = with_running(rows, by=by, order=order, values={"__reach": ("max", F.col("__t"))}, block=TIME_US, before=True)
    free = F.coalesce(F.col("__s") - F.col("__reach") >= span, F.lit(True)).cast("long")
    rows = with_running(rows, by=by, order=order, values={"__part": ("sum", free)}, block=TIME_US)
    schema = schema.replace(f"{event_id} ", f"__part bigint, {event_id} ", 1)
    return ordered_fold(rows.select(*by, "__part", "__s", "__t", "__id"), by=[*by, "__part"], order=order, start=lambda: None, step=step, schema=schema).drop("__part")


def keep_cadence(df: DataFrame, *, by: Sequence[str], frame: str, gap: int) -> DataFrame:
    """First and last frame and those at least ``gap`` after the last kept one: entity, ``frame``.

    A frame that far from the frame before it is kept in any case: entities are cut there.
    """

    def step(kept: int | None, row: tuple) -> tuple[int, list[tuple]]:
        f = row[-1]
        return (f, [(f,)]) if kept is None or f - kept >= gap else (kept, [])

    rows = df.select(*by, F.col(frame).cast("long").alias(frame)).dropna().distinct()
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), f"__part bigint, {frame} bigint"])
    near = with_neighbours(rows, by=by, order=[frame], take=[frame], block=FRAMES, following=None)
    far = F.coalesce(F.col(frame) - F.col(f"__prev.{frame}") >= gap, F.lit(True)).cast("long")
    parts = with_running(near.withColumn("__far", far).drop("__prev"), by=by, order=[frame], values={"__part": ("sum", F.col("__far"))}, block=FRAMES)
    kept = ordered_fold(parts.select(*by, "__part", frame), by=[*by, "__part"], order=[frame], start=lambda: None, step=step, schema=schema).drop("__part")
    last = rows.groupBy(*by).agg(F.max(frame).alias(frame))
    return kept.unionByName(last).distinct()


def suppress_peaks(df: DataFrame, *, by: Sequence[str], a: str, b: str, rank: Sequence[Column], radius: int, most: int, both: bool = False) -> DataFrame:
    """Best peaks of each entity in the order of ``rank``: entity, ``place``, ``a``, ``b``.

    A peak falls if a kept one has ``a`` or ``b`` (``both``: and ``b``) within ``radius``; at most
    ``most`` are kept, which is what bounds the state.
    """

    def step(kept: list[tuple], row: tuple) -> tuple[list[tuple], list[tuple]]:
        x, y = row[-2:]
        if len(kept) >= most:
            return kept, []
        for u, v in kept:
            near = (abs(x - u) <= radius, abs(y - v) <= radius)
            if all(near) if both else any(near):
                return kept, []
        kept.append((x, y))
        return kept, [(len(kept), x, y)]

    order = [f"__o{i}" for i in range(len(rank))]
    rows = df.select(*by, *(c.alias(o) for c, o in zip(rank, order)), F.col(a).cast("long").alias("__a"), F.col(b).cast("long").alias("__b"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "place int", f"{a} bigint", f"{b} bigint"])
    return ordered_fold(rows, by=by, order=order, start=list, step=step, schema=schema)


def match_pairs(left: DataFrame, right: DataFrame, *, by: Sequence[str], time: str, window: int) -> DataFrame:
    """Greedy one-to-one pairs of two streams: entity, ``left_time``, ``right_time``.

    The heads of both streams are paired if they lie within ``window``, otherwise the older one is
    dropped. Where neither stream has a row for longer than the window, what came before can't pair with
    what follows: streams are cut there.
    """

    def step(state: tuple[list, list], row: tuple) -> tuple[tuple[list, list], list[tuple]]:
        queues, side, t = state, row[-1], row[-2]
        queues[side].append(t)
        out = []
        while queues[0] and queues[1]:
            x, y = queues[0][0], queues[1][0]
            if abs(x - y) <= window:
                out.append((x, y))
                queues[0].pop(0)
                queues[1].pop(0)
            else:
                queues[0 if x < y else 1].pop(0)
        # A head older than the window can pair with nothing that is still to come.
        for q in queues:
            while q and t - q[0] > window:
                q.pop(0)
        return queues, out

    sides = [d.select(*by, F.col(time).cast("long").alias("__t"), F.lit(k).alias("__side")).dropna() for k, d in enumerate((left, right))]
    rows = cut(sides[0].unionByName(sides[1]), by=by, time="__t", gap=window + 1, out="__part")
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "part bigint", "left_time bigint", "right_time bigint"])
    pairs = ordered_fold(rows.select(*by, "__part", "__t", "__side"), by=[*by, "__part"], order=["__t", "__side"], start=lambda: ([], []), step=step, schema=schema)
    return pairs.drop("part")
