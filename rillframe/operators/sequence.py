"""Ordered rows: clocks, events to windows, decimation, gaps and neighbours.

What lies before and after comes from ``operators.blocks``, so an entity is never sorted in one task.
Rows with a null entity or leading order value are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions.geometry import lerp, slerp
from rillframe.operators.blocks import FRAMES, TIME_US, with_neighbours, with_number, with_running


def mark_monotonic(df: DataFrame, *, by: Sequence[str], order: Sequence[str], time: str, out: str = "valid", block: float = FRAMES) -> DataFrame:
    """``out`` is false where the next time isn't later; the last row is always valid."""
    rows = with_neighbours(df, by=by, order=order, take=[time], block=block, prev=None)
    return rows.withColumn(out, F.coalesce(F.col(f"__next.{time}") > F.col(time), F.lit(True))).drop("__next")


def increasing_run(df: DataFrame, *, by: Sequence[str], order: Sequence[str], time: str, block: float = FRAMES) -> DataFrame:
    """Rows that are valid by ``mark_monotonic`` and later than all valid ones before."""
    rows = mark_monotonic(df, by=by, order=order, time=time, out="__ok", block=block)
    most = {"__most": ("max", F.when(F.col("__ok"), F.col(time)))}
    rows = with_running(rows, by=by, order=order, values=most, block=block, before=True)
    return rows.where(F.col("__ok") & (F.col("__most").isNull() | (F.col(time) > F.col("__most")))).drop("__ok", "__most")


def repaired_timeline(df: DataFrame, *, by: Sequence[str], order: Sequence[str], time: str, out: str = "time_s", block: float = FRAMES) -> DataFrame:
    """Seconds from the first row on; a step that isn't positive counts as the entity's median positive one."""
    rows = with_neighbours(df, by=by, order=order, take=[time], block=block, following=None)
    rows = rows.withColumn("__d", F.col(time) - F.col(f"__prev.{time}"))
    usual = rows.groupBy(*by).agg(F.median(F.when(F.col("__d") > 0, F.col("__d"))).alias("__median"))
    step = F.when(F.col("__d") > 0, F.col("__d").cast("double")).when(F.col("__d").isNotNull(), F.col("__median")).otherwise(0.0)
    rows = with_running(rows.join(usual, list(by)), by=by, order=order, values={"__sum": ("sum", step)}, block=block)
    return rows.withColumn(out, F.col("__sum") / 1e6).drop("__prev", "__d", "__median", "__sum")


def burst_collapse(df: DataFrame, *, by: Sequence[str], start: str, end: str, event_id: str, gap: int, block: float = TIME_US) -> DataFrame:
    """Events merged while each starts less than ``gap`` after the latest end: entity, ``first_event``, ``n``, start, end."""
    order = [start, event_id]
    rows = with_running(df.select(*by, start, end, event_id), by=by, order=order, values={"__reach": ("max", F.col(end))}, block=block, before=True)
    opens = F.when(F.col(start) - F.col("__reach") < gap, 0).otherwise(1)
    rows = with_running(rows, by=by, order=order, values={"__g": ("sum", opens)}, block=block)
    out = rows.groupBy(*by, "__g").agg(F.min(F.struct(F.col(start), F.col(event_id))).alias("__f"), F.count(F.lit(1)).alias("n"), F.max(end).alias("__e"))
    return out.select(*by, F.col(f"__f.{event_id}").alias("first_event"), "n", F.col(f"__f.{start}").alias(start), F.col("__e").alias(end))


def delimiter_windows(df: DataFrame, *, by: Sequence[str], start: str, end: str, event_id: str, head: bool = False, tail: bool = False, block: float = TIME_US) -> DataFrame:
    """Windows between consecutive delimiters: entity, ``start_us`` (end of one), ``end_us`` (start of the next).

    ``head`` adds the stretch before the first (no start), ``tail`` the one after the last (no end).
    """
    rows = with_neighbours(df.select(*by, start, end, event_id), by=by, order=[start, event_id], take=[start, end], block=block)
    after = F.col(f"__next.{start}")
    cases = [F.when(F.col("__next").isNotNull() | F.lit(tail), F.struct(F.col(end).alias("s"), after.alias("e")))]
    if head:
        cases.append(F.when(F.col("__prev").isNull(), F.struct(F.lit(None).cast("long").alias("s"), F.col(start).alias("e"))))
    out = rows.select(*by, F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("__w"))
    return out.select(*by, F.col("__w.s").alias("start_us"), F.col("__w.e").alias("end_us"))


def paired_windows(df: DataFrame, *, by: Sequence[str], role: str, start: str, end: str, event_id: str, extend: bool = False, block: float = TIME_US) -> DataFrame:
    """Windows from a start event's end to the stop event that follows it: entity, ``start_us``, ``end_us``.

    A second start replaces the open one, a stop without a start is ignored, and at equal times starts
    come first. ``extend`` keeps a start that no event follows as a window without an end.
    """
    rows = df.where(F.col(role).isin("start", "stop")).select(*by, role, start, end, event_id, F.when(F.col(role) == "start", 0).otherwise(1).alias("__rank"))
    rows = with_neighbours(rows, by=by, order=[start, "__rank", event_id], take=[role, end], block=block)
    closed = F.when((F.col(role) == "stop") & (F.col(f"__prev.{role}") == "start"), F.struct(F.col(f"__prev.{end}").alias("s"), F.col(start).alias("e")))
    opened = F.when(F.lit(extend) & (F.col(role) == "start") & F.col("__next").isNull(), F.struct(F.col(end).alias("s"), F.lit(None).cast("long").alias("e")))
    out = rows.select(*by, F.coalesce(closed, opened).alias("__w")).where("__w is not null")
    return out.select(*by, F.col("__w.s").alias("start_us"), F.col("__w.e").alias("end_us"))


def phrase_matches(words: DataFrame, *, by: Sequence[str], order: Sequence[str], token: str, start: str, end: str, probability: str, phrase: Sequence[str], min_probability: float, max_gap: int, block: float = TIME_US) -> DataFrame:
    """Places where consecutive words are the phrase: entity, ``start_us``, ``end_us``, ``min_probability``.

    Words may lie at most ``max_gap`` apart and each needs the least probability. A phrase none of whose
    beginnings is also an ending can't overlap itself; others raise ValueError. Words are numbered in blocks, and
    only those of the phrase meet, by their numbers.
    """
    n = len(phrase)
    if n == 0 or any(list(phrase[:k]) == list(phrase[n - k :]) for k in range(1, n)):
        raise ValueError("the phrase is empty or may overlap itself")
    rows = with_number(words.select(*dict.fromkeys([*by, *order, token, start, end, probability])), by=by, order=order, block=block, out="__i")
    sure = rows.where(F.col(probability) >= min_probability)
    said = lambda k: sure.where(F.col(token) == phrase[k]).select(*by, (F.col("__i") - k).alias("__i"), F.col(start).alias(f"__s{k}"), F.col(end).alias(f"__e{k}"), F.col(probability).alias(f"__p{k}"))
    found = said(0)
    for k in range(1, n):
        found = found.join(said(k), [*by, "__i"]).where(F.col(f"__s{k}") - F.col(f"__e{k - 1}") <= max_gap)
    low = F.least(*(f"__p{k}" for k in range(n))) if n > 1 else F.col("__p0")
    return found.select(*by, F.col("__s0").alias("start_us"), F.col(f"__e{n - 1}").alias("end_us"), low.alias("min_probability"))


def stride(df: DataFrame, *, by: Sequence[str], order: Sequence[str], every: int, block: float = FRAMES) -> DataFrame:
    """Every ``every``-th row, the first one included."""
    return with_number(df, by=by, order=order, block=block, out="__n").where(F.col("__n") % every == 0).drop("__n")


def fractional_indices(count: Column, step: Column) -> Column:
    """Distinct indices below ``count`` nearest to the multiples of ``step`` (at least 1), halves to even."""
    s = F.greatest(step.cast("double"), F.lit(1.0))
    n = F.greatest(F.ceil(count / s).cast("int"), F.lit(1))
    marks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.rint(k * s).cast("long"))
    return F.filter(F.array_distinct(marks), lambda k: k < count)


def window_starts(length: Column, window: int, overlap: int) -> Column:
    """First positions of windows that cover ``length`` rows with an overlap; the last one ends at the end."""
    if window <= overlap:
        raise ValueError("the window must exceed the overlap")
    step = window - overlap
    last = length - window
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(step).cast("long"))
    return F.when(length <= window, F.array(F.lit(0).cast("long"))).when(last % step == 0, regular).otherwise(F.array_append(regular, last.cast("long")))


def sparse_sample(df: DataFrame, *, by: Sequence[str], order: Sequence[str], every: int, out: str = "right_eye", block: float = FRAMES) -> DataFrame:
    """``out`` is true for every ``every``-th row of an entity and for its first and last."""
    rows = with_number(df, by=by, order=order, block=block, out="__n")
    rows = with_neighbours(rows, by=by, order=order, take=["__n"], block=block, prev=None)
    return rows.withColumn(out, (F.col("__n") % every == 0) | F.col("__next").isNull()).drop("__n", "__next")


def accel_triples(df: DataFrame, *, by: Sequence[str], frame: str, time: str, block: float = FRAMES) -> DataFrame:
    """Rows whose frame has both neighbours, with the times to them in terms of the entity's median step: ``prev_scale``, ``next_scale``.

    A step that isn't positive gives a null scale.
    """
    rows = with_neighbours(df, by=by, order=[frame], take=[frame, time], block=block)
    joined = F.col(frame) - F.col(f"__prev.{frame}") == 1
    back, ahead = F.col(time) - F.col(f"__prev.{time}"), F.col(f"__next.{time}") - F.col(time)
    usual = rows.where(joined).groupBy(*by).agg(F.median(back).alias("__ref"))
    rows = rows.where(joined & (F.col(f"__next.{frame}") - F.col(frame) == 1)).join(usual, list(by))
    scale = lambda d: F.when(d > 0, F.col("__ref") / d)
    return rows.withColumns({"prev_scale": scale(back), "next_scale": scale(ahead)}).drop("__prev", "__next", "__ref")


def second_difference(df: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, prev_scale: Column | float = 1.0, next_scale: Column | float = 1.0, out: str = "second", block: float = FRAMES) -> DataFrame:
    """``df`` with the scaled second difference ``prev_scale * (before - x) + next_scale * (after - x)``; null at the ends."""
    rows = with_neighbours(df, by=by, order=order, take=[value], block=block)
    x = F.col(value)
    return rows.withColumn(out, prev_scale * (F.col(f"__prev.{value}") - x) + next_scale * (F.col(f"__next.{value}") - x)).drop("__prev", "__next")


def fill_gaps(df: DataFrame, *, by: Sequence[str], frame: str, time: str, vectors: Sequence[str] = (), rotations: Sequence[str] = (), values: Sequence[str] = (), longest: int, block: float = FRAMES) -> DataFrame:
    """Rows of frames missing inside an entity, in gaps of at most ``longest`` frames, interpolated by time.

    Kept rows have ``interpolated`` false; filled ones true and ``source_frames`` of either side. Their
    time lies evenly between those of the sides. Longer gaps, and what lies outside, stay empty.
    """
    cols = [*vectors, *rotations, *values]
    rows = with_neighbours(df.select(*by, frame, time, *cols), by=by, order=[frame], take=[frame, time, *cols], block=block, prev=None, following="__n")
    missing = F.col(f"__n.{frame}") - F.col(frame) - 1
    kept = rows.select(*by, frame, time, *cols, F.lit(False).alias("interpolated"), F.array(F.col(frame)).alias("source_frames"))
    gaps = rows.where(missing.between(1, longest)).withColumn("__f", F.explode(F.sequence(F.col(frame) + 1, F.col(f"__n.{frame}") - 1)))
    alpha = (F.col("__f") - F.col(frame)) / (F.col(f"__n.{frame}") - F.col(frame))
    between = lambda c: F.col(c) + alpha * (F.col(f"__n.{c}") - F.col(c))
    mixed = [lerp(F.col(c), F.col(f"__n.{c}"), alpha).alias(c) for c in vectors] + [slerp(F.col(c), F.col(f"__n.{c}"), alpha).alias(c) for c in rotations] + [between(c).alias(c) for c in values]
    when = between(time).cast(dict(df.dtypes)[time]).alias(time)
    filled = gaps.select(*by, F.col("__f").alias(frame), when, *mixed, F.lit(True).alias("interpolated"), F.array(F.col(frame), F.col(f"__n.{frame}")).alias("source_frames"))
    return kept.unionByName(filled)


def track_edges(df: DataFrame, *, by: Sequence[str], frame: str) -> DataFrame:
    """Edges of a segment: between adjacent frames, and from its middle frame to all others: entity, ``a``, ``b``, ``edge``.

    Where both kinds name the same pair the adjacent one holds.
    """
    w = Window.partitionBy(*by).orderBy(frame)
    rows = df.select(*by, F.col(frame).alias("__f")).distinct()
    w = Window.partitionBy(*by).orderBy("__f")
    rows = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*by)), "__next": F.lead("__f").over(w)})
    middle = F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.col("__f"))).over(Window.partitionBy(*by))
    middle_at = F.floor(F.col("__n") / 2)
    rows = rows.withColumn("__m", middle)
    adjacent = F.when(F.col("__next").isNotNull(), F.struct(F.col("__f").alias("a"), F.col("__next").alias("b"), F.lit("adjacent").alias("edge")))
    anchored = F.when(F.abs(F.col("__i") - middle_at) > 1, F.struct(F.least("__f", "__m").alias("a"), F.greatest("__f", "__m").alias("b"), F.lit("anchor").alias("edge")))
    out = rows.select(*by, F.explode(F.filter(F.array(adjacent, anchored), lambda e: e.isNotNull())).alias("__e"))
    return out.select(*by, "__e.*")


def renumber(df: DataFrame, *, by: Sequence[str], order: Sequence[str], out: str = "index", block: float = TIME_US) -> DataFrame:
    """``out`` counts the rows of an entity from 0."""
    return with_number(df, by=by, order=order, block=block, out=out)


def first_per_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def zip_rows(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], block: float = TIME_US) -> DataFrame:
    """The n-th row of one side with the n-th of the other, per entity; what has no partner is left out."""
    a = renumber(left, by=by, order=left_order, out="__n", block=block)
    b = renumber(right, by=by, order=right_order, out="__n", block=block)
    return a.join(b, [*by, "__n"]).drop("__n")
