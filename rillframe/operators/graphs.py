"""Tables of nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.operators.asof import range_join
from rillframe.operators.folds import ordered_fold
from rillframe.operators.kinematics import _multiply


def between_nodes(edges: DataFrame, nodes: DataFrame, *, by: Sequence[str], a: str, b: str, node: str) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ends = lambda c: nodes.select(*by, F.col(node).alias(c)).distinct()
    return edges.join(ends(a), [*by, a], "left_semi").join(ends(b), [*by, b], "left_semi")


def best_steps(edges: DataFrame, *, by: Sequence[str], a: str, b: str, quality: str, position: str) -> DataFrame:
    """For each two consecutive frames the best edge, the first of equally good ones."""
    w = Window.partitionBy(*by, a).orderBy(F.col(quality).desc(), F.col(position))
    return edges.where(F.col(b) == F.col(a) + 1).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_by_priority(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several tables, of each key only those of the first table that has it, once."""
    both = None
    for k, df in enumerate(parts):
        df = df.withColumn("__p", F.lit(k))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__p")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__p")


def composed_rotations(steps: DataFrame, pairs: DataFrame, *, by: Sequence[str], frame: str, rotation: str, valid: str, a: str, b: str) -> DataFrame:
    """Rotation from frame ``a`` to frame ``b`` of each pair by the steps in between: entity, a, b, ``w``, ``x``, ``y``, ``z``.

    Null where a step is missing or isn't valid. ``steps`` has one row per frame: the rotation to the next.
    """
    spans = pairs.select(*by, a, b, (F.col(b) - 1).alias("__last")).where(F.col(b) > F.col(a)).distinct()
    held = range_join(steps.select(*by, F.col(frame).alias("__f"), F.col(rotation).alias("__r"), F.col(valid).alias("__ok")), spans, by=by, time="__f", start=a, end="__last", take=[a, b], width=1024)
    rows = held.select(*by, a, b, "__f", "__ok", *(F.col("__r")[c].alias(f"__{c}") for c in "wxyz"))

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, q = state
        _, ok, *r = row[-6:]
        if q is None or not ok or any(v is None or v != v for v in r):
            return (n + 1, None), []
        q = _multiply(r, q)
        size = sum(v * v for v in q) ** 0.5
        return (n + 1, tuple(v / size for v in q)), []

    types = dict(rows.dtypes)
    keys = [*by, a, b]
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "n bigint, w double, x double, y double, z double"])
    done = ordered_fold(rows, by=keys, order=["__f"], start=lambda: (0, (1.0, 0.0, 0.0, 0.0)), step=step, schema=schema, finish=lambda s: [(s[0], *(s[1] or (None,) * 4))])
    full = pairs.select(*by, a, b).distinct().join(done, keys, "left")
    whole = F.col("n") == F.col(b) - F.col(a)
    return full.select(*keys, *(F.when(whole, F.col(c)).alias(c) for c in "wxyz"))


def snapped_pairs(pairs: DataFrame, frames: DataFrame, *, by: Sequence[str], frame: str, a: str, b: str) -> DataFrame:
    """Pairs with both ends moved to the nearest frame there is, the lower of equally near ones."""
    from rillframe.operators.asof import asof

    known = frames.select(*by, F.col(frame).cast("long").alias("__at")).distinct()
    for c in (a, b):
        pairs = asof(pairs, known, by=by, left_time=c, right_time="__at", take=[], direction="nearest", out="__m").withColumn(c, F.col("__m.at")).drop("__m")
    return pairs


def is_subset(a: Column, b: Column) -> Column:
    """Whether all elements of an array are in another."""
    return F.size(F.array_except(a, b)) == 0


def loop_edges(df: DataFrame, *, by: Sequence[str], segment: str, position: str) -> DataFrame:
    """One edge for each window of two segments, 0 and 1, between their middle frames: window, ``a``, ``b``.

    The middle of an even number is the later one. Windows without one of the segments have no edge.
    """
    rows = df.select(*by, F.col(segment).alias("__s"), F.col(position).alias("__p")).dropna().where("__s in (0, 1)")
    held = rows.groupBy(*by).agg(*(F.sort_array(F.collect_list(F.when(F.col("__s") == k, F.col("__p")))).alias(f"__{k}") for k in (0, 1)))
    middle = lambda c: F.get(c, F.call_function("div", F.size(c), F.lit(2)).cast("int"))
    return held.select(*by, middle(F.col("__0")).alias("a"), middle(F.col("__1")).alias("b")).dropna(subset=["a", "b"])
