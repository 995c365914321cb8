"""Stateful operators on streams, keyed by rig, and what needs no state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rillframe.operators.blocks import FRAMES
from rillframe.operators.folds import in_pieces, ordered_fold
from rillframe.streaming.steps import Step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _objects(df: pd.DataFrame) -> pd.DataFrame:
    """Text in plain object columns, which Arrow takes in one piece."""
    return df.astype({c: object for c in df.columns if not len(df) or df[c].dtype.kind not in "ifb"})


class Fold(StatefulProcessor):
    """Runs a step over a key's rows, in the order of ``order`` within each batch."""

    def __init__(self, step: Step, key: str, order: str, columns: Sequence[str]) -> None:
        self.step, self.key, self.order, self.columns = step, key, order, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")

        def put() -> Iterator[tuple]:
            nonlocal state
            for row in batch.to_dict("records"):
                state, found = self.step(state, {k: v.item() if hasattr(v, "item") else v for k, v in row.items()})
                for r in found:
                    yield (key[0], *r)

        yield from map(_objects, in_pieces(put(), [self.key, *self.columns]))
        self.state.update((json.dumps(state),))

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """One row per key and silence of more than ``limit_ms`` of event time: when the watermark passes the limit, or when a row comes after it."""

    def __init__(self, key: str, time: str, limit_ms: int) -> None:
        self.key, self.time, self.limit = key, time, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, told boolean")

    def _alerts(self, key: Any, times: Sequence[int]) -> pd.DataFrame:
        return _objects(pd.DataFrame([(key[0], t) for t in times], columns=[self.key, "silent_since_ms"]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted({int(t.timestamp() * 1000) for b in rows for t in b[self.time]})
        last, told = self.last.get() if self.last.exists() else (None, False)
        if last is not None:
            self.handle.deleteTimer(last + self.limit)
        alerts, now = [], last
        for t in times:
            if now is not None and t - now > self.limit and not (told and now == last):
                alerts.append(now)
            now = t if now is None else max(now, t)
        self.last.update((now, bool(told and now == last)))
        self.handle.registerTimer(now + self.limit)
        yield self._alerts(key, alerts)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, told = self.last.get()
        self.last.update((last, True))
        yield self._alerts(key, [] if told else [last])

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, *, key: str, order: str, step: Step, schema: str) -> DataFrame:
    """``step`` over each key's rows as they come; ``schema`` is of what it puts out, behind the key."""
    full = StructType.fromDDL(f"{key} {dict(df.dtypes)[key]}, {schema}")
    return df.groupBy(key).transformWithStateInPandas(Fold(step, key, order, full.names[1:]), full, "Append", "None")


def fold_table(df: DataFrame, *, key: str, order: str, step: Step, schema: str) -> DataFrame:
    """The same over a table."""
    names = df.columns
    one = lambda state, row: step(state, dict(zip(names, row)))
    return ordered_fold(df, by=[key], order=[order], start=lambda: None, step=one, schema=f"{key} {dict(df.dtypes)[key]}, {schema}")


def mailbox_table(df: DataFrame, *, key: str, order: str, value: str, period: int, block: int = FRAMES) -> DataFrame:
    """``steps.mailbox`` over a table, as expressions: key, ``tick``, ``value``, ``sent``. What a row sends is known from the row after it.

    Rows lie by key and ``block`` ticks, and a gap is put out in pieces of as many: neither a hot key nor a long gap
    is held in one piece. Rows without key or time are left out.
    """
    rows = df.select(F.col(key), F.col(order).cast("long").alias("__t"), F.col(value).alias(value)).dropna(subset=[key, "__t"])
    rows = rows.withColumn("__b", F.floor(F.col("__t") / F.lit(period * block)))
    # A few rows may put out a lot: as many parts as named here aren't joined by their size.
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    over, inside = Window.partitionBy(key).orderBy("__b"), Window.partitionBy(key, "__b").orderBy("__t")
    lows = rows.groupBy(key, "__b").agg(F.min("__t").alias("__lo"))
    lows = lows.select(key, "__b", F.lead("__lo").over(over).alias("__cn"), F.first("__lo").over(over).alias("__first"))
    rows = rows.repartition(parts, key, "__b").join(lows, [key, "__b"]).withColumn("__next", F.coalesce(F.lead("__t").over(inside), F.col("__cn")))
    ticks = lambda t: F.expr(f"({t} - __first) div {period}")
    rows = rows.select(key, value, "__first", ticks("__t").alias("__k"), (ticks("__next") - ticks("__t")).alias("__n")).where("__n > 0")
    rows = rows.select("*", F.explode_outer(F.expr(f"sequence(0, (__n - 1) div {block})")).alias("__p"))
    begin = F.col("__p") * block
    rows = rows.select(
        key, value, begin.alias("__sent"), (F.col("__first") + (F.col("__k") + 1 + begin) * period).alias("__tick"),
        F.posexplode_outer(F.sequence(F.lit(1), F.least(F.lit(block).cast("long"), F.col("__n") - begin).cast("int"))).alias("__i", "__"),
    )
    return rows.select(key, (F.col("__tick") + F.col("__i").cast("long") * period).alias("tick"), value, (F.col("__sent") + F.col("__i")).alias("sent"))


def watch_silence(df: DataFrame, *, key: str, time: str, limit_ms: int) -> DataFrame:
    """``key`` and ``silent_since_ms`` once a key has been silent for longer than the limit; ``df`` needs a watermark on ``time``."""
    out = StructType.fromDDL(f"{key} {dict(df.dtypes)[key]}, silent_since_ms bigint")
    return df.groupBy(key).transformWithStateInPandas(Silence(key, time, limit_ms), out, "Append", "EventTime")


def without_stale(df: DataFrame, *, time_us: Column, elapsed_us: Column, slack_us: int = 1_000_000) -> DataFrame:
    """Rows whose camera time isn't far ahead of the time since its reset: such times are from before it."""
    return df.where(time_us <= elapsed_us + slack_us)


def batch_profile(df: DataFrame, *, key: str, number: str, every: int = 100) -> DataFrame:
    """Counts and range of every ``every`` numbers of a key."""
    return df.groupBy(key, F.floor(F.col(number) / F.lit(every)).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last"))


def paired_in_time(left: DataFrame, right: DataFrame, *, key: str, time: str, tolerance: str, watermark: str) -> DataFrame:
    """For each left row of a key the nearest right one within a tolerance, the earlier of two, as a join of streams: key, ``left_time``, ``right_time``.

    A left row comes out once the watermark has passed all that could lie nearer.
    """
    a = left.withWatermark(time, watermark).select(F.col(key).alias("__k"), F.col(time).alias("left_time"))
    b = right.withWatermark(time, watermark).select(F.col(key), F.col(time).alias("right_time"))
    near = F.col("right_time").between(F.col("left_time") - F.expr(f"interval {tolerance}"), F.col("left_time") + F.expr(f"interval {tolerance}"))
    off = F.abs(F.unix_micros("right_time") - F.unix_micros("left_time"))
    pairs = a.join(b, (F.col("__k") == F.col(key)) & near)
    return pairs.groupBy(key, "left_time").agg(F.min(F.struct(off.alias("off"), "right_time")).alias("best")).select(key, "left_time", F.col("best.right_time").alias("right_time"))


def each_sample(callback: Callable[[dict], None], warn: Callable[[Exception], None] = print) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands rows to a callback one by one; what it raises is reported and goes no further."""

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            try:
                callback(row.asDict())
            except Exception as e:  # noqa: BLE001
                warn(e)

    return run


def packets(df: DataFrame, *, header: Sequence[str], number: str, rig: Column) -> DataFrame:
    """Messages: a JSON header of the named columns with the number and the hash of the rig's description."""
    return df.select(F.to_json(F.struct(F.col(number).alias("sequence"), F.sha2(rig, 256).alias("rig_sha256"), *header)).alias("value"), F.col(number).cast("string").alias("key"))
