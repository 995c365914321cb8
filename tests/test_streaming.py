"""Streams run to their end, against the same steps over a table."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from rillframe.plans.streams import stream_mailbox
from rillframe.session import write_steps_small
from rillframe.streaming import operators as S
from rillframe.streaming import steps


def play(spark, df, build, tmp_path, pieces=3, schema=None):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    rows = df.collect()
    size = -(-len(rows) // pieces)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], df.schema).coalesce(1).write.mode("append").parquet(src)
    S.use_rocksdb(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def samples(seed=0, n=120):
    rng = random.Random(seed)
    return [(rng.choice("ab"), 10 * k + rng.randrange(10), rng.randrange(2), round(rng.uniform(0.05, 0.9), 3), rng.choice(["put", "put", "take"])) for k in range(n)]


SCHEMA = "rig string, t long, side int, v double, op string"
CASES = {
    "pair": (steps.pair_heads(12), "l long, r long"),
    "ring": (steps.nearest_in_ring(4), "l long, r long"),
    "newest": (steps.bounded_queue(3, "newest"), "t long, dropped long"),
    "oldest": (steps.bounded_queue(3, "oldest"), "t long, dropped long"),
    "mailbox": (steps.mailbox(25), "tick long, v double, sent long"),
    "sequence": (steps.sequence(), "n long, t long"),
    "drift": (steps.drift_warning(0.6, 200), "t long, v double"),
    "exposure": (steps.exposure(), "t long, e double, g double"),
    "deferred": (steps.deferred_write(), "t long, e double, g double"),
}


def test_steps_over_a_table(spark):
    df = spark.createDataFrame(samples(), SCHEMA).withColumns({"exposure": F.round("v", 1), "gain": F.round(10 - 9 * F.col("v"), 0)})
    for name, (step, schema) in CASES.items():
        got = sorted(tuple(r) for r in S.fold_table(df, key="rig", order="t", step=step, schema=schema).collect())
        want = []
        for rig in "ab":
            state = None
            for r in sorted((x.asDict() for x in df.collect() if x["rig"] == rig), key=lambda x: x["t"]):
                state, out = step(state, r)
                want += [(rig, *o) for o in out]
        assert got == sorted(want) and got, name


def over(step, rows):
    state, out = None, []
    for r in rows:
        state, more = step(state, r)
        out += more
    return state, out


def test_mailbox_sends_at_a_fixed_rate():
    _, out = over(steps.mailbox(10), [{"t": t, "v": v} for t, v in ((0, 1), (4, 2), (12, 3), (45, 4), (45, 5), (51, 6))])
    assert out == [(10, 2, 0), (20, 3, 0), (30, 3, 1), (40, 3, 2), (50, 5, 0)]


def test_a_long_gap_is_not_held_in_memory():
    step = steps.mailbox(1)
    tracemalloc.start()
    state, out = step(step(None, {"t": 0, "v": 1})[0], {"t": 500_000, "v": 2})
    n, last = 0, None
    for n, last in enumerate(out, 1):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert state == [500_000, 2, 0] and n == 500_000 and last == (500_000, 1, 499_999) and peak < 5e6


def test_a_fold_holds_a_piece_of_what_a_row_puts_out(spark):
    def step(state, row):
        def out():
            tracemalloc.start()
            yield from ((k,) for k in range(300_000))
            yield (tracemalloc.get_traced_memory()[1],)
            tracemalloc.stop()

        return None, out()

    df = spark.createDataFrame([("a", 1)], "rig string, t long")
    got = [r["n"] for r in S.fold_table(df, key="rig", order="t", step=step, schema="n long").collect()]
    assert got[:-1] == list(range(300_000)) and got[-1] < 8e6


def test_mailbox_over_a_table_equals_its_steps(spark):
    rng = random.Random(5)
    times = {"hot": sorted(rng.sample(range(-50, 4000), 300)), "gaps": [3, 9, 1000, 1003, 70_000, 70_001], "one": [5], "far": [2**53 + 1, 2**53 + 83]}
    rows = [(k, t, None if t % 7 == 0 else float(t % 5)) for k, ts in times.items() for t in ts]
    want = [(k, *o) for k in times for o in over(steps.mailbox(10), [{"t": t, "v": v} for key, t, v in rows if key == k])[1]]
    df = spark.createDataFrame([*rows, ("hot", None, 1.0), (None, 4, 1.0), (None, 400, 1.0)], "rig string, t long, v double")
    for block in (1, 7, 16_384):
        out = S.mailbox_table(df, key="rig", order="t", value="v", period=10, block=block)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert S.mailbox_table(df.limit(0), key="rig", order="t", value="v", period=10).count() == 0


def test_the_query_of_the_mailbox_makes_its_ticks_without_python(spark, tmp_path):
    spark.createDataFrame([(0, 1, 1.5), (400_011, 1, 2.5), (400_050, 1, 3.5), (7, 2, 4.5)], "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = stream_mailbox(spark, str(tmp_path))
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert out.count() == 10_001 and [tuple(r) for r in out.orderBy("tick").tail(2)] == [(1, 400_000, 1.5, 9_999), (1, 400_040, 2.5, 0)]


def test_ticks_take_little_disk(spark, tmp_path):
    at = [0, 12_000_011, 24_000_050, 40_000_007]
    spark.createDataFrame([(t, 1, float(k)) for k, t in enumerate(at)], "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    stream_mailbox(spark, str(tmp_path)).write.parquet(out := str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 500_000
    got = spark.read.parquet(out)
    want = spark.range(1, 1_000_001).select(
        F.lit(1).cast("long").alias("user_id"), (F.col("id") * 40).alias("tick"),
        F.expr("case when id * 40 > 24000050 then 2.0D when id * 40 > 12000011 then 1.0D else 0.0D end").alias("v"),
        F.expr("cast(id - case when id * 40 > 24000050 then 600002 when id * 40 > 12000011 then 300001 else 1 end as int)").alias("sent"),
    )
    assert got.count() == 1_000_000 and got.exceptAll(want).count() == 0


def test_what_is_set_for_writing_comes_first(spark):
    keys = ["parquet.writer.version", "parquet.block.row.count.limit", "parquet.enable.dictionary#tick"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set(keys[0], "PARQUET_1_0")
        write_steps_small(spark, ["tick"])
        assert [spark.conf.get(k, None) for k in keys] == ["PARQUET_1_0", "16777216", "false"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_the_brighter_half_of_a_pair_waits():
    asked = [(8, 1), (8, 2), (16, 2), (8, 4), (9, 9), (8, 4), (8, 4), (16, 2), (16, 2), (16, 2)]
    _, out = over(steps.deferred_write(2), [{"t": k, "exposure": e, "gain": g} for k, (e, g) in enumerate(asked)])
    assert [o[1:] for o in out] == [(8, 1), (8, 2), (16, 2), (8, 2), (8, 2), (8, 4), (8, 4), (8, 2), (8, 2), (16, 2)]


def test_a_silent_side_doesnt_fill_the_state():
    state, out = over(steps.pair_heads(12), [{"side": 0, "t": t} for t in range(0, 10_000, 5)])
    assert out == [] and len(state[0]) <= 3


def test_a_stream_puts_out_a_long_gap(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 250_005, 2.0), ("a", 250_010, 3.0)], "rig string, t long, v double")
    got = play(spark, df, lambda s: S.fold_stream(s, key="rig", order="t", step=steps.mailbox(10), schema="tick long, v double, sent long"), tmp_path)
    assert got == [("a", 10 * k, 1.0, k - 1) for k in range(1, 25_001)] + [("a", 250_010, 2.0, 0)]


@pytest.mark.parametrize("name", ["pair", "exposure"])
def test_stream_equals_table(spark, tmp_path, name):
    step, schema = CASES[name]
    df = spark.createDataFrame(samples(3), SCHEMA)
    got = play(spark, df, lambda s: S.fold_stream(s, key="rig", order="t", step=step, schema=schema), tmp_path)
    assert got == sorted(tuple(r) for r in S.fold_table(df, key="rig", order="t", step=step, schema=schema).collect())


def test_silence(spark, tmp_path):
    rows = [("a", 0), ("b", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 30), ("a", 60)]
    df = spark.createDataFrame(rows, "rig string, s long").select("rig", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
    got = play(spark, df, lambda s: S.watch_silence(s.withWatermark("ts", "1 second"), key="rig", time="ts", limit_ms=5000), tmp_path, pieces=7)
    assert ("b", 1_000_000) in got and ("a", 1_003_000) in got


def test_join_of_streams(spark, tmp_path):
    at = lambda rows: spark.createDataFrame(rows, "rig string, s double").select("rig", F.timestamp_micros((F.col("s") * 1e6).cast("long") + 1_000_000_000).alias("ts"))
    left, right = at([("a", 0.0), ("a", 100.0), ("b", 7.0), ("c", 5.0)]), at([("a", 2.0), ("a", -1.0), ("a", 1.0), ("a", 101.5), ("a", 99.0), ("b", 9.0), ("c", 9.0)])
    off = lambda rows: sorted((k, (b - a).total_seconds()) for k, a, b in rows)
    want = [("a", -1.0), ("a", -1.0), ("b", 2.0)]
    args = {"key": "rig", "time": "ts", "tolerance": "3 seconds", "watermark": "10 seconds"}
    assert off(map(tuple, S.paired_in_time(left, right, **args).collect())) == want
    # A later row on either side lets the watermark pass.
    late = at([("z", 10_000.0)])
    right.union(late).coalesce(1).write.parquet(str(tmp_path / "right"))

    def build(s):
        return S.paired_in_time(s, spark.readStream.schema(left.schema).parquet(str(tmp_path / "right")), **args)

    got = play(spark, left.union(late), build, tmp_path, pieces=1)
    assert off(r for r in got if r[0] != "z") == want


def test_stateless(spark):
    df = spark.createDataFrame([(5, 10), (2_000_000, 10)], "t long, e long")
    assert S.without_stale(df, time_us=F.col("t"), elapsed_us=F.col("e")).count() == 1
    n = spark.createDataFrame([("a", k) for k in range(250)], "rig string, n long")
    assert {tuple(r) for r in S.batch_profile(n, key="rig", number="n").collect()} == {("a", 0, 100, 0, 99), ("a", 1, 100, 100, 199), ("a", 2, 50, 200, 249)}
    seen, bad = [], []
    S.each_sample(lambda r: seen.append(10 / (r["n"] - 3)), bad.append)(n.limit(5), 0)
    assert len(seen) == 4 and len(bad) == 1
    p = S.packets(n.limit(1), header=["rig"], number="n", rig=F.lit("x")).first()
    assert '"rig":"a"' in p["value"] and p["key"] == "0"
