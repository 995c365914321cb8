"""The model against planted cases, across block borders, and the edge cases."""

import numpy as np
import pytest

from rillframe.operators.spikes import SpikeModel, flag_implausible, posteriors

SCHEMA = "src string, q long, x double, field string, flag int"


def run(spark, rows, model=None, bound=16.0):
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    return {(r["source"], r["seq"]): r["flag"] for r in flag_implausible(df, source="src", seq="q", bounds={"x": bound}, model=model).collect()}


def series(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    return np.sin(np.arange(n) / 40) + rng.normal(0, 0.02, n)


@pytest.mark.parametrize("block", [256, 8192])
def test_planted(spark, block):
    x = series()
    want = {}
    for k in (0, 255, 256, 700, 2999):
        x[k] += 1.5
        want[k] = "spike"
    x[1000:1002] -= 2.0
    want |= {1000: "spike", 1001: "spike"}
    x[1500:1503] += 2.0  # three in a row: not gone within two readings
    x[500:530] = x[500]
    want |= dict.fromkeys(range(501, 530), "stuck")
    x[770:779] = x[770]  # nine: too short
    x[2000] = 40.0
    x[2001] = np.inf
    want |= {2000: "range", 2001: "range"}
    x[2500:] += 3.0  # a lasting shift
    x[600] = np.nan
    rows = [("a", k, float(v)) for k, v in enumerate(x)] + [("a", 5000, None), (None, 1, 9.0), ("a", None, 9.0)]
    rows += rows[100:400]
    assert {k: v for (s, k), v in run(spark, rows, SpikeModel(block=block, halo=64)).items()} == want


def test_run_spans_nulls_and_blocks(spark):
    x = series(600, 1)
    x[250:262] = x[250]
    rows = [("a", k, float(v)) for k, v in enumerate(x)]
    rows[255] = ("a", 255, None)
    got = run(spark, rows, SpikeModel(block=256, halo=64))
    assert set(k for _, k in got) == set(range(251, 262)) - {255}


def test_spikes_that_look_stuck(spark):
    x = series(400, 7)
    x[100:103] = x[100]
    x[103] += 2
    x[200:202] = x[200] + 2  # two equal ones
    assert set(k for _, k in run(spark, [("a", k, float(v)) for k, v in enumerate(x)])) == {103, 200, 201}


def test_scatter_is_the_sources_own(spark):
    rng = np.random.default_rng(3)
    loud, quiet = rng.normal(0, 1.0, 500), rng.normal(0, 0.01, 500)
    loud[100] = 4.0
    quiet[100] = 0.5
    rows = [("loud", k, float(v)) for k, v in enumerate(loud)] + [("quiet", k, float(v)) for k, v in enumerate(quiet)]
    assert run(spark, rows) == {("quiet", 100): "spike"}


def test_clock(spark):
    t = (np.arange(400) * 25_000 + 7).astype(float)
    t[200:] += 900_000  # a pause
    t[0] = 9e8  # not yet reset
    t[50] += 80_000
    t[51] = t[51]
    t[120] = t[119]
    t[121] = t[119]
    rows = [("r", k, float(v)) for k, v in enumerate(t) if k != 77]
    m = SpikeModel(clock=True, longest_spike=None, shortest_run=2)
    assert set(k for _, k in run(spark, rows, m, bound=float("inf"))) == {0, 50, 120, 121}


def test_first_frame_before_a_pause_is_fine(spark):
    t = [0.0] + [1e6 + k * 25_000 for k in range(50)]
    m = SpikeModel(clock=True, longest_spike=None, shortest_run=2)
    assert run(spark, [("r", k, v) for k, v in enumerate(t)], m, bound=float("inf")) == {}


def test_clock_that_changes_its_rate(spark):
    m = {block: SpikeModel(clock=True, longest_spike=None, shortest_run=2, block=block) for block in (64, 512, 8192)}
    t = np.concatenate([np.arange(1200) * 25_000.0, 1200 * 25_000.0 + np.arange(1200) * 100_000.0, 1.5e8 + np.arange(300) * 25_000.0])
    clean = [("r", k, float(v)) for k, v in enumerate(t)]
    for model in m.values():
        assert run(spark, clean, model, bound=float("inf")) == {}
    t[300] += 70_000
    t[1500] += 250_000
    t[1700:1703] -= 5e6
    t[2600] = t[2599]
    rows = [("r", k * (3 if k > 900 else 1), float(v)) for k, v in enumerate(t)]
    got = [run(spark, rows, model, bound=float("inf")) for model in m.values()]
    assert got[0] == got[1] == got[2] and {q for _, q in got[0]} == {300, 4500, 5100, 5103, 5106, 7800}


def test_blocks_change_nothing(spark):
    """Holes wider than any halo, runs of nulls, changing rates of equal readings: the same flags and probabilities."""
    rng = np.random.default_rng(11)
    x = np.round(series(4000, 8), 2)
    x[rng.integers(0, 4000, 60)] += 3
    x[1000:1100] = np.nan
    x[2040:2056] = x[2040]
    x[3000:3500] = np.round(x[3000:3500], 1)
    q = np.arange(4000) + np.cumsum(rng.random(4000) < 0.01) * 500
    df = spark.createDataFrame([("s", int(a), float(v), "f", 1) for a, v in zip(q, x)], SCHEMA)
    found = [sorted(map(tuple, flag_implausible(df, source="src", seq="q", bounds={"x": 16.0}, model=SpikeModel(block=block)).collect())) for block in (64, 512, 8192)]
    assert len(found[0]) > 60 and found[0] == found[1] == found[2]


def test_small_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", 1, 2.0)]) == {}
    assert run(spark, [("a", 1, 99.0), ("a", 2, None)]) == {("a", 1): "range"}
    assert run(spark, [("a", k, 1.0) for k in range(12)]) == {("a", k): "stuck" for k in range(1, 12)}


def test_pieces_agree_with_one_pass():
    rng = np.random.default_rng(5)
    z = np.abs(rng.normal(0, 1, 1000))
    z[rng.integers(0, 1000, 30)] = 15
    eq = rng.random(1000) < 0.05
    eq[300:340] = True
    broken = np.zeros(1000, dtype=bool)
    broken[700] = True
    m = SpikeModel()
    assert np.allclose(posteriors(z, eq, broken, 0.05, m), posteriors(z, eq, broken, 0.05, m, chunk=2000), atol=1e-3)
