"""Runs and phrases against sequential restatements."""

import random

import pytest

from rillframe.llm.phrases import Commands, Fillers, slips, with_command, within_one
from rillframe.llm.runs import collapse_runs

SCHEMA = "e string, id long, s long, t long, x string, n int, label int, __b string"


def run(spark, rows, gap, block):
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    out = collapse_runs(df, entity=["e"], start="s", end="t", event_id="id", label="x", max_gap=gap, block=block)
    return sorted((r["e"], r["start"], r["first_event"], r["label"] or "", r["n"], r["end"]) for r in out.collect())


def brute(rows, gap):
    seen = {}
    for e, i, s, t, x in rows:
        if None in (e, i, s):
            continue
        t = s if t is None else max(s, t)
        old = seen.get((e, s, i))
        seen[e, s, i] = (t, x) if old is None else (max(t, old[0]), min([v for v in (x, old[1]) if v is not None], default=None))
    out, cur = [], None
    for (e, s, i), (t, x) in sorted(seen.items()):
        if cur and cur[0] == e and cur[3] == x and s - cur[5] < gap:
            cur[4] += 1
            cur[5] = max(cur[5], t)
        else:
            cur = [e, s, i, x, 1, t]
            out.append(cur)
    return sorted((e, s, i, x or "", n, t) for e, s, i, x, n, t in out)


@pytest.mark.parametrize("block", [5, 60, 600_000_000])
def test_random(spark, block):
    rng = random.Random(block)
    rows = []
    for k in range(500):
        s = rng.randrange(0, 1500)
        rows.append((rng.choice(["a", "a", "b"]), k, s, rng.choice([s + rng.randrange(0, 12), s + 90, None, s - 4]), rng.choice(["u", "u", "v", None])))
    rows += rows[:50] + [(None, 1, 1, 1, "u"), ("a", None, 1, 1, "u"), ("a", 9, None, 1, "u")]
    assert run(spark, rows, 10, block) == brute(rows, 10)


def test_one_run_over_many_blocks(spark):
    rows = [("a", k, k * 5, k * 5 + 1, "u") for k in range(300)]
    assert run(spark, rows, 10, 20) == [("a", 0, 0, "u", 300, 1496)]


def test_long_event_reaches_over_blocks(spark):
    rows = [("a", 0, 0, 1000, "u"), ("a", 1, 500, 501, "u"), ("a", 2, 1005, 1006, "u"), ("a", 3, 1016, 1017, "u")]
    assert run(spark, rows, 10, 50) == brute(rows, 10)


def test_empty(spark):
    assert run(spark, [], 10, 50) == []


KNOWN = {"start capture": 1, "split here": 2, "corta aquí": 3, "录画": 4, "録画を停止": 5}


@pytest.mark.parametrize(
    ("phrase", "number"),
    [("start capture", 1), (" START  Capture!", 1), ("start-capture", 1), ("strat capture", 1), ("startcapture", 1), ("ok, start capture", 1), ("uh split here please", 2), ("spli there", 2), ("splitt here now", 2), ("corta aqui", 3), ("vale, corta aquí", 3), ("録画 を停止。", 5), ("はい、録画を停止", 5), ("録画を開始", None), ("stop it", None), ("", None), ("please", None), ("don't start capture", None)],
)
def test_phrases(phrase, number):
    assert Commands(KNOWN.items()).find(phrase) == number


def test_within_one():
    assert within_one("abc", "acb") and within_one("abc", "ab") and within_one("abc", "abxc") and within_one("abc", "axc")
    assert not within_one("abc", "cba") and not within_one("abc", "a") and not within_one("abcd", "badc")


def test_slips_meet():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randrange(1, 7)))
        b = "".join(rng.choices("abc", k=rng.randrange(1, 7)))
        assert not within_one(a, b) or slips(a) & slips(b)


def test_any_number_of_fillers():
    words = ["ok", "uh", "um", "so", "please"]
    for n in (1, 8, 70, 2000):
        phrase = " ".join([*(words[k % 5] for k in range(n)), "start capture", *(words[k % 5] for k in range(n))])
        assert Commands(KNOWN.items()).find(phrase) == 1
    assert Fillers(["a", "ab"]).forms("abxa") == {"abxa", "bxa", "xa", "abx", "bx", "x"}


@pytest.mark.parametrize("held", [10_000, 1])
def test_command_column(spark, held):
    commands = spark.createDataFrame([(1, "start capture", "z"), (2, None, "z"), (5, "Start, capture", "z"), (6, "split here", "q"), (7, "split hera", "q"), (8, "go", "q"), (9, "!", "q")], "command_id long, phrase string, known string")
    phrases = ["Start capture.", None, "x" * 100_000, "ok strat capture now", "split here", "split herx", "gp", "ok go", "", "start capture"]
    df = spark.createDataFrame([(k, p, "c") for k, p in enumerate(phrases)], "k long, phrase string, known string")
    got = {r["k"]: r["command"] for r in with_command(df, commands, phrase="phrase", into="command", held=held).collect()}
    assert [got[k] for k in range(len(phrases))] == [1, None, None, 1, 6, None, None, 8, None, 1]
    assert {r["command"] for r in with_command(df, commands.limit(0), phrase="phrase", into="command", held=held).collect()} == {None}
    assert with_command(df.limit(0), commands, phrase="phrase", into="command", held=held).count() == 0
