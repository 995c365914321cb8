"""Mixes: budgets, caps, and what is chosen."""

import random

import pytest
from pyspark.sql import functions as F

from rillframe.llm import mixing
from rillframe.llm.mixing import TOKENIZER, mix_sources, one_spelling, repeat_rows, token_count

DOC, GOAL = "id long, src string, n long, source string, repeats int", "source string, target_share double, max_repeats int, n int"


def run(spark, docs, goals, **kw):
    d = spark.createDataFrame([(*r, "z", 9) for r in docs], DOC)
    g = spark.createDataFrame([(*r, 3) for r in goals], GOAL)
    mix = mix_sources(d, g, doc_id="id", source="src", size=F.col("n"), **kw)
    return {r["id"]: (r["source"], r["size"], r["repeats"]) for r in mix.selection.collect()}, {r["source"]: r.asDict() for r in mix.report.collect()}, (d, mix)


def make(seed=0):
    rng = random.Random(seed)
    spell = {"a": ["a", "A", " a "], "b-c": ["b-c", "b_c", "B  C"], "d": ["d"]}
    docs = []
    for k in range(3000):
        s = rng.choices(["a", "b-c", "d", "other", None], [60, 25, 5, 8, 2])[0]
        docs.append((k, rng.choice(spell.get(s, [s])), rng.choice([1, 50, 80, 300, 2000, 0, None])))
    return docs


def test_budgets_and_caps(spark):
    docs = make()
    goals = [("a", 0.5, 1), ("b_c", 0.3, 2), ("D", 0.15, 4), ("gone", 0.05, 9)]
    got, report, (d, mix) = run(spark, docs + docs[:100], goals)
    sizes = {k: n for k, _, n in docs}
    assert report["gone"]["used"] == 0 and report["gone"]["actual_share"] == 0
    for s, cap in (("a", 1), ("b_c", 2), ("d", 4)):
        used = sum(n * r for g, n, r in got.values() if g == s)
        mine = [r for g, _, r in got.values() if g == s]
        assert used == report[s]["used"] <= report[s]["budget"]
        assert report[s]["budget"] - used < 2000
        assert max(mine) <= cap == report[s]["max_repeats"] and max(mine) - min(mine) <= 1
    total = sum(r["used"] for r in report.values())
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    for s, share in (("a", 0.5), ("b_c", 0.3), ("d", 0.15)):
        assert abs(report[s]["used"] / total - share / 0.95) < 0.02
    assert all(sizes[k] == n for k, (_, n, _) in got.items())
    rows = repeat_rows(d.dropDuplicates(["id"]).drop("repeats"), mix.selection.select("id", "repeats"), "id")
    assert rows.count() == sum(r for _, _, r in got.values())


def test_larger_totals_keep_what_was_in(spark):
    docs, goals = make(1), [("a", 0.6, 1), ("b_c", 0.4, 3)]
    small, _, _ = run(spark, docs, goals, total=20_000)
    large, _, _ = run(spark, docs, goals, total=90_000)
    assert small and all(large.get(k, (0, 0, 0))[2] >= r for k, (_, _, r) in small.items())
    most, report, _ = run(spark, docs, goals, total=10**9)
    assert report["a"]["used"] == report["a"]["available"] and report["b_c"]["used"] == 3 * report["b_c"]["available"]


def test_edges(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == {}
    assert run(spark, [(1, "a", 5)], [])[0] == {}
    assert run(spark, [(1, "a", 5)], [("a", 1.0, 0), (None, 1.0, 1), ("a", None, 2)])[0] == {}
    assert run(spark, [(1, "a", 5), (None, "a", 5)], [("a", 1.0, 3)])[0] == {1: ("a", 5, 3)}
    assert run(spark, [(k, "a", 5) for k in range(10)], [("a", 1.0, 1)], total=12)[1]["a"]["used"] == 10


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("x " * 50_000,)], "t string")
    got = [r[0] for r in df.select(token_count(F.col("t"), TOKENIZER)).collect()]
    assert got[:3] == [2, 0, None] and got[3] > 1 and got[4] >= 50_000


def test_many_sources_are_joined_in_the_same_way(spark, monkeypatch):
    docs, goals = make(2), [("a", 0.5, 1), ("b_c", 0.3, 2), ("d", 0.2, 4)]
    held = run(spark, docs, goals)[:2]
    monkeypatch.setattr(mixing, "HELD", 1)
    assert run(spark, docs, goals)[:2] == held


@pytest.mark.parametrize("text", ["", "hello world", "a" * 5000, "句子很长" * 500, " " * 999 + "x", "<|endoftext|> Ａ\n\n", "!?" * 500])
def test_both_forms_of_a_tokenizer_agree(text):
    assert mixing._counter(TOKENIZER)(text) == mixing._counter(TOKENIZER.replace(".tiktoken", ".json"))(text)


@pytest.mark.parametrize(("name", "want"), [(" Lab-Wiki ", "lab_wiki"), ("LAB  WIKI", "lab_wiki"), ("", None), (None, None)])
def test_spelling(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(one_spelling(F.col("s"))).first()[0] == want
