"""Leaks against brute force, the two candidate searches against each other, and the edge cases."""

import random

import numpy as np
import pytest

from rillframe.llm import normal
from rillframe.llm.leaks import Index, Leak, align_all, canonical, find_leaks, hashed, promising, stretches

WORDS = [f"w{k}ord" for k in range(400)]
HAN = [chr(0x4E00 + k) for k in range(600)]
DOC, ITEM = "doc_id long, text string, score int, __item int", "item_id long, text string, doc_id string"


def run(spark, docs, items, **kw):
    a = spark.createDataFrame([(*r, 1, 2) for r in docs], DOC)
    b = spark.createDataFrame([(*r, "x") for r in items], ITEM)
    out = find_leaks(a, b, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", **kw)
    rows = [tuple(r)[:2] for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def make(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=60))) for k in range(8)] + [(k, "".join(rng.choices(HAN, k=90))) for k in range(8, 12)]
    docs, want = [], set()
    for d in range(60):
        body = rng.choices(WORDS, k=40)
        k = rng.randrange(12)
        text = items[k][1]
        units = text.split(" ") if k < 8 else list(text)
        short = 12 if k < 8 else 24
        kind = d % 4
        a = rng.randrange(0, 10)
        if kind == 0:
            piece, hit = units[a : a + (15 if k < 8 else 30)], True
        elif kind == 1:
            piece, hit = units[a : a + short], False
        elif kind == 2:
            piece, hit = [u if rng.random() > 0.06 else "zz" if k < 8 else "々" for u in units], True
        else:
            piece, hit = [], False
        joined = (" ".join if k < 8 else "".join)(piece)
        if kind == 0 and k < 8:
            joined = joined.upper().replace(" ", ",\n")
        docs.append((d, " ".join(body[:20]) + " " + joined + " " + " ".join(body[20:])))
        if hit:
            want.add((d, k))
    return docs, items, want


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, seed):
    docs, items, want = make(seed)
    docs += docs[:10] + [(900, None), (None, items[0][1]), (901, "")]
    items += items[:3] + [(99, None), (98, ""), (None, "x")]
    got = run(spark, docs, items)
    assert got == want
    assert run(spark, docs, items, max_held_seeds=10) == want


def test_letter_forms(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix old potions tonight"
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in item)
    hidden = "​".join(item)
    alike = item.replace("o", "о").replace("a", "а")
    docs = [(1, wide), (2, hidden), (3, alike), (4, item.replace(" ", " -- ")), (5, item[: item.index("wizards")])]
    assert run(spark, docs, [(7, item)]) == {(1, 7), (2, 7), (3, 7), (4, 7)}


def test_copies_of_an_item_stay_candidates(spark):
    text = " ".join(WORDS[:15])
    items = [(k, text) for k in range(20)]
    assert run(spark, [(1, "a b " + text + " c")], items) == {(1, k) for k in range(20)}


def both(spark, docs, items):
    """The rows by lookup and by joins, which must be the same."""
    held, joined = run(spark, docs, items), run(spark, docs, items, max_held_seeds=1)
    assert held == joined
    return held


def test_short_items_and_empty_tables(spark):
    docs = [(1, "x a b c y"), (2, "a x b c"), (3, "Yes, it did."), (4, "yesterday"), (5, "前に短い句があった")]
    assert both(spark, docs, [(1, "a b c"), (2, "yes"), (3, "短い句"), (4, "句短い"), (5, "!?")]) == {(1, 1), (3, 2), (5, 3)}
    thirteen = [(1, " ".join(WORDS[:13]))]
    assert both(spark, [(1, " ".join(["q", *WORDS[:13], "r"])), (2, " ".join(WORDS[:12])), (3, " ".join([*WORDS[:6], "q", *WORDS[6:13]]))], thirteen) == {(1, 1)}
    assert both(spark, [], [(1, " ".join(WORDS[:30]))]) == set()
    assert both(spark, [(1, " ".join(WORDS[:30]))], []) == set()


def test_ids_that_come_with_several_texts(spark):
    one, two = " ".join(WORDS[:20]), " ".join(WORDS[50:70])
    docs = [(1, one), (1, two), (1, "nothing"), (2, two), (2, two), (2, "")]
    items = [(1, "x y z"), (1, one), (2, two), (2, two), (2, None)]
    assert both(spark, docs, items) == {(1, 1), (1, 2), (2, 2)}


@pytest.mark.parametrize("seed", [5, 6])
def test_lookup_and_joins_agree(spark, seed):
    """Few words, repeated ids, copies and edits: whatever is found, both ways find it."""
    rng = random.Random(seed)
    few = WORDS[:25]
    items = [(rng.randrange(12), " ".join(rng.choices(few, k=rng.randrange(1, 40)))) for _ in range(20)]
    items += [(50 + k, "".join(rng.choices(HAN[:20], k=rng.randrange(1, 60)))) for k in range(6)]
    docs = []
    for _ in range(60):
        units = rng.choice(items)[1]
        units = units.split() if " " in units else list(units)
        for _ in range(rng.randrange(4)):
            units[rng.randrange(len(units))] = rng.choice([*few, "0"])
        docs.append((rng.randrange(30), (" " if rng.random() < 0.8 else "").join(["q", *units, *rng.choices(few, k=10)])))
    assert both(spark, docs, items)


def test_long_and_monotonous_texts(spark):
    docs = [(1, "a " * 50_000), (2, "句" * 20_000), (3, "a b " * 3)]
    assert both(spark, docs, [(1, "a " * 40), (2, "句" * 40), (3, "a b " * 8)]) == {(1, 1), (2, 2)}


@pytest.mark.parametrize(("kind", "scale"), [(0, 1), (1, 2)])
def test_recall_over_lengths_and_edits(kind, scale):
    """Passages of every length with up to three single units replaced, left out or put in, but for three in 15 to 17 words."""
    rng = random.Random(kind)
    units = [f"u{k}" for k in range(4000)] if kind == 0 else [chr(0x4E00 + k) for k in range(4000)]
    sep = "" if kind else " "
    items = [units[k * 100 : k * 100 + 100] for k in range(20)]
    index, m = Index(canonical([sep.join(i) for i in items]), Leak()), Leak()
    docs, want = [], set()
    for n in range(m.passage[kind], 41 * scale, scale):
        for edits in range(4):
            if n < edits * m.apart[kind]:
                continue
            for _ in range(6):
                k, at = rng.randrange(20), rng.randrange(100 - n)
                piece = items[k][at : at + n]
                for place in sorted(rng.sample(range(1, n - 1), edits), reverse=True):
                    piece[place : place + rng.choice([0, 1])] = rng.choice([[], [units[2100 + rng.randrange(1800)]]])
                want.add((len(docs), k))
                docs.append(sep.join([*units[3000:3020], *piece, *units[3100:3120]]))
    # A dozen in a row is none.
    docs += [sep.join([*units[3000:3020], *items[k][9 : 9 + 12 * scale], *units[3100:3120]]) for k in range(20)]
    found = {(t, i) for t, i, *_ in index.search(docs)}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_exact_runs_in_sql(spark):
    """Every exact run of 15 words that SQL finds is among the rows."""
    import duckdb

    docs, items, _ = make(3)
    items = [i for i in items if i[0] < 8]
    con = duckdb.connect()
    con.execute("create table d(doc_id bigint, text varchar)")
    con.execute("create table i(item_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", docs)
    con.executemany("insert into i values (?, ?)", items)
    units = "select {0}, list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k+14], ' ')) as g from (select {0}, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {1})"
    rows = con.execute(f"select distinct doc_id, item_id from (select doc_id, unnest(g) as g from ({units.format('doc_id', 'd')})) join (select item_id, unnest(g) as g from ({units.format('item_id', 'i')})) using (g)").fetchall()
    assert rows and set(rows) <= both(spark, docs, items)


def test_far_inside_a_long_text(spark):
    rng = random.Random(4)
    passage = WORDS[100:120]
    text = " ".join(rng.choices(WORDS[200:], k=30_000) + passage + rng.choices(WORDS[200:], k=30_000))
    assert run(spark, [(1, text)], [(5, " ".join(passage))]) == {(1, 5)}


def full_alignment(a, b):
    n, m = len(a), len(b)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    r = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if same else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
            r[i][j] = r[i - 1][j - 1] + 1 if same else 0
    return max(map(max, h)), max(map(max, r))


def test_alignment():
    rng = random.Random(9)
    pairs = [(rng.choices("abcd", k=rng.randrange(1, 25)), rng.choices("abcd", k=rng.randrange(0, 200))) for _ in range(300)]
    scores, runs = align_all([hashed(a) for a, _ in pairs], [hashed(b) for _, b in pairs])
    assert list(zip(scores, runs)) == [full_alignment(a, b) for a, b in pairs]


@pytest.mark.parametrize("kind", [0, 1])
def test_bounds_drop_nothing_that_passes(kind):
    rng, m = random.Random(kind), Leak()
    cases = []
    for _ in range(400):
        a = [f"u{rng.randrange(30)}" for _ in range(rng.randrange(2, 90))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            place = rng.randrange(len(b) + 1)
            b[place : place + rng.choice([0, 1])] = rng.choice([[], ["x"], ["u3"]])
        cases.append((hashed(a), hashed(b)))
    items, texts = [a for a, _ in cases], [b for _, b in cases]
    may = promising(items, texts, kind, m)
    scores, runs = align_all(items, texts)
    none = [(a, np.zeros(len(a), bool), b, np.zeros(len(b), bool), np.zeros(len(b), bool), np.zeros(len(b), bool)) for a, b in cases]
    passes = (scores >= m.edited[kind]) | (runs >= m.passage[kind]) | stretches(none, kind, m)
    assert passes.any() and not (passes & ~may).any()


def test_normal_forms():
    assert normal.words("Straße, ÉCOLE­!") == ["strasse", "école"]
    assert normal.words_of(["Ａ b\x1eс", "", "raсe ок"]) == [["a", "b", "с"], [], ["race", "ок"]]
    assert normal.letters("録画、を 停止!") == list("録画を停止")
    assert normal.is_unspaced("録画を停止") and not normal.is_unspaced("stop 録") and not normal.is_unspaced("")
