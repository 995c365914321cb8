"""Short passages with a few edits are leaks; other fillings of an item's template aren't."""

import random

from rillframe.llm.leaks import find_leaks

WORDS = [f"w{k}ord" for k in range(400)]
HAN = [chr(0x4E00 + k) for k in range(600)]


def run(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = find_leaks(a, b, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", **kw)
    return {tuple(r)[:2] for r in out.collect()}


def edited(units, at, kind, new):
    units = list(units)
    for k in reversed(at):
        units[k : k + (kind != "insert")] = [] if kind == "delete" else [new]
    return units


def test_short_edited_passages(spark):
    rng = random.Random(3)
    words, han = rng.choices(WORDS, k=60), rng.sample(HAN, 90)
    around, beside = rng.choices(WORDS, k=20), rng.choices(HAN, k=20)
    items = [(1, " ".join(words)), (2, "".join(han))]
    docs, want = [], set()
    for span, at in ((20, [9]), (15, [7]), (17, [4, 11]), (24, [5, 12, 17])):
        for kind in ("replace", "insert", "delete"):
            docs.append((len(docs), " ".join([*around, *edited(words[20 : 20 + span], at, kind, "zz"), *around])))
            want.add((len(docs) - 1, 1))
    for span, at in ((42, [21]), (30, [15]), (33, [10, 22]), (32, [7, 15, 23])):
        for kind in ("replace", "insert", "delete"):
            docs.append((len(docs), "".join([*beside, *edited(han[30 : 30 + span], at, kind, "々"), *beside])))
            want.add((len(docs) - 1, 2))
    # Too short, or with too many edits.
    docs += [(100, " ".join([*around, *words[20:32], "zz", *around])), (101, " ".join([*around, *edited(words[20:37], [4, 9, 13], "replace", "zz")]))]
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, max_held_seeds=10) == want


def test_edited_passages_of_copied_items(spark):
    """What many items share weighs next to nothing, and is aligned all the same."""
    words = random.Random(4).sample(WORDS, 30)
    docs = [(1, " ".join(edited(words, [5, 10, 15, 20], "replace", "zz")))]
    items = [(k, " ".join(words)) for k in range(12)]
    assert run(spark, docs, items) == run(spark, docs, items, max_held_seeds=1) == {(1, k) for k in range(12)}


def test_other_fillings_of_a_template(spark):
    rng = random.Random(6)
    names, places = [f"name{k}" for k in range(12)], [f"place{k}" for k in range(12)]

    def sentence(n):
        return f"explain to the {rng.choice(names)} why {n} of all votes taken near the {rng.choice(places)} vanish in the long night"

    items = [(k, sentence(k)) for k in range(60)]
    docs = [(k, "heard today " + sentence(1000 + k) + " and so on") for k in range(40)]
    assert run(spark, docs, items) == run(spark, docs, items, max_held_seeds=10) == set()
