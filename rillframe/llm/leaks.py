"""Evaluation texts inside training documents.

Runs of words (of letters, for scripts without spaces) of the evaluation items are seeds. Where a document
has enough seeds of an item close together, the stretch around them is aligned with the item by
Smith-Waterman, which sees through edits, by the longest exact run, and by the longest stretch in which a
few single units differ. Sentences made from one template differ in its slots: a difference counts as an
edit only if what the document has instead isn't what other items have there.

Units are 64-bit hashes in NumPy arrays; a batch of documents is searched at once, and the stretches
found in it are aligned side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm import normal
from rillframe.session import spread

#: Items with so many places together are looked up where the documents are read; more are joined by shuffling.
MAX_HELD_SEEDS = 2_000_000
#: Seeds that many items share are many documents' too: rows of a seed are spread over so many groups.
SALTS = 16
# Marks of absence, less than any hash: beyond an item, beyond a text, a unit no item has.
NO_ITEM, NO_TEXT, OTHER = 0, 1, 2
#: Cells that are aligned side by side.
CELLS = 1 << 16


@dataclass(frozen=True)
class Leak:
    """Parameters for items of words and, second, of letters.

    A document holds an item if an exact run has ``passage`` units, if an alignment that scores 1 for
    a match and -2 for a difference reaches ``edited``, or if a stretch of ``passage`` units of the item has
    at most ``most`` edits, one in every ``apart`` units, and exact runs of ``beside`` units around them (see
    ``stretches``). An item shorter than ``passage`` is held if all of it stands there in a row. All this
    within stretches that have seeds at ``least`` places of the item, none further from the one before than
    ``reach``; a short item has fewer.
    """

    gram: tuple[int, int] = (4, 7)
    passage: tuple[int, int] = (15, 30)
    edited: tuple[int, int] = (18, 40)
    most: tuple[int, int] = (4, 5)
    apart: tuple[int, int] = (6, 8)
    beside: tuple[int, int] = (2, 2)
    least: tuple[int, int] = (3, 2)
    frame: tuple[int, int] = (2, 3)
    block: int = 4096

    def edits(self, kind: int) -> int:
        """The most edits of a stretch; with so many units that more are allowed it reaches ``edited`` anyway."""
        return max(d for d in range(self.most[kind] + 1) if max(self.passage[kind], d * self.apart[kind]) - 3 * d < self.edited[kind] or d == 0)

    def worth(self, kind: int) -> int:
        """The least score an alignment with such a stretch has."""
        return min(max(self.passage[kind], d * self.apart[kind]) - 3 * d for d in range(self.edits(kind) + 1))

    def reach(self, kind: int) -> int:
        """How far an end of such a stretch can lie from its outermost seed, or two seeds from each other."""
        return (self.edits(kind) + 1) * self.gram[kind] + self.edits(kind)

    def needed(self, kind: int, size: int) -> int:
        """The places with a seed that an item of ``size`` units needs; one that must stand in a row needs all."""
        places = max(1, size - self.gram[kind] + 1)
        return places if size < self.passage[kind] else min(places, self.least[kind])


def canonical(texts: Sequence[str]) -> list[tuple[int, str]]:
    """Of each item its kind (0 words, 1 letters) and its units in one form, which is the same for all copies."""
    forms = normal.one_forms(texts)
    kinds = [int(normal.is_unspaced(t)) for t in texts]
    return [(k, f.replace(" ", "") if k else " ".join(f.split())) for k, f in zip(kinds, forms)]


def hashed(units: Iterable[str]) -> np.ndarray:
    return np.fromiter((normal.unit_hash(u) for u in units), dtype=np.uint64)


def without_numbers(units: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The units with one unit for all numbers, as slots are told by."""
    return np.where(number, np.uint64(normal.unit_hash("0")), units)


class Index:
    """Items by their seeds. ``known`` are the frames of all items, if there are more than these."""

    def __init__(self, items: Sequence[tuple[int, str]], m: Leak, known: np.ndarray | None = None):
        self.m = m
        self.kind = np.array([k for k, _ in items], dtype=np.int8)
        split = [list(f) if k else f.split() for k, f in items]
        self.units = [hashed(u) for u in split]
        self.number = [np.array([w.isdecimal() for w in u], dtype=bool) for u in split]
        self.code = {w: normal.unit_hash(w) for u in split for w in u}
        self.least = np.array([m.needed(k, len(u)) for k, u in zip(self.kind, self.units)], dtype=np.int64)
        self.tables = tuple(self._tables(kind) for kind in (0, 1))
        # With items elsewhere, units these don't have may be in frames all the same.
        self.others = known is not None
        if known is None:
            known = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *(self.frames(k) for k in range(len(items)))]))
        self.known = known

    def frames(self, item: int) -> np.ndarray:
        """The short runs of an item by which slots are told."""
        return normal.run_hashes(without_numbers(self.units[item], self.number[item]), self.m.frame[self.kind[item]])

    def grams(self, item: int) -> np.ndarray:
        """The seeds of an item by place; an item shorter than a seed is one of its own length."""
        return normal.run_hashes(self.units[item], max(1, min(self.m.gram[self.kind[item]], len(self.units[item]))))

    def _tables(self, kind: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of seed: a filter, the distinct seeds, where their entries begin, and the entries: item, places, first, last."""
        by_length: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k in np.flatnonzero(self.kind == kind):
            if len(self.units[k]):
                found, first, times = np.unique(grams := self.grams(k), return_index=True, return_counts=True)
                last = len(grams) - 1 - np.unique(grams[::-1], return_index=True)[1]
                by_length.setdefault(max(1, min(self.m.gram[kind], len(self.units[k]))), []).append((found, np.full(len(found), k), times, first, last))
        out = []
        for length, parts in sorted(by_length.items()):
            gram, *entries = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(gram, kind="stable")
            distinct, start = np.unique(gram[order], return_index=True)
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[distinct >> np.uint64(44)] = True
            out.append((length, maybe, distinct, np.append(start, len(gram)), np.stack([e[order] for e in entries])))
        return out

    def hits(self, kind: int, units: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Rows: place in ``units``, seed, item, places of the seed in the item, the first and the last of them."""
        out, base = [np.empty((6, 0), dtype=np.int64)], 0
        for length, maybe, distinct, start, entries in self.tables[kind]:
            runs = normal.run_hashes(units, length)
            at = np.flatnonzero(maybe[runs >> np.uint64(44)] & (text_of[: len(runs)] == text_of[length - 1 :]))
            seed = np.minimum(np.searchsorted(distinct, runs[at]), len(distinct) - 1)
            same = distinct[seed] == runs[at]
            at, seed = at[same], seed[same]
            many = start[seed + 1] - start[seed]
            entry = np.repeat(start[seed] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out.append(np.stack([np.repeat(at, many), np.repeat(seed, many) + base, *entries[:, entry]]))
            base += len(distinct)
        return np.concatenate(out, axis=1)

    def stretches_with_seeds(self, kind: int, units: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Rows: text, item, first and last place in ``units``, first and last place in the item, of each chain of seeds."""
        place, seed, item, times, first, last = self.hits(kind, units, text_of)
        if not len(place):
            return np.empty((0, 6), dtype=np.int64)
        text = text_of[place]
        order = np.lexsort((place, item, text))
        place, seed, item, times, first, last, text = (x[order] for x in (place, seed, item, times, first, last, text))
        new = np.ones(len(place), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.m.reach(kind))
        chain = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        # Places of the item that have a seed here: those of each distinct seed once.
        by_seed = np.lexsort((seed, chain))
        once = np.ones(len(place), dtype=bool)
        once[1:] = (chain[by_seed][1:] != chain[by_seed][:-1]) | (seed[by_seed][1:] != seed[by_seed][:-1])
        covered = np.bincount(chain[by_seed][once], weights=times[by_seed][once], minlength=len(begin))
        end = np.append(begin[1:], len(place)) - 1
        found = np.stack([text[begin], item[begin], place[begin], place[end], np.minimum.reduceat(first, begin), np.maximum.reduceat(last, begin)], axis=1)
        return found[covered >= self.least[item[begin]]]

    def search(self, texts: Sequence[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, score, run) of what the texts hold."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        lists = normal.words_of(texts)
        if self.tables[0]:
            flat = [w for ws in lists for w in ws]
            units = hashed(flat) if self.others else np.fromiter(map(self.code.get, flat, repeat(OTHER)), dtype=np.uint64, count=len(flat))
            self._judge(0, units, flat, np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]), out)
        if self.tables[1]:
            some = [(k, "".join(ws)) for k, ws in enumerate(lists) if normal.UNSPACED.search(texts[k])]
            whole = "".join(s for _, s in some)
            points, inverse = np.unique(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
            codes = np.array([normal.unit_hash(chr(p)) if self.others else self.code.get(chr(p), OTHER) for p in points], dtype=np.uint64)
            text_of = np.repeat(np.array([k for k, _ in some], dtype=np.int64), [len(s) for _, s in some])
            self._judge(1, codes[inverse], whole, text_of, out)
        return [(t, i, score, run) for (t, i), (score, run) in sorted(out.items())]

    def _judge(self, kind: int, units: np.ndarray, written: Sequence[str], text_of: np.ndarray, out: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds what is held to ``out``, with the highest score and the longest run of each text and item."""
        m, reach = self.m, self.m.reach(kind)
        bounds = np.searchsorted(text_of, np.arange(text_of[-1] + 2)) if len(text_of) else np.zeros(1, dtype=np.int64)
        cases = []
        for text, item, first, last, a, b in self.stretches_with_seeds(kind, units, text_of).tolist():
            gram = m.gram[kind]
            a, b = max(0, a - reach), min(len(self.units[item]), b + gram + reach)
            lo, hi = max(int(bounds[text]), first - reach), min(int(bounds[text + 1]), last + gram + reach)
            # Long stretches are taken in blocks that overlap by more than an alignment with a positive score spans.
            overlap = 3 * (b - a)
            step = max(m.block, 2 * overlap) - overlap
            cases += [(text, item, a, b, s, min(s + step + overlap, hi), lo, hi) for s in range(lo, max(lo + 1, hi - overlap), step)]
        items = [self.units[c[1]][c[2] : c[3]] for c in cases]
        cases = [cases[k] for k in np.flatnonzero(promising(items, [units[c[4] : c[5]] for c in cases], kind, m))]
        scores, runs = align_all([self.units[c[1]][c[2] : c[3]] for c in cases], [units[c[4] : c[5]] for c in cases])
        whole = np.array([min(m.passage[kind], len(self.units[c[1]])) for c in cases], dtype=np.int64)
        long = whole >= m.passage[kind]
        held = (runs >= whole) | (long & (scores >= m.edited[kind]))
        doubtful = np.flatnonzero(long & ~held & (scores >= m.worth(kind)))
        held[doubtful] = stretches([self._slots(kind, units, written, cases[k]) for k in doubtful], kind, m)
        for k in np.flatnonzero(held):
            key = cases[k][0], cases[k][1]
            score, run = out.get(key, (0, 0))
            out[key] = max(score, int(scores[k])), max(run, int(runs[k]))

    def _slots(self, kind: int, units: np.ndarray, written: Sequence[str], case: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """Of a case: units and numbers of the item and of the text, units told to fill a slot, and places closed."""
        _, item, a, b, s, e, lo, hi = case
        f = self.m.frame[kind]
        left, right = max(lo, s - f), min(hi, e + f)
        number = np.fromiter((u.isdecimal() for u in written[left:right]), dtype=bool, count=right - left)
        own = normal.run_hashes(without_numbers(units[left:right], number), f)
        at = np.searchsorted(self.known, own)
        held = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == own) if len(self.known) else np.zeros(len(own), dtype=bool)
        told, closed = np.zeros((2, right - left), dtype=bool)
        told[: len(held)] |= held
        told[f - 1 :] |= held
        for k in range(1, f):  # the frames that hold both a place and the next
            closed[k - 1 : k - 1 + len(held)] |= held
        cut = slice(s - left, e - left)
        return self.units[item][a:b], self.number[item][a:b], units[s:e], number[cut], told[cut], closed[cut]


def _counts(items: Sequence[np.ndarray], texts: Sequence[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item's runs of ``n`` units which the text has (in rows), how many of the first k, and how many runs there are."""
    sides = []
    for parts in (items, texts):
        lengths = np.array([len(u) for u in parts])
        of = np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)
        within = of[n - 1 :] == of[: len(of) - n + 1]
        runs = normal.run_hashes(np.concatenate(parts), n)[within] ^ of[n - 1 :][within] * np.uint64(0xD6E8FEB86659FD93)
        sides.append((runs, np.maximum(lengths - n + 1, 0)))
    (mine, length), theirs = sides[0], np.sort(np.append(sides[1][0], np.uint64(0)))
    inside = np.arange(max(1, length.max())) < length[:, None]
    found = np.zeros(inside.shape, dtype=np.int32)
    found[inside] = theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
    return found, np.concatenate([np.zeros((len(items), 1), dtype=np.int32), np.cumsum(found, axis=1, dtype=np.int32)], axis=1), length


def promising(items: Sequence[np.ndarray], texts: Sequence[np.ndarray], kind: int, m: Leak) -> np.ndarray:
    """Which pairs may pass: those that would if the text had its units and neighbours in whatever order suits best.

    Bounds from above, by the units and the pairs of neighbours of the item that the text has at all. An edit
    takes one unit and parts two pairs. So a stretch with d edits lacks at most d units and 2 d pairs, and an
    alignment's score less 1 is at most the number of pairs less half the number of those lacking in between.
    """
    out = np.zeros(len(items), dtype=bool)
    size = 1024
    for start in range(0, len(items), size):
        part = slice(start, start + size)
        _, units, length = _counts(items[part], texts[part], 1)
        pair, pairs, _ = _counts(items[part], texts[part], 2)
        may = (length < m.passage[kind]) & (units[:, -1] == length) & (pairs[:, -1] == length - 1)
        for d in range(m.edits(kind) + 1):
            n = max(m.passage[kind], d * m.apart[kind])
            if n < units.shape[1]:
                may |= ((units[:, n:] - units[:, :-n] >= n - d) & (pairs[:, n - 1 :] - pairs[:, : pairs.shape[1] - n + 1] >= n - 1 - 2 * d)).any(axis=1)
        twice = np.cumsum(np.where(pair > 0, 2, -1), axis=1, dtype=np.int32)
        low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((len(length), 1), dtype=np.int32), twice[:, :-1]], axis=1), axis=1), 0)
        out[part] = may | ((twice - low).max(axis=1) >= 2 * (m.edited[kind] - 1))
    return out


def _groups(rows: Sequence[np.ndarray], cols: Sequence[np.ndarray], layers: int = 1) -> Iterable[np.ndarray]:
    """Cases of like sizes, so many that they make up CELLS cells."""
    order = np.lexsort(([len(r) for r in rows], [len(c) for c in cols])) if len(rows) else np.empty(0, dtype=np.int64)
    start = 0
    while start < len(order):
        # Falling sizes: the first of a group is the widest.
        width = len(cols[order[len(order) - 1 - start]]) + 1
        n = max(1, CELLS // (width * layers))
        yield order[::-1][start : start + n]
        start += n


def _padded(parts: Sequence[np.ndarray], fill: int, dtype: type) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, dtype=dtype)
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def align_all(items: Sequence[np.ndarray], texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman scores (match 1, difference -2) of pairs of sequences and their longest exact runs."""
    best, longest = np.zeros((2, len(items)), dtype=np.int64)
    for group in _groups(items, texts):
        a, b = _padded([items[k] for k in group], NO_ITEM, np.uint64), _padded([texts[k] for k in group], NO_TEXT, np.uint64)
        n, width = b.shape
        small = np.int16 if width < 8192 else np.int32
        at = 2 * np.arange(1, width + 1, dtype=small)
        row, runs = np.zeros((2, n, width + 1), dtype=small)
        high, run = np.zeros((2, n, width), dtype=small)
        for k in range(a.shape[1]):
            same = b == a[:, k : k + 1]
            new = np.maximum(row[:, :-1] + np.where(same, small(1), small(-2)), row[:, 1:] - small(2))
            new = np.maximum.accumulate(new + at, axis=1) - at
            np.maximum(new, 0, out=row[:, 1:])
            runs[:, 1:] = (runs[:, :-1] + 1) * same
            np.maximum(high, row[:, 1:], out=high)
            np.maximum(run, runs[:, 1:], out=run)
        if width:
            best[group], longest[group] = high.max(axis=1), run.max(axis=1)
    return best, longest


def stretches(cases: Sequence[tuple[np.ndarray, ...]], kind: int, m: Leak) -> np.ndarray:
    """Whether ``passage`` units of the item stand in the text but for a few edits, for each case of ``_slots``.

    An edit is a unit replaced, left out or put in; edits side by side are counted each. It isn't an edit
    but another filling of a slot, which ends the stretch, if the text has a number for a number, or if a
    run of ``frame`` units that begins or ends with its unit is among the frames of all items (for a unit
    left out, if a run over the place is).
    """
    out = np.zeros(len(cases), dtype=bool)
    most, beside = m.edits(kind), m.beside[kind]
    enough = np.maximum(m.passage[kind], m.apart[kind] * np.arange(most + 1))[None, :, None]
    for group in _groups([c[0] for c in cases], [c[2] for c in cases], most + 1):
        a, a_number, b, number, told, closed = (_padded([cases[k][i] for k in group], fill, dtype) for i, (fill, dtype) in enumerate(((NO_ITEM, np.uint64), (0, bool), (NO_TEXT, np.uint64), (0, bool), (1, bool), (1, bool))))
        n, width = b.shape
        shape = (n, most + 1, width + 1)
        runs, put, left_out, renumbered = np.zeros((4, n, width + 1), dtype=np.int16)
        # By the number of edits: the longest stretch that ends in a match, and in an edit; 0 where there is none.
        match, edit = np.zeros((2, *shape), dtype=np.int16)
        put[:, 1:], left_out[:, 1:], renumbered[:, 1:] = ~told, ~closed, ~told & ~number
        found = np.zeros(n, dtype=bool)
        for k in range(a.shape[1]):
            same = np.zeros((n, width + 1), dtype=np.int16)
            same[:, 1:] = b == a[:, k : k + 1]
            replaced = np.where(a_number[:, k : k + 1], renumbered, put) * (1 - same)
            before = np.maximum(match * (runs >= beside)[:, None], edit)
            grown, changed = np.zeros((2, *shape), dtype=np.int16)
            grown[:, :, 1:] = (np.maximum(match[:, :, :-1], edit[:, :, :-1]) + 1) * same[:, None, 1:]
            runs[:, 1:] = (runs[:, :-1] + 1) * same[:, 1:]
            ends = grown * (runs >= beside)[:, None]
            found |= (ends >= enough).any(axis=(1, 2))
            longer = (before[:, :-1] + 1) * (before[:, :-1] > 0)
            changed[:, 1:, 1:] = longer[:, :, :-1] * replaced[:, None, 1:]
            np.maximum(changed[:, 1:], longer * left_out[:, None], out=changed[:, 1:])
            for d in range(1, most + 1):
                np.maximum(changed[:, d, 1:], np.maximum(ends[:, d - 1, :-1], changed[:, d - 1, :-1]) * put[:, 1:], out=changed[:, d, 1:])
            match, edit = grown, changed
        out[group] = found
    return out


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str, doc_text: str, item_id: str, item_text: str, model: Leak | None = None, max_held_seeds: int = MAX_HELD_SEEDS) -> DataFrame:
    """Columns: ``doc_id``, ``item_id``, ``score``, ``run``; one row per document and item it holds.

    * Null texts or ids, and texts without a word, match nothing. Texts are taken whole, also items
      shorter than a passage, which must stand in a row.
    * Repeated rows of either side give one row per pair. Where an id comes with several texts, each is
      looked for and the highest score and run hold. Copies of a document or item under other ids come out each.
    * Empty tables give no rows; further columns are ignored, whatever their names.
    * Items are held in memory on every executor if all have at most ``max_held_seeds`` places together, and
      joined by shuffling otherwise; the rows are the same.
    """
    m = model or Leak()
    docs = spread(documents.select(F.col(doc_id).alias("__doc"), F.col(doc_text).cast("string").alias("__text")).dropna())

    @F.pandas_udf("struct<kind:int,form:string>")
    def form_of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(canonical(text.tolist()), columns=["kind", "form"])

    named = items.select(F.col(item_id).alias("__item"), form_of(F.col(item_text).cast("string")).alias("__f"), F.col(item_text).isNotNull().alias("__told"))
    named = named.where("__told and __item is not null").select("__item", "__f.*").where(F.length("form") > 0).distinct()
    # Copies are looked for once.
    size = F.when(F.col("kind") == 1, F.length("form")).otherwise(F.size(F.split("form", " ")))
    places = named.agg(F.sum(size + 1)).first()[0] or 0
    found = _held(docs, named, m) if places <= max_held_seeds else _joined(docs, named, m)
    out = found.groupBy("__doc", "__item").agg(F.max("score").alias("score"), F.max("run").alias("run"))
    return out.select(F.col("__doc").alias(doc_id), F.col("__item").alias(item_id), "score", "run")


_INDEXES: dict[str, Index] = {}


def _index(name: str, shared: Broadcast, m: Leak) -> Index:
    """The index of broadcast items; a worker builds it once, whatever the number of its tasks."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(list(shared.value), m)
    return _INDEXES[name]


def _held(docs: DataFrame, named: DataFrame, m: Leak) -> DataFrame:
    """The items, of proven size, are broadcast; documents aren't moved."""
    rows = named.toPandas()
    names: dict[tuple[int, str], list] = {}
    for item, kind, form in zip(rows["__item"].tolist(), rows["kind"].tolist(), rows["form"].tolist()):
        names.setdefault((kind, form), []).append(item)
    shared = docs.sparkSession.sparkContext.broadcast(names)
    name = uuid.uuid4().hex

    @F.pandas_udf(f"array<struct<item:{dict(named.dtypes)['__item']},score:int,run:int>>")
    def held(text: pd.Series) -> pd.Series:
        index = _index(name, shared, m)
        ids, texts = list(shared.value.values()), text.tolist()
        out: list[list] = [[] for _ in texts]
        for part in normal.pieces(texts):
            for t, i, score, run in index.search(texts[part.start : part.stop]):
                out[part.start + t] += [(item, score, run) for item in ids[i]]
        return pd.Series(out, dtype=object)

    return docs.select("__doc", F.explode_outer(held("__text")).alias("__h")).where(F.col("__h").isNotNull()).select("__doc", F.col("__h.item").alias("__item"), "__h.score", "__h.run")


def _joined(docs: DataFrame, named: DataFrame, m: Leak) -> DataFrame:
    """Candidates by joins on seeds, however many there are; then each is searched like a batch of one text and one item."""
    forms = named.select("kind", "form").distinct()

    @F.pandas_udf("struct<grams:array<long>,frames:array<long>,least:int>")
    def seeds_of(kind: pd.Series, form: pd.Series) -> pd.DataFrame:
        index = [Index([case], m, np.empty(0, dtype=np.uint64)) for case in zip(kind, form)]
        return pd.DataFrame([(i.grams(0).view(np.int64), np.unique(i.frames(0)).view(np.int64), int(i.least[0])) for i in index], columns=["grams", "frames", "least"])

    parts = forms.withColumn("__s", seeds_of("kind", "form")).select("kind", "form", "__s.*")
    seeds = parts.select("kind", "form", "least", F.explode_outer("grams").alias("__gram")).groupBy("kind", "form", "least", "__gram").agg(F.count(F.lit(1)).alias("__times"))
    seeds = seeds.select("kind", F.md5("form").alias("__form"), "least", "__gram", "__times", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    known = parts.select(F.explode_outer("frames").alias("__run")).dropna().distinct()
    lengths = tuple(set(range(1, g + 1)) for g in m.gram)

    @F.pandas_udf("struct<grams:array<long>,frames:array<long>>")
    def runs_of(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ws in zip(text, normal.words_of(text.tolist())):
            grams, frames = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]
            for kind, units in ((0, ws), (1, list("".join(ws)) if normal.UNSPACED.search(t) else [])):
                own = hashed(units)
                grams += [normal.run_hashes(own, n) for n in lengths[kind]]
                frames.append(normal.run_hashes(without_numbers(own, np.array([u.isdecimal() for u in units], dtype=bool)), m.frame[kind]))
            rows.append((np.unique(np.concatenate(grams)).view(np.int64), np.unique(np.concatenate(frames)).view(np.int64)))
        return pd.DataFrame(rows, columns=["grams", "frames"])

    # A row of a document is told by its id and its text, of which only hashes are shuffled.
    row = [F.col("__doc"), F.md5("__text").alias("__row")]
    grams = docs.select(*row, F.explode_outer(runs_of("__text")["grams"]).alias("__gram")).dropna()
    grams = grams.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    hits = grams.distinct().join(seeds, ["__gram", "__salt"]).groupBy("__doc", "__row", "kind", "__form", "least").agg(F.sum("__times").alias("__n"))
    pairs = hits.where("__n >= least").select("__doc", "__row", "kind", "__form")
    texts = docs.select(*row, "__text").join(pairs.select("__doc", "__row").distinct(), ["__doc", "__row"], "left_semi").dropDuplicates(["__doc", "__row"])
    frames = texts.select("__doc", "__row", F.explode_outer(runs_of("__text")["frames"]).alias("__run"))
    told = frames.join(known, "__run").groupBy("__doc", "__row").agg(F.collect_set("__run").alias("__known"))
    cases = texts.join(told, ["__doc", "__row"], "left").join(pairs, ["__doc", "__row"]).join(forms.withColumn("__form", F.md5("form")), ["kind", "__form"])

    @F.pandas_udf("struct<score:int,run:int>")
    def judged(text: pd.Series, kind: pd.Series, form: pd.Series, frames: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, f, own in zip(text, kind, form, frames):
            known = np.sort(np.array([] if own is None else own, dtype=np.int64).view(np.uint64))
            found = Index([(int(k), f)], m, known).search([t])
            rows.append(found[0][2:] if found else (None, None))
        return pd.DataFrame(rows, columns=["score", "run"]).astype("Int32")

    scored = cases.select("__doc", "kind", "form", judged("__text", "kind", "form", "__known").alias("__a")).where(F.col("__a.score").isNotNull())
    return scored.join(named, ["kind", "form"]).select("__doc", "__item", "__a.score", "__a.run")
