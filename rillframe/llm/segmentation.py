"""Sentence units of texts in many languages, by cascading rule tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm import segment_rules as R
from rillframe.session import spread

LINE = re.compile("([^\r\n\x0b\x0c\x85  ]*)(\r\n|[\r\n\x0b\x0c\x85  ]|$)")
BROKEN = re.compile("[\r\n\x0b\x0c\x85  ]")
BULLET, NUMBERED = re.compile(R.BULLET), re.compile(R.NUMBERED)
CANDIDATE, PLAIN_CANDIDATE = regex.compile(R.CANDIDATE), re.compile(R.PLAIN_CANDIDATE)
ENDS = regex.compile(rf"[{R.TERMINAL}:：]{R.CLOSER}*\s*$")
QUOTATION = re.compile("[“”„«»「」『』\"]")
UNSPACED = regex.compile(rf"[{R.UNSPACED}]")
CAPITAL = regex.compile(r"\p{Lu}")
TELLS: dict[str, tuple[str, ...]] = {w: tuple(lang for lang, ws in R.TELLING.items() if w in ws.split()) for ws in R.TELLING.values() for w in ws.split()}
ORDER = {lang: k for k, lang in enumerate(R.TABLES)}
ALPHABETIC = regex.compile(r"[\p{Latin}\p{Cyrillic}]")
SCRIPTS = tuple((lang, regex.compile(p)) for lang, p in R.SCRIPTS.items())
# Other names of the languages.
NAMES = {"jp": "ja", "cn": "zh", "deu": "de", "ger": "de", "spa": "es", "zho": "zh", "jpn": "ja", "hin": "hi", "tha": "th", "ara": "ar", "eng": "en", "fra": "fr", "fre": "fr", "ita": "it", "por": "pt", "rus": "ru"}


def language(name: str | None) -> str | None:
    """The language of a name: 'de' of 'de-DE', 'DE' or 'deu'; null if it has no table."""
    plain = (name or "").strip().lower().replace("_", "-").split("-")[0]
    plain = NAMES.get(plain, plain)
    return plain if plain in R.TABLES else None


def languages(block: str, named: str | None) -> tuple[str, ...]:
    """The languages whose tables a paragraph needs: the document's, then those that its words and letters tell.

    A document may change its language anywhere. Where no word tells one, all tables of its alphabet are asked.
    """
    told = set()
    for word in TELLS.keys() & set(block.lower().split()):
        told.update(TELLS[word] if len(TELLS[word]) == 1 else ())
    if not block.isascii():
        told.update(lang for lang, letters in SCRIPTS if letters.search(block))
    if named:
        told.add(named)
    if not told & R.TELLING.keys() and ALPHABETIC.search(block):
        told.update(R.TELLING)
    return tuple(sorted(told, key=lambda lang: (lang != named, ORDER[lang])))


@lru_cache(maxsize=None)
def table(name: str) -> tuple[regex.Pattern, tuple[bool, ...]]:
    """The rules of a table as one pattern with a group for each, and what each does."""
    common = {"first": R.COMMON_FIRST, "last": R.COMMON_LAST, "caseless": (R.CASELESS,)}
    rules = common[name] if name in common else R.TABLES[name]
    return regex.compile("|".join(f"((?<={r.before})(?={r.after}))" for r in rules) or "(?!)"), (False, *(r.breaks for r in rules))


@lru_cache(maxsize=4096)
def cascade(order: tuple[str, ...], caseless: bool) -> tuple[tuple[regex.Pattern, tuple[bool, ...]], ...]:
    """The tables in the order in which they are asked."""
    return tuple(table(name) for name in ("first", *(lang for lang in order if R.TABLES[lang]), "last", *(["caseless"] if caseless else [])))


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no unit crosses: between empty lines and from list mark to list mark."""
    start, last, number = -1, 0, None
    for m in LINE.finditer(text):
        a, b = m.span(1)
        if a == b or text[a:b].isspace():
            if start >= 0:
                yield start, last
            start, number = -1, None
        else:
            mark = _mark(text, a, b, start, last, number)
            if mark is not None:
                if start >= 0:
                    yield start, last
                start, number = mark
            elif start < 0:
                start = a
            last = b
        if m.end() >= len(text):
            break
    if start >= 0:
        yield start, last


def _mark(text: str, a: int, b: int, start: int, last: int, number: int | None) -> tuple[int, int | None] | None:
    """Where the item of a line begins, and its number, if the line has a list mark.

    A wrapped line may happen to begin with a number and a full stop, so a number is a mark only if it
    follows the one before, or is the first where nothing or a finished sentence stands before.
    """
    m = BULLET.match(text, a, b)
    if m:
        return m.end(), None
    m = NUMBERED.match(text, a, b)
    if not m:
        return None
    name = m["n"]
    if not name.isdecimal() and not ("a" <= name <= "z"):
        return None
    n = ord(name) - ord("a") + 1 if not name.isdecimal() else int(name)
    follows = number is not None and n == number + 1
    opens = start < 0 or (n in (0, 1) and ENDS.search(text, start, last) is not None)
    if not name.isdecimal() and not follows and n != 1:
        return None
    return (m.end(), n) if follows or opens else None


def quotations(block: str) -> tuple[str, list[tuple[int, int]], set[int]]:
    """The paragraph with every closing “ as ”, its quotations, and where a sentence runs on right after one.

    A quotation goes from an opening mark to the next mark of its kind, if that closes; its length doesn't matter.
    """
    found: list[tuple[int, int]] = []
    after: set[int] = set()
    closing: list[int] = []
    # The mark before, by kind: place and character.
    curly = angle = corner = white = straight = any_pair = (-1, "")
    for m in QUOTATION.finditer(block):
        at, c = m.start(), m[0]
        if c == '"':
            p = straight[0]
            if p >= 0 and (p == 0 or block[p - 1].isspace() or block[p - 1] in "(:：，,") and not block[p + 1].isspace():
                found.append((p, at))
            straight = (at, c)
            continue
        if c in "“”„":
            if curly[1] == "„" and c != "„":
                if c == "“":
                    closing.append(at)
                    c = "”"
                found.append((curly[0], at))
            elif curly[1] == "“" and c == "”":
                found.append((curly[0], at))
            curly = (at, c)
        elif c in "«»":
            if angle[1] == "«" and c == "»":
                found.append((angle[0], at))
            angle = (at, c)
        elif c in "「」":
            if corner[1] == "「" and c == "」":
                found.append((corner[0], at))
            corner = (at, c)
        else:
            if white[1] == "『" and c == "』":
                found.append((white[0], at))
            white = (at, c)
        if c in "“”「」『』":
            p, opening = any_pair
            if opening and opening in "“「『" and c in "”」』" and (p == 0 or not (block[p - 1].isalnum() or block[p - 1] in "：:，,")) and UNSPACED.match(block, at + 1):
                after.add(at + 1)
            any_pair = (at, c)
    if closing:
        letters = list(block)
        for at in closing:
            letters[at] = "”"
        block = "".join(letters)
    found.sort()
    return block, found, after


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit, in code points, the end exclusive; without space around."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    named = language(lang)
    for a, b in blocks(text) if BROKEN.search(text) or BULLET.match(text) or NUMBERED.match(text) else ((0, len(text)),):
        block = text[a:b]
        begin = 0
        for at in breaks(block, named):
            _add(out, block, begin, at, a)
            begin = at
        _add(out, block, begin, len(block), a)
    return out


def usual(block: str, mark: str, at: int) -> bool:
    """Whether a position is parted by the last table, no rule of the others being about what stands there.

    So it is where a capital follows, after a question or exclamation mark and after a word in small letters
    that is no abbreviation of any table.
    """
    if not (at + 1 < len(block) and block[at].isspace() and "A" <= block[at + 1] <= "Z"):
        return False
    if mark != ".":
        return mark in ("?", "!")
    word = block[max(0, at - 24) : at - 1].rpartition(" ")[2]
    return len(word) > 1 and word.isalpha() and word.islower() and word not in R.ABBREVIATIONS


def breaks(block: str, named: str | None) -> Iterator[int]:
    """The positions at which a paragraph is parted."""
    plain = block.isascii()
    quoted: list[tuple[int, int]] = []
    after: set[int] = set()
    if QUOTATION.search(block):
        block, quoted, after = quotations(block)
    rules = None
    k, until, size, begin = 0, -1, len(block), 0
    for m in (PLAIN_CANDIDATE if plain else CANDIDATE).finditer(block):
        at = m.end()
        if at >= size or at <= begin:
            continue
        following = block[at]
        # After a mark that isn't one of a script's own no rule breaks before a small letter or a number.
        if (following.islower() or following.isdecimal()) and m[0].isascii():
            continue
        while k < len(quoted) and quoted[k][0] < at:
            until = max(until, quoted[k][1])
            k += 1
        if at <= until or at in after:
            continue
        if usual(block, m[0], at):
            yield at
            begin = at
            continue
        if rules is None:
            rules = cascade(languages(block, named), CAPITAL.search(block) is None)
        for pattern, does in rules:
            rule = pattern.match(block, at)
            if rule is not None:
                if does[rule.lastindex]:
                    yield at
                    begin = at
                break


def _add(out: list[tuple[int, int]], block: str, begin: int, end: int, offset: int) -> None:
    piece = block[begin:end]
    body = piece.strip()
    if body:
        lead = len(piece) - len(piece.lstrip())
        out.append((offset + begin + lead, offset + begin + lead + len(body)))


def sentence_units(df: DataFrame, *, doc_id: str, text: str, lang: str | None = None, unit: bool = True) -> DataFrame:
    """Columns: ``doc_id``, ``start``, ``end`` and, unless left out, ``unit`` (the text between them); one row per unit.

    * Null, empty or blank texts have no units. With a null or unknown language the words and letters of a
      paragraph tell whose tables are asked.
    * Rows are taken one by one: a repeated document comes out as often as it comes in, null ids too.
    * Texts and quotations are taken whole, whatever their length; rows are independent, so nothing is shuffled.
    * Empty tables give no rows; further columns are ignored.
    """
    speech = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"), speech.alias("__lang")).where(F.length("__text") > 0)

    # Positions come as one number each, the start in the upper half.
    @F.pandas_udf("array<long>")
    def spans(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([_packed(sentences(t, g)) for t, g in zip(texts, langs)], dtype=object)

    @F.pandas_udf("struct<at:array<long>,unit:array<string>>")
    def written(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        found = [sentences(t, g) for t, g in zip(texts, langs)]
        return pd.DataFrame({"at": [_packed(f) for f in found], "unit": [[t[s:e] for s, e in f] for t, f in zip(texts, found)]})

    rows = spread(rows)
    if unit:
        pairs = rows.select("__id", written("__text", "__lang").alias("__u")).select("__id", F.arrays_zip("__u.at", "__u.unit").alias("__u"))
        rows = pairs.select("__id", F.explode_outer("__u").alias("__u")).select("__id", F.col("__u.at").alias("__at"), F.col("__u.unit").alias("unit"))
    else:
        rows = rows.select("__id", F.explode_outer(spans("__text", "__lang")).alias("__at"))
    at = F.col("__at")
    return rows.where(at.isNotNull()).select(F.col("__id").alias(doc_id), F.shiftright(at, 32).alias("start"), at.bitwiseAND((1 << 32) - 1).alias("end"), *(["unit"] if unit else []))


def _packed(spans: list[tuple[int, int]]) -> np.ndarray:
    pairs = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0] << 32 | pairs[:, 1]
