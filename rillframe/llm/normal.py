"""Texts reduced to units that survive case, marks, spacing, line breaks and letter forms.

Texts are worked on many at a time: joined by a mark that stands for no letter, their code points are
looked up in a table of classes, so that hardly anything is done in Python per character.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import xxhash

UNIT, DROP = 1, 2
BETWEEN = "\x1e"
# Scripts written without spaces: Han, kana, Thai, Lao, Khmer, Myanmar.
UNSPACED = re.compile("[々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffffｦ-ﾟก-໿က-႟ក-៿]")
# Cyrillic and Greek letters that look like Latin ones, where they stand among Latin letters.
LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝвкмнтьαορνικτυχϲ", "aeopcyxijshdqwbkmhtbaopviktyxc")
ALIKE = re.compile("[Ͱ-ϿЀ-ԯ]")
LATIN = re.compile("[a-zß-ɏḀ-ỿ]")
PART = re.compile(r"\w+")
#: So many characters are worked on at a time.
PIECE = 1 << 22


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For every code point: UNIT (letter, mark or number), DROP (invisible), or 0."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.int8)
    for c in (*range(0x34000), *range(0xE0000, 0xE0200)):  # no letters elsewhere
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMN":
            table[c] = UNIT
        elif kind == "Cf":
            table[c] = DROP
    for first, last in ((0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)):  # variation selectors
        table[first : last + 1] = DROP
    return table


ASCII = "".join(chr(c).lower() if chr(c).isalnum() or chr(c) == BETWEEN else " " for c in range(128))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _one_form(text: str) -> str:
    """One case, one letter form, without invisible characters; all but units and BETWEEN is space."""
    if text.isascii():
        return text.translate(ASCII)
    points = _points(BETWEEN.join(unicodedata.normalize("NFKC", t) for t in text.split(BETWEEN)))
    text = _text(points[classes()[points] != DROP]).casefold()
    points = _points(BETWEEN.join(_one_alphabet(unicodedata.normalize("NFC", t)) for t in text.split(BETWEEN)))
    return _text(np.where((classes()[points] == UNIT) | (points == ord(BETWEEN)), points, np.uint32(32)))


def _one_alphabet(text: str) -> str:
    """Letters of other alphabets that stand among Latin ones become the Latin ones they look like."""
    if not ALIKE.search(text):
        return text
    return PART.sub(lambda m: m[0].translate(LOOKALIKE) if ALIKE.search(m[0]) and LATIN.search(m[0]) else m[0], text)


def one_forms(texts: Sequence[str]) -> list[str]:
    """``_one_form`` of each text; those in ASCII are worked on apart from the others."""
    out = [""] * len(texts)
    for plain in (True, False):
        at = [k for k, t in enumerate(texts) if t.isascii() == plain]
        if at:
            for k, t in zip(at, _one_form(BETWEEN.join(texts[k].replace(BETWEEN, " ") for k in at)).split(BETWEEN)):
                out[k] = t
    return out


def words_of(texts: Sequence[str]) -> list[list[str]]:
    """The words of each text, without marks."""
    return [t.split() for t in one_forms(texts)]


def words(text: str) -> list[str]:
    """Words without marks."""
    return words_of([text])[0]


def letters(text: str) -> list[str]:
    """Letters, vowel signs and digits without marks or space."""
    return list(one_forms([text])[0].replace(" ", ""))


def is_unspaced(text: str) -> bool:
    """Whether at least half of a text's letters belong to scripts written without spaces."""
    n = len(UNSPACED.findall(text))
    return n > 0 and 2 * n >= int((classes()[_points(text)] == UNIT).sum())


def pieces(texts: Sequence[str | None]) -> Iterator[range]:
    """Stretches of a batch with about PIECE characters each."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def unit_hash(unit: str) -> int:
    """64 bits of a unit; the least values are left free for marks of absence."""
    return max(xxhash.xxh3_64_intdigest(unit), 16)


def run_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """64 bits of each run of ``n`` unit hashes; the length is part of it."""
    if len(units) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(units) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out = (out ^ units[k : len(units) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
