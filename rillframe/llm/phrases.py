"""Which known command a phrase stands for, however it was heard or spelled."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words around a command that change nothing.
FILLERS = (
    "ok", "okay", "uh", "um", "and", "so", "well", "please", "now", "hey",
    "äh", "ähm", "und", "bitte", "jetzt", "also",
    "eh", "vale", "y", "ya", "por favor", "ahora",
    "那么", "嗯", "请", "好",
    "えっと", "はい", "では", "ください",
)
#: So many commands are held in memory where phrases are read; more are joined by shuffling.
HELD_COMMANDS = 10_000
CACHE = 1 << 16


def squash(text: str) -> str:
    """Letters and digits only, in one case and letter form."""
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", unicodedata.normalize("NFKC", text).casefold())


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        swapped = i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
        return swapped or a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def slips(text: str) -> set[str]:
    """The text and all it can be with one letter less; texts one slip apart have one of these in common."""
    return {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}


class Fillers:
    """Takes filler words off either end of a squashed phrase, in all ways."""

    def __init__(self, fillers: Iterable[str] = FILLERS):
        self.fillers = sorted({squash(f) for f in fillers} - {""})

    def forms(self, text: str, longest: int | None = None) -> set[str]:
        """What is left, however many are taken off; of at most ``longest`` letters."""
        starts, ends = {0}, {len(text)}
        for k in range(len(text)):
            if k in starts:
                starts.update(k + len(f) for f in self.fillers if text.startswith(f, k))
        for k in range(len(text), 0, -1):
            if k in ends:
                ends.update(k - len(f) for f in self.fillers if text.endswith(f, 0, k))
        last = sorted(ends)
        longest = len(text) if longest is None else longest
        return {text[a:b] for a in starts for b in last[bisect_right(last, a) : bisect_right(last, a + longest)]}


class Commands:
    """Looks phrases up among commands: exactly, then without fillers, then with one slip of the pen."""

    def __init__(self, commands: Iterable[tuple[str, int]], fillers: Iterable[str] = FILLERS):
        self.known: dict[str, int] = {}
        for phrase, number in sorted(commands, key=lambda c: c[1]):
            self.known.setdefault(squash(phrase), number)
        self.known.pop("", None)
        self.near: dict[str, set[str]] = {}
        for known in self.known:
            if len(known) > 3:
                for form in slips(known):
                    self.near.setdefault(form, set()).add(known)
        self.longest = max(map(len, self.known), default=0) + 1
        self.fillers = Fillers(fillers)
        self.find = lru_cache(CACHE)(self._find)

    def _find(self, phrase: str) -> int | None:
        forms = self.fillers.forms(squash(phrase), self.longest)
        exact = {self.known[t] for t in forms if t in self.known}
        if exact:
            return min(exact)
        near = {self.known[known] for t in forms for s in slips(t) for known in self.near.get(s, ()) if within_one(t, known)}
        return near.pop() if len(near) == 1 else None


def with_command(df: DataFrame, commands: DataFrame, *, phrase: str, into: str, phrase_col: str = "phrase", id_col: str = "command_id", fillers: Iterable[str] = FILLERS, held: int = HELD_COMMANDS) -> DataFrame:
    """``df`` with the id of the command that ``phrase`` stands for in ``into``; null if none or several.

    * A phrase that is a command but for fillers stands for it (of several for the one with the least id); else one
      that is within one slip of the letters of a single command.
    * Null phrases give null. Commands without a phrase or id, or without a letter, are no commands; of commands
      that are written alike the least id holds. Empty tables give no rows, or nulls.
    * Up to ``held`` commands are held in memory, and each distinct phrase is looked up once per worker as long as
      it stays among the last CACHE ones. More commands are joined by their slips, with the same result.
    """
    known = commands.select(F.col(phrase_col).alias("__known"), F.col(id_col).cast("long").alias("__id")).dropna()
    few = known.limit(held + 1).collect()
    if len(few) > held:
        return _joined(df, known, phrase, into, tuple(fillers))
    rows = [(r["__known"], r["__id"]) for r in few]
    finder: list[Commands] = []

    @F.pandas_udf("long")
    def look_up(batch: pd.Series) -> pd.Series:
        if not finder:
            finder.append(Commands(rows, fillers))
        return pd.Series([None if p is None else finder[0].find(p) for p in batch], dtype="Int64")

    return df.withColumn(into, look_up(F.col(phrase)))


def _joined(df: DataFrame, known: DataFrame, phrase: str, into: str, fillers: tuple[str, ...]) -> DataFrame:
    squashed = F.pandas_udf(lambda batch: batch.map(squash), "string")
    variants = F.pandas_udf(lambda batch: batch.map(lambda t: sorted(slips(t)) if len(t) > 3 else [t]), "array<string>")
    same = F.pandas_udf(lambda a, b: pd.Series([within_one(x, y) for x, y in zip(a, b)]), "boolean")
    known = known.select(squashed("__known").alias("__known"), "__id").where("__known != ''").groupBy("__known").agg(F.min("__id").alias("__id"))
    longest = (known.agg(F.max(F.length("__known"))).first()[0] or 0) + 1

    @F.pandas_udf("array<string>")
    def forms(batch: pd.Series) -> pd.Series:
        tool = Fillers(fillers)
        return pd.Series([sorted(tool.forms(squash(p), longest)) for p in batch], dtype=object)

    every_slip = F.pandas_udf(lambda batch: batch.map(lambda t: sorted(slips(t))), "array<string>")
    phrases = df.select(F.col(phrase).alias("__phrase")).where("__phrase is not null").distinct()
    phrases = phrases.select("__phrase", F.explode_outer(forms("__phrase")).alias("__form")).where("__form is not null")
    phrases = phrases.select("__phrase", "__form", F.explode_outer(every_slip("__form")).alias("__slip"))
    met = phrases.join(known.select("__known", "__id", F.explode_outer(variants("__known")).alias("__slip")), "__slip").select("__phrase", "__form", "__known", "__id").distinct()
    exact = F.col("__form") == F.col("__known")
    met = met.where(exact | ((F.length("__known") > 3) & same("__form", "__known")))
    near = F.when(F.min("__id") == F.max("__id"), F.min("__id"))
    found = met.groupBy("__phrase").agg(F.coalesce(F.min(F.when(exact, F.col("__id"))), near).alias(into))
    return df.join(found, F.col(phrase) == F.col("__phrase"), "left").drop("__phrase")
