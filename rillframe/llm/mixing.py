"""Mixing of sources to target shares of the total size.

Records get a hash; a source contributes its records below a hash threshold, whole rounds of all its
records before that. Thresholds are found without sorting: sizes are summed by source and hash bucket,
the bucket in which a budget runs out is refined by the next bits, and so on, each level summing only
the records of boundary buckets.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.session import ensure_checkpoint_dir, spread

#: A public tokenizer's file, a parameter wherever it is used: byte ranks (.tiktoken) or a whole tokenizer (.json).
TOKENIZER = os.environ.get("RILLFRAME_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how texts are parted before their bytes are merged, in the vocabularies that come as ranks.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS, LEVELS = 12, 5
#: So many sources are broadcast; each of more lies in so many groups.
HELD, SALTS = 100_000, 16


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[str], int]:
    """Counts the tokens of a text; a process loads each file once."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ranked = tiktoken.Encoding(path, pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(ranked.encode_to_numpy(text, disallowed_special=()))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of each text by a tokenizer file; null texts give null, special names are ordinary text."""

    @F.pandas_udf("long")
    def count(batch: pd.Series) -> pd.Series:
        tokens = _counter(tokenizer)
        return pd.Series([None if t is None else tokens(t) for t in batch], dtype="Int64")

    return count(text)


def one_spelling(name: Column) -> Column:
    """A source's name in lower case, trimmed, with one underscore for each run of space, hyphen or underscore."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"[\s\-_]+", "_"), F.lit(""))


@dataclass(frozen=True)
class Mix:
    """``selection``: doc id, ``source``, ``size``, ``repeats``. ``report``: what each source gives."""

    selection: DataFrame
    report: DataFrame


def mix_sources(df: DataFrame, targets: DataFrame, *, doc_id: str, source: str, size: Column, target_source: str = "source", share: str = "target_share", cap: str = "max_repeats", total: int | None = None, seed: int = 0) -> Mix:
    """Records of ``df`` so combined that each source of ``targets`` has its share of the total size.

    Without ``total`` it is the largest for which every source that has records reaches its share within
    its cap. With a larger total a source that can't give its share gives all it may. The shares of
    sources without records fall to the others in proportion.

    * Source names are compared by ``one_spelling``. Records of other sources, with a null source, id or
      size, or of no size, aren't used; repeated rows of an id count once (the largest size holds).
    * A source never exceeds its budget, and falls short of it by less than one record.
    * Targets with a null or non-positive share or cap give nothing; a source named twice adds its shares.
    * The selection names each record once, with ``repeats``; empty tables give empty results.
    * Whether a record is in depends on its id and ``seed`` only, so a larger total keeps what was in.
    * There may be any number of sources; only totals over all of them reach the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    goals = targets.select(one_spelling(F.col(target_source)).alias("source"), F.col(share).cast("double").alias("share"), F.col(cap).cast("int").alias("cap")).where("source is not null and share > 0 and cap > 0")
    goals = goals.groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).checkpoint()

    rows = spread(df).select(F.col(doc_id).alias("__id"), one_spelling(F.col(source)).alias("__src"), size.cast("long").alias("__size")).where("__id is not null")
    rows = join_by_source(rows, goals.select(F.col("source").alias("__src"))).where("__size > 0")
    rows = rows.groupBy("__id").agg(F.max(F.struct("__size", "__src")).alias("__best")).select("__id", "__best.__src", "__best.__size")
    rows = rows.withColumn("__h", hash_of(F.col("__id"), seed))
    # Sizes are costly to make and read several times: a narrow table of them is kept.
    rows = rows.checkpoint()

    have = rows.groupBy("__src").agg(F.sum("__size").alias("have"))
    plan = goals.join(have, F.col("source") == F.col("__src")).select("__src", "share", "cap", "have").checkpoint()
    shares = plan.agg(F.sum("share")).first()[0] or 1.0
    part = F.col("share") / F.lit(shares)
    if total is None:
        total = plan.agg(F.floor(F.min(F.col("cap") * F.col("have") / part) + 1e-6)).first()[0] or 0
    plan = plan.withColumn("budget", F.least(F.floor(F.lit(float(total)) * part + 1e-6), F.col("cap") * F.col("have")))
    plan = plan.withColumn("whole", F.call_function("div", F.col("budget"), F.col("have")))
    limits = _thresholds(rows, plan.select("__src", F.lit(0).cast("long").alias("__prefix"), (F.col("budget") - F.col("whole") * F.col("have")).alias("__rest")))
    plan = plan.join(limits, "__src", "left").withColumn("limit", F.coalesce("__limit", F.lit(0))).checkpoint()

    chosen = join_by_source(rows, plan.select("__src", "whole", "limit")).withColumn("repeats", (F.col("whole") + (F.col("__h") < F.col("limit")).cast("long")).cast("int")).where("repeats > 0")
    selection = chosen.select(F.col("__id").alias(doc_id), F.col("__src").alias("source"), F.col("__size").alias("size"), "repeats")

    given = chosen.groupBy("__src").agg(F.sum(F.col("__size") * F.col("repeats")).alias("__given"), F.max("repeats").alias("__most"))
    used = F.coalesce("__given", F.lit(0))
    report = goals.join(plan.select("__src", "have", "budget").join(given, "__src", "left"), F.col("source") == F.col("__src"), "left")
    report = report.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("have", F.lit(0)).alias("available"), F.coalesce("budget", F.lit(0)).alias("budget"), used.alias("used"), F.coalesce("__most", F.lit(0)).alias("most_repeats"))
    everything = report.agg(F.sum("used").alias("__all"))
    # One row beside the report.
    report = report.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("used").cast("double"), F.col("__all").cast("double")), F.lit(0.0))).drop("__all")
    return Mix(selection, report)


def hash_of(key: Column, seed: int) -> Column:
    """BITS * LEVELS bits of a key, as a number; the same in any engine with MD5."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def join_by_source(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``few``, one row per source, by ``__src``.

    Up to HELD sources are broadcast. More are joined by shuffling, each source over SALTS groups, as one
    may have a third of all rows.
    """
    if few.limit(HELD + 1).count() <= HELD:
        return rows.join(F.broadcast(few), "__src")
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int")).join(salted, ["__src", "__salt"]).drop("__salt")


def _thresholds(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per source ``__limit``: the hash below which its records fill ``__rest``, without exceeding it."""
    found = []
    for level in range(LEVELS):
        state = state.where("__rest > 0").checkpoint()
        if state.isEmpty():
            break
        shift = BITS * (LEVELS - 1 - level)
        inside = join_by_source(rows, state).where(F.shiftright("__h", shift + BITS) == F.col("__prefix"))
        bucket = F.shiftright("__h", shift).bitwiseAND((1 << BITS) - 1)
        sums = inside.groupBy("__src", "__prefix", "__rest", bucket.alias("__b")).agg(F.sum("__size").alias("__sum"), F.count(F.lit(1)).alias("__n"))
        # At most 2^BITS rows per source.
        upto = sums.withColumn("__cum", F.sum("__sum").over(Window.partitionBy("__src").orderBy("__b")))
        edge = upto.where(F.col("__cum") > F.col("__rest")).groupBy("__src").agg(F.min(F.struct("__b", "__cum", "__sum", "__n", "__prefix", "__rest")).alias("e")).select("__src", "e.*")
        prefix = F.shiftleft("__prefix", BITS).bitwiseOR(F.col("__b"))
        left = F.col("__rest") - (F.col("__cum") - F.col("__sum"))
        edge = edge.select("__src", prefix.alias("__prefix"), left.alias("__rest"), "__n").checkpoint()
        found.append(edge.select("__src", F.shiftleft("__prefix", shift).alias("__limit")))
        state = edge.where("__n > 1").drop("__n")
    none = state.select("__src", F.lit(0).cast("long").alias("__limit"))
    # Each level refines: its limit is the highest yet.
    return reduce(DataFrame.unionByName, found, none).groupBy("__src").agg(F.max("__limit").alias("__limit"))


def repeat_rows(df: DataFrame, selection: DataFrame, doc_id: str) -> DataFrame:
    """The rows of ``df`` that are in a selection, each as often as it is to be used, with ``repetition`` from 0."""
    chosen = selection.select(F.col(doc_id), F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repetition"))
    return df.join(chosen, doc_id)
