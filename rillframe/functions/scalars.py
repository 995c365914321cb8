"""Scalar expressions on times, text, weights and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def us_half_up(seconds: Column) -> Column:
    """Microseconds of decimal seconds, halves away from zero."""
    return F.round(seconds.cast("decimal(28,9)") * F.lit(1_000_000), 0).cast("long")


def us_half_even(seconds: Column) -> Column:
    """Microseconds of seconds, halves to even."""
    return F.rint(seconds * 1e6).cast("long")


def us_truncated(seconds: Column) -> Column:
    """Microseconds of seconds, cut towards zero."""
    return (seconds * 1e6).cast("long")


def us_floored(seconds: Column) -> Column:
    """Microseconds of seconds, rounded down."""
    return F.floor(seconds * 1e6)


def normalize_text(text: Column) -> Column:
    """Lower case letters and digits, single spaces between them, none around."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """The words of a normalised text; none of an empty one."""
    return F.filter(F.split(normalize_text(text), " "), lambda t: t != "")


def huber_weight(r: Column, h: float) -> Column:
    """Reweighting by Huber: 1 up to ``h``, then h / |r|."""
    return F.when(F.abs(r) <= h, F.lit(1.0)).otherwise(F.lit(float(h)) / F.abs(r))


def cauchy_weight(r: Column, c: float) -> Column:
    """Reweighting by Cauchy."""
    return 1 / (1 + (r / c) * (r / c))


def gravity_confidence(norm_g: Column, sigma: float) -> Column:
    """How far an acceleration's length in g speaks for rest: a Gaussian around 1."""
    d = (norm_g - 1) / sigma
    return F.exp(-0.5 * d * d)


def linear_taper(deviation: Column, most: float) -> Column:
    """1 at no deviation, falling to 0 at ``most``."""
    return F.greatest(F.lit(0.0), 1 - F.abs(deviation) / most)


def within_tolerance(got: Column, want: Column, absolute: float, relative: float = 0.1) -> Column:
    """Whether a value lies within the larger of two tolerances of what was asked for."""
    return F.abs(got - want) <= F.greatest(F.lit(float(absolute)), F.abs(want) * relative)


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first condition that isn't true; null if all are."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def map_difference(left: Column, right: Column) -> Column:
    """Entries of two maps that differ, as a map from the key to both values; a missing one is null."""
    both = F.map_zip_with(left, right, lambda _, a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.map_filter(both, lambda _, v: ~v["left"].eqNullSafe(v["right"]))


def remap(values: Column, order: list[int]) -> Column:
    """Elements of an array in another order; null where there is none."""
    return F.transform(F.array(*(F.lit(k + 1) for k in order)), lambda k: F.try_element_at(values, k))


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a struct's JSON; fields count in the order in which the struct has them."""
    return F.sha2(F.to_json(value), 256)


def selector(choice: Column, index: Column, name: Column) -> Column:
    """Rank of an entry for a choice: 0 by number, 1 by the whole name, 2 by a part of it; null if none."""
    want, have = F.lower(F.trim(choice)), F.lower(name)
    return F.when(want.rlike(r"^\d+$"), F.when(want.try_cast("int") == index, 0)).when(have == want, 1).when(F.contains(have, want), 2)


def host_time(perf_us: Column, pts_us: Column, clock: Column) -> Column:
    """A word's time on the host clock: its own, or where it has none its stream time if that counts from the same clock; else -1."""
    own = F.coalesce(perf_us, F.lit(-1).cast("long"))
    return F.when((own < 0) & F.coalesce(clock, F.lit(False)), F.coalesce(pts_us, F.lit(-1).cast("long"))).otherwise(own)
