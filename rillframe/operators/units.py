"""Values in mixed units brought to common ones.

Conversions are edges of a graph, each an affine function. The shortest composition between every two
units is worked out once, every edge beyond the spanning trees is checked against it, and the table
of compositions, whose size is the square of the number of units, is joined to the rows by source
unit and target. A unit that only a record has, such as the side of its own board, is an edge with the
record's factor to a unit of the graph, composed with what leads on from there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many compositions are broadcast; a larger table is left to the optimizer.
HELD = 1_000_000


@dataclass(frozen=True)
class Edge:
    """``target = factor * source + offset``."""

    source: str
    target: str
    factor: float
    offset: float = 0.0


# Lengths.
LENGTHS = (
    Edge("cm", "mm", 10.0),
    Edge("m", "cm", 100.0),
    Edge("m", "mm", 1000.0),
    Edge("mm", "um", 1000.0),
    Edge("in", "mm", 25.4),
    Edge("in", "cm", 2.54),
)

# Names of units, in lower case.
LENGTH_NAMES: Mapping[str, Sequence[str]] = {
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters", "milímetro", "milímetros", "毫米", "ミリ", "ミリメートル"),
    "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter", "centímetro", "centímetros", "厘米", "センチ", "センチメートル"),
    "m": ("m", "metre", "metres", "meter", "meters", "metro", "metros", "米", "メートル"),
    "um": ("um", "µm", "μm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers", "mikrometer", "micrómetro", "micrómetros", "微米", "マイクロメートル"),
    "in": ("in", "inch", "inches", "zoll", "pulgada", "pulgadas", '"', "″", "英寸", "インチ"),
}
SQUARE_NAMES: Mapping[str, Sequence[str]] = {
    "square": ("square", "squares", "board square", "board squares", "square side", "square sides", "feld", "felder", "feldern", "casillas", "cuadros", "格", "方格", "マス"),
}


def compositions(edges: Iterable[Edge], tolerance: float = 1e-9) -> list[tuple[str, str, float, float]]:
    """(source, target, factor, offset) of the shortest composition between all connected units.

    Raises ValueError if an edge contradicts the composition of others beyond the relative
    ``tolerance``, or if a factor is 0.
    """
    steps: dict[str, list[tuple[str, float, float]]] = {}
    edges = list(edges)
    for e in edges:
        if e.factor == 0:
            raise ValueError(f"{e.source} to {e.target} can't be inverted")
        steps.setdefault(e.source, []).append((e.target, e.factor, e.offset))
        steps.setdefault(e.target, []).append((e.source, 1 / e.factor, -e.offset / e.factor))
    table: dict[tuple[str, str], tuple[float, float]] = {}
    for unit in sorted(steps):
        table[unit, unit] = (1.0, 0.0)
        queue = deque([unit])
        while queue:
            at = queue.popleft()
            a, b = table[unit, at]
            for to, f, o in steps[at]:
                if (unit, to) not in table:
                    table[unit, to] = (f * a, f * b + o)
                    queue.append(to)
    for e in edges:
        for unit in steps:
            if (unit, e.source) in table:
                a, b = table[unit, e.source]
                want, got = (e.factor * a, e.factor * b + e.offset), table[unit, e.target]
                if any(abs(x - y) > tolerance * max(1.0, abs(x), abs(y)) for x, y in zip(want, got)):
                    raise ValueError(f"{e.source} to {e.target} contradicts the other conversions")
    return [(s, t, a, b) for (s, t), (a, b) in sorted(table.items())]


def conversion_table(spark: SparkSession, edges: Iterable[Edge]) -> DataFrame:
    """The compositions as a table."""
    rows = compositions(edges)
    table = spark.createDataFrame(rows, "__source string, __target string, __factor double, __offset double")
    return F.broadcast(table) if len(rows) <= HELD else table


def convert(df: DataFrame, *, value: str, unit: str, target: Column | str, out: str, edges: Iterable[Edge], own: Mapping[str, tuple[str, Column]] | None = None, same: str | None = None) -> DataFrame:
    """``df`` with the column ``out``: ``value``, a number or an array of numbers, in unit ``target``.

    ``own`` names units of the record itself: each an edge to a unit of the graph, with a factor of the record.
    ``same``: a further column that tells whether the conversion changes nothing; null if there is none.

    * Null where value or unit is null or no composition leads from the unit to the target, which a null
      factor of the record doesn't either; null elements of an array stay null.
    * Rows are kept one for one, in whatever order; columns of ``df`` keep their names.
    """
    goal = F.lit(target) if isinstance(target, str) else target
    anchor, factor = F.col(unit), F.lit(1.0)
    for name, (to, by) in (own or {}).items():
        anchor = F.when(F.col(unit) == name, F.lit(to)).otherwise(anchor)
        factor = F.when(F.col(unit) == name, by.cast("double")).otherwise(factor)
    rows = df.withColumns({"__u": anchor, "__own": factor, "__goal": goal})
    table = conversion_table(df.sparkSession, edges)
    joined = rows.join(table, (F.col("__u") == F.col("__source")) & (F.col("__goal") == F.col("__target")), "left")
    array = dict(df.dtypes)[value].startswith("array")
    x, known = F.col(value), F.col("__factor").isNotNull() & F.col("__own").isNotNull()
    y = F.when(known, F.transform(x, lambda v: v * F.col("__own") * F.col("__factor") + F.col("__offset"))) if array else x * F.col("__own") * F.col("__factor") + F.col("__offset")
    joined = joined.withColumn(out, y)
    if same:
        joined = joined.withColumn(same, (F.col("__own") * F.col("__factor") == 1.0) & (F.col("__offset") == 0.0))
    return joined.drop("__u", "__own", "__goal", "__source", "__target", "__factor", "__offset")


def name_pattern(names: Mapping[str, Sequence[str]]) -> str:
    """A regular expression for any of the names, longest first."""
    flat = sorted((n for group in names.values() for n in group), key=lambda n: (-len(n), n))
    return "(?:" + "|".join(n.replace(".", "\\.") for n in flat) + ")"


def unit_of_name(name: Column, names: Mapping[str, Sequence[str]]) -> Column:
    """The unit a name stands for, in any case and with any space around; null if none."""
    plain = F.trim(F.lower(name))
    out = F.lit(None).cast("string")
    for unit, group in names.items():
        out = F.when(plain.isin(*group), F.lit(unit)).otherwise(out)
    return out


def stated_in_text(text: Column, subject: str, names: Mapping[str, Sequence[str]]) -> Column:
    """The unit which a clause of ``text`` about ``subject`` (a regular expression) ends with; null if none.

    A clause ends at a comma, full stop, semicolon or the end, and may hold no digit between subject and
    unit, so that '75 cm high' is never taken for a unit of something else.
    """
    pattern = f"(?iu)(?:{subject})[^.;,\\d]*?(?<!\\p{{L}})({name_pattern(names)})(?=\\s*(?:$|[,.;]))"
    return unit_of_name(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), names)


def parse_quantity(text: Column, names: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """Number and unit of texts like '5,5 cm', '1 15/16"' or '30'; null number if it isn't one, null unit if none."""
    pattern = name_pattern(names)
    mixed = f"(?iu)^\\s*(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)\\s*({pattern})?\\s*$"
    plain = f"(?iu)^\\s*([+-]?\\d+(?:[.,]\\d+)?(?:e[+-]?\\d+)?)\\s*({pattern})?\\s*$"
    whole, top, under = (F.regexp_extract(text, mixed, i) for i in (1, 2, 3))
    fraction = F.coalesce(whole.try_cast("double"), F.lit(0.0)) + F.try_divide(top.try_cast("double"), under.try_cast("double"))
    number = F.when(text.rlike(mixed), fraction).otherwise(F.replace(F.regexp_extract(text, plain, 1), F.lit(","), F.lit(".")).try_cast("double"))
    name = F.when(text.rlike(mixed), F.regexp_extract(text, mixed, 4)).otherwise(F.regexp_extract(text, plain, 2))
    return number, unit_of_name(F.nullif(name, F.lit("")), names)


def unit_by_size(value: Column, low: float, high: float, unit: str, candidates: Sequence[str], edges: Iterable[Edge]) -> Column:
    """The first of ``candidates`` in which ``value`` lies between ``low`` and ``high`` of ``unit``; null if none."""
    table = {(s, t): (a, b) for s, t, a, b in compositions(edges)}
    out = F.lit(None).cast("string")
    for c in reversed(candidates):
        a, b = table[c, unit]
        out = F.when((F.abs(value) * a + b).between(low, high), F.lit(c)).otherwise(out)
    return out
