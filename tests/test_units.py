"""Conversions, and units found in text."""

import pytest
from pyspark.sql import functions as F

from rillframe.operators.units import LENGTH_NAMES, LENGTHS, SQUARE_NAMES, Edge, compositions, convert, parse_quantity, stated_in_text, unit_by_size
from rillframe.plans import problems


def test_compositions():
    table = {(s, t): (a, b) for s, t, a, b in compositions(LENGTHS)}
    assert table["in", "m"][0] == pytest.approx(0.0254)
    assert table["um", "in"][0] == pytest.approx(1 / 25400)
    temps = [Edge("c", "f", 1.8, 32.0), Edge("c", "k", 1.0, 273.15)]
    a, b = {(s, t): (a, b) for s, t, a, b in compositions(temps)}["f", "k"]
    assert a * 212 + b == pytest.approx(373.15)


def test_contradiction_and_zero():
    with pytest.raises(ValueError):
        compositions([*LENGTHS, Edge("in", "m", 0.0255)])
    with pytest.raises(ValueError):
        compositions([Edge("a", "b", 0.0)])


def test_convert_keeps_rows(spark):
    df = spark.createDataFrame([(1, 2.0, "in", "z"), (2, 3.0, None, "z"), (3, None, "mm", "z"), (4, 1.0, "parsec", "z"), (1, 2.0, "in", "z")], "id int, v double, u string, factor string")
    out = convert(df, value="v", unit="u", target="mm", out="mm", edges=LENGTHS)
    assert sorted((r["id"], r["mm"]) for r in out.collect() if r["mm"] is not None) == [(1, 50.8), (1, 50.8)]
    assert out.count() == 5 and out.columns == ["id", "v", "u", "factor", "mm"]
    arr = spark.createDataFrame([([1.0, None], "cm"), ([], "m"), (None, "m")], "v array<double>, u string")
    assert [r["o"] for r in convert(arr, value="v", unit="u", target="mm", out="o", edges=LENGTHS).collect()] == [[10.0, None], [], None]
    assert convert(df.limit(0), value="v", unit="u", target="mm", out="mm", edges=LENGTHS).count() == 0


CASES = [("48.7mm", 48.7, "mm"), ("5,5 centimetres", 5.5, "cm"), ('1 15/16"', 1.9375, "in"), ("15/16 inch", 0.9375, "in"), ("24925 µm", 24925.0, "um"), ("0.03000Meter", 0.03, "m"), ("54.8", 54.8, None), ("3厘米", 3.0, "cm"), ("about 3", None, None), ("", None, None), ("1/0 in", None, "in"), ("3e1mm", 30.0, "mm"), (None, None, None)]


def test_parse_quantity(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in CASES], "t string")
    number, unit = parse_quantity(F.col("t"), LENGTH_NAMES)
    assert [(r[0], r[1], r[2]) for r in df.select("t", number, unit).collect()] == CASES


NOTES = [
    ("t in cm, bench 75 cm high", "cm"), ("bench 75 cm high", None), ("screen 27 in, dimmed", None), ("tripod at 1.2 m; Verschiebung t in Feldern", "square"),
    ("offset between eyes, mm, from the bench sheet", "mm"), ("t está en pulgadas. lamp 2 m away", "in"), ("extrinsics exported as Zoll", "in"), ("t: in; tripod at 1.2 m", "in"),
    ("units of t are µm", "um"), ("T IN MM", "mm"), ("board lay on a 4 mm foam sheet", None), ("t is fine", None), ("", None), (None, None),
]


def test_stated(spark):
    df = spark.createDataFrame([(t,) for t, _ in NOTES], "t string")
    got = df.select(stated_in_text(F.col("t"), problems.ABOUT_T, {**LENGTH_NAMES, **SQUARE_NAMES}).alias("u")).collect()
    assert [(t, r["u"]) for (t, _), r in zip(NOTES, got)] == NOTES


def test_by_size(spark):
    df = spark.createDataFrame([(0.07,), (70.0,), (7.0,), (70000.0,), (2.6,), (500.0,), (None,)], "v double")
    got = [r[0] for r in df.select(unit_by_size(F.col("v"), 50.0, 90.0, "mm", problems.BY_SIZE, LENGTHS)).collect()]
    assert got == ["m", "mm", "cm", "um", "in", None, None]


ROWS = [
    (1, "x (t in board units)", [-0.07, 0.0, 0.0], 0.07, '{"board": {"square_mm": 30.0}}'),
    (2, "x (t in squares)", [-2.0, 0.0, None], None, '{"board": {"square_mm": "3.5 cm"}}'),
    (3, "x (t in board units)", [-7.0, 0.0, 0.0], 7.0, '{"board": {"squ'),
    (4, None, None, None, None),
    (5, "x (t in board units)", [-70.0, 1.0, 0.0], None, '{"translation_units": "mm", "board": {"square_mm": 2.4, "unit": "Zentimeter"}}'),
    (5, "x (t in board units)", [-70.0, 1.0, 0.0], None, '{"translation_units": "mm", "board": {"square_mm": 2.4, "unit": "Zentimeter"}}'),
    (6, "x (t in board units)", [], None, '{"board": {"square_mm": null}}'),
]


def test_calibrations(spark, tmp_path):
    spark.createDataFrame(ROWS, "calib_id long, convention string, t array<double>, baseline double, notes string").write.parquet(str(tmp_path / "calibrations.parquet"))
    got = {r["calib_id"]: r for r in problems.calibrations_in_common_units(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert got[2]["t_unit"] == "square" and got[2]["t_m"][0] == pytest.approx(-0.07) and got[2]["t_m"][2] is None
    assert got[5]["t_m"][0] == pytest.approx(-0.07) and got[5]["square_mm"] == pytest.approx(24)
    found = {tuple(r) for r in problems.p2_found(spark, str(tmp_path)).collect()}
    assert found == {(2, "t", "square"), (2, "square_mm", "cm"), (3, "t", "cm"), (5, "t", "mm"), (5, "square_mm", "cm")}


def test_units_of_the_record_itself(spark):
    df = spark.createDataFrame([(1, [2.0, None], "square", 30.0), (2, [2.0], "square", None), (3, [5.0], "m", 30.0), (4, [5.0], None, 30.0), (5, None, "square", 30.0)], "k int, t array<double>, u string, side double")
    out = convert(df, value="t", unit="u", target="m", out="t_m", edges=LENGTHS, own={"square": ("mm", F.col("side"))}, same="same")
    got = {r["k"]: (r["t_m"], r["same"]) for r in out.collect()}
    assert got == {1: ([0.06, None], False), 2: (None, None), 3: ([5.0], True), 4: (None, None), 5: (None, False)}
    assert out.columns == ["k", "t", "u", "side", "t_m", "same"]


def test_many_units():
    chain = [Edge(f"u{k}", f"u{k + 1}", 2.0) for k in range(150)]
    table = {(s, t): (a, b) for s, t, a, b in compositions(chain)}
    assert len(table) == 151**2 and table["u0", "u150"] == (2.0**150, 0.0)
