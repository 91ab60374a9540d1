import ctypes
import math

from pyspark.sql import functions as F

from quern.functions import coords as C
from quern.functions import dates as D
from quern.functions import names as B
from quern.functions import numbers as N
from quern.functions import text as X

VALUES = [0, 1, -1, 7, -7, 100, 2**31 - 1, -(2**31), 123456789, -987654321, None]


def wrap(x):
    return ctypes.c_int32(x & 0xFFFFFFFF).value


def test_numbers_against_python(spark):
    rows = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = rows.select("a", "b", N.add(a, b).alias("add"), N.sub(a, b).alias("sub"), N.div(a, b).alias("div"), N.mod(a, b).alias("mod"), N.absolute(a).alias("abs"), N.get_bits(a, 3, 9).alias("get"), N.bit_count(a).alias("bits"), N.add_percent(a, F.lit(10)).alias("pct")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.add is None and r["sub"] is None
            continue
        assert r.add == wrap(r.a + r.b) and r["sub"] == wrap(r.a - r.b) and r.abs == wrap(abs(r.a))
        assert r.div == (0 if r.b == 0 else wrap(math.trunc(r.a / r.b)))
        assert r["mod"] == (0 if r.b == 0 else int(math.fmod(r.a, r.b)))
        assert r["get"] == ((r.a & 0xFFFFFFFF) >> 3) & 127 and r.bits == bin(r.a & 0xFFFFFFFF).count("1")


def test_slope_is_rounded_before_it_is_multiplied(spark):
    r = spark.range(1).select(N.interpolate(F.lit(0), F.lit(10), F.lit(0), F.lit(3), F.lit(2)).alias("up"), N.interpolate(F.lit(0), F.lit(-10), F.lit(0), F.lit(3), F.lit(2)).alias("down"), N.interpolate(F.lit(1), F.lit(2), F.lit(5), F.lit(5), F.lit(2)).alias("flat"), N.set_bit(F.lit(0), F.lit(31)).alias("top"), N.power(F.lit(2), F.lit(40)).alias("big")).first()
    assert (r.up, r.down, r.flat, r.top, r.big) == (6, -8, 0, -(2**31), 0)


def test_names_go_round(spark):
    names = ["a", "Zezima", "player_1", "x y z", "a_", "", "123456789012345", "é?"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", B.encode(F.col("n")).alias("v"))
    got = {r.n: (r.v, r.back, r.shown) for r in rows.select("n", "v", B.decode(F.col("v")).alias("back"), B.display(F.col("n")).alias("shown")).collect()}
    assert got["Zezima"][1] == "zezima" and got["player_1"][1] == "player_1" and got["player_1"][2] == "Player 1" and got["x y z"][1] == "x_y_z"
    assert got["a_"][1] == "invalid_name" and got[""] == (0, "invalid_name", "Invalid Name") and got["123456789012345"][1] == "123456789012"


def test_coordinates(spark):
    c = C.pack(F.lit(2), F.lit(3222), F.lit(3218))
    r = spark.range(1).select(C.level_of(c).alias("l"), C.x_of(c).alias("x"), C.z_of(c).alias("z"), C.distance(c, C.move(c, F.lit(-3), F.lit(0), F.lit(9))).alias("d")).first()
    assert (r.l, r.x, r.z, r.d) == (2, 3222, 3218, 9)


def test_partial_dates(spark):
    cases = {"2004-09-07": 20040907, "2004": 20041231, "2004-09": 20040931, "unknown": None, "Early beta": None, "": None, "2004-9-7 approx": 20040907, None: None, "1899": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in rows.select("t", D.date_number(F.col("t")).alias("n")).collect()} == cases


def test_texts(spark):
    rows = spark.createDataFrame([("  Foo__Bar  (2) ",), (None,), ("",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in rows.select(X.normal_name(t), X.title_form(t), X.slug(t), X.letters_digits(t), X.clip(t, 6)).collect()]
    assert got == [("foo bar (2)", "foo  bar \u00a0(2)", "foo_bar_2", "foobar2", "Foo..."), (None, None, "section", "", ""), ("", "", "section", "", "")]
    row = spark.createDataFrame([("[[A|b]] [[C#x]] [[File:z.png]] [[category: q]] [[]] [[D|]]",)], "t string").select(X.links(t).alias("l")).first()
    assert [(x["target"], x["label"]) for x in row.l] == [("A", "b"), ("C", "C"), ("D", "D")]
