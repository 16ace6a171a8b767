import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import tokens as T

# text: token, last digit, tail, places, first digit
CASES = {
    "12%": ("12", "2", "00", 0, "1"),
    "1,234.50": ("1234.50", "0", "50", 2, "1"),
    "5.": ("5.", "5", "00", 0, "5"),
    ".5": (".5", "5", "50", 1, "5"),
    "1e-7": ("1e-7", "1", "00", None, "1"),
    "2e2": ("2e2", "0", "00", None, "2"),
    "-1.25E1": ("-1.25E1", "5", "50", None, "1"),
    "0.00420": ("0.00420", "0", "00", 5, "4"),
    "\t 7.25 \n": ("7.25", "5", "25", 2, "7"),
    "1,2,3": ("123", "3", "00", 0, "1"),
    **dict.fromkeys(["inf", "1_000", "n/a", "12d", "", None, "nan", "--1", "1e", "%"], None),
}


def test_tokens(spark):
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, x string").withColumn("t", T.numeric_token(F.col("x")))
    got = df.select("i", "t", T.last_digit(T.plain(t)), T.decimal_tail(T.plain(t)), T.decimal_places(t), T.first_digit(t)).orderBy("i").collect()
    for (text, want), row in zip(CASES.items(), got, strict=True):
        assert row[1:] == (want or (None,) * 5), text


def test_exponents_are_written_out(spark):
    for text in ("1e-7", "2e2", "-1.25E1", "1.5e0", "12.345e-1", "9.99e4", ".5e1"):
        got = spark.range(1).select(T.plain(F.lit(text))).first()[0]
        assert Decimal(got) == abs(Decimal(text)), text


def test_clean_cell(spark):
    got = spark.createDataFrame([(" a \t b  c ",), ("NaN",), (None,), ("null ",)], "x string").select(T.clean_cell(F.col("x"))).collect()
    assert [r[0] for r in got] == ["a b c", "", "", ""]


def test_chi_square_and_erfc(spark):
    for chi2, df, want in ((9.0, 9, 0.43756929), (21.666, 9, 0.0101074878), (0.0, 9, 0.9999999997), (15.507, 8, 0.0497031269)):
        assert spark.range(1).select(T.chi_square_p(F.lit(chi2), df)).first()[0] == pytest.approx(want, rel=1e-6)
    for x in (-3.0, -0.4, 0.0, 0.7, 5.0):
        assert spark.range(1).select(T.erfc(F.lit(x))).first()[0] == pytest.approx(math.erfc(x), rel=2e-7)


def test_column_letters(spark):
    got = [r[0] for r in spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 701, 702, 728)], "i int").select(T.column_letters(F.col("i"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ABA"]
