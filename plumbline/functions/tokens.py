"""Column expressions on the printed form of a number. All are built-in functions: nothing leaves the JVM.

Digits and decimals are properties of the text, so they are read from the token, and only
arithmetic uses its double. A null or non-numeric cell has a null token, and everything
derived from it is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: keeps nested expressions from being written out again at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


NUMBER = r"(?U)\A[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?\z"


_SIMPLE = r"\A[-+]?[0-9]+(?:\.[0-9]+)?\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean_cell(text: Column) -> Column:
    """Empty for null and for words that mean none; white space collapsed."""
    bare = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare).isin("nan", "none", "null"), "").otherwise(F.regexp_replace(bare, _BLANKS, " "))


def numeric_token(text: Column) -> Column:
    """The number as printed, without commas and a closing per cent sign; null if it isn't one."""
    bare = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), ",", "")
    bare = stripped(F.when(bare.endswith("%"), bare.substr(F.lit(1), F.length(bare) - 1)).otherwise(bare))
    # Nearly all cells are plain numbers, which one simple pattern tells.
    return F.when(text.rlike(_SIMPLE), text).otherwise(F.when(bare.rlike(NUMBER), bare))


def value(token: Column) -> Column:
    """The token's double; null where that isn't finite."""
    number = token.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def plain(token: Column) -> Column:
    """The token without exponent: decimals of exponent tokens are written out."""
    parts = F.struct(
        F.regexp_extract(token, r"^[-+]?(\d*)", 1).alias("whole"), F.regexp_replace(F.regexp_extract(token, r"^[-+]?([^eE]*)", 1), r"\.", "").alias("digits"), F.regexp_extract(token, r"[eE]([-+]?\d+)$", 1).try_cast("int").alias("exponent")
    )

    def written(p: Column) -> Column:
        """Digits with the point moved, zeros filled in on either side."""
        point = F.length(p["whole"]) + p["exponent"]
        filled = F.when(point <= 0, F.concat(F.lpad(F.lit(""), 1 - point, "0"), p["digits"])).otherwise(F.rpad(p["digits"], F.greatest(point, F.length(p["digits"])), "0"))
        at = F.greatest(point, F.lit(1))
        return let(F.struct(filled.alias("d"), at.alias("at")), lambda x: F.concat_ws(".", x["d"].substr(F.lit(1), x["at"]), F.when(F.length(x["d"]) > x["at"], x["d"].substr(x["at"] + 1, F.length(x["d"])))))

    moved = let(parts, lambda p: F.when(p["exponent"].between(-400, 400), written(p)).otherwise(token))
    return F.when(_has_exponent(token), moved).otherwise(token)


def _has_exponent(token: Column) -> Column:
    return token.contains("e") | token.contains("E")


def _decimals(token: Column) -> Column:
    return F.split_part(token, F.lit("."), F.lit(2))


def last_digit(token: Column) -> Column:
    """The last printed digit of a token without exponent."""
    return F.right(F.rtrim(token, F.lit(".")), F.lit(1))


def decimal_tail(token: Column) -> Column:
    """The first two decimals of a token without exponent, padded with zeros."""
    return F.rpad(F.substring(_decimals(token), 1, 2), 2, "0")


def decimal_places(token: Column) -> Column:
    """Printed decimals; null for numbers with an exponent."""
    return F.when(~_has_exponent(token), F.length(_decimals(token)))


def first_digit(token: Column) -> Column:
    """The first digit that isn't 0."""
    return F.nullif(F.regexp_extract(token, r"^[^eE1-9]*([1-9])", 1), F.lit(""))


def integer_like(token: Column) -> Column:
    return token.rlike(r"^[-+]?\d+(\.0+)?$")


#: The published fit's coefficients, from the constant one up.
_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function (Chebyshev fit of Numerical Recipes; relative error under 1.2e-7)."""

    def of(p: Column) -> Column:
        t = p["t"]
        fit = F.lit(_FIT[-1])
        for c in _FIT[-2::-1]:
            fit = F.lit(c) + t * fit
        y = t * F.exp(-p["x"] * p["x"] + fit)
        return F.when(p["x"] >= 0, y).otherwise(2.0 - y)

    return let(x, lambda v: let(F.struct(v.alias("x"), (1.0 / (1.0 + 0.5 * F.abs(v))).alias("t")), of))


def chi_square_p(chi2: Column, df: int) -> Column:
    """Upper tail of chi-square by the Wilson-Hilferty approximation."""
    if df <= 0:
        return F.lit(1.0)
    k = 2.0 / (9.0 * df)
    z = (F.pow(chi2 / df, F.lit(1.0 / 3.0)) - (1.0 - k)) / (k**0.5)
    return 0.5 * erfc(z / (2.0**0.5))


def minus_ten_log(p: Column) -> Column:
    return -10.0 * F.log10(F.greatest(p, F.lit(1e-12)))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a column counted from 0 (up to three)."""
    letter = lambda n: F.chr(65 + n)
    two = index - 26
    three = index - 702
    return (
        F.when(index < 26, letter(index))
        .when(index < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )
