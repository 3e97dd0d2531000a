"""Money arithmetic: exact until the last division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def revenue() -> Column:
    """Value of one line."""
    return F.col("quantity") * F.col("unitprice")


# A double price is taken as the decimal number it prints as, to so many places.
DOUBLE_PRICE_TYPE = T.DecimalType(24, 12)
_LONG_DIGITS = 19
_MOST_DIGITS = 38


def exact_as(value: Column, kind: T.DecimalType, what: str) -> Column:
    """``value`` as a decimal of that type, or an error if that would change it.

    A double price is taken as the decimal it prints as; anything else must be equal.
    """
    made = value.try_cast(kind)
    same = made.cast("double") == value if what == "price" else made == value
    message = F.concat(F.lit(f"{what} does not fit {kind.simpleString()}: "), value.cast("string"))
    return F.when(value.isNull() | F.coalesce(same, F.lit(False)), made).otherwise(
        F.raise_error(message)
    )


def exact_revenue_sum(df: DataFrame) -> Column:
    """``SUM(quantity * unitprice)`` without rounding, as a decimal aggregate.

    The product has room for all digits of both sides, so it is exact, and the sum
    has all 38 digits a decimal can have. What fits in neither is an error
    whatever the session's settings: a double price with more than twelve
    decimals, a quantity too long beside a very wide price, a sum past 38 digits.
    """
    price_type = df.schema["unitprice"].dataType
    price = F.col("unitprice")
    if not isinstance(price_type, T.DecimalType):
        price_type, price = DOUBLE_PRICE_TYPE, exact_as(price, DOUBLE_PRICE_TYPE, "price")
    digits = min(_LONG_DIGITS, _MOST_DIGITS - 1 - price_type.precision)
    if digits < 1:
        raise ValueError(f"{price_type.simpleString()} leaves no digit for quantities")
    quantity = F.col("quantity")
    if digits < _LONG_DIGITS:
        quantity = exact_as(quantity, T.DecimalType(digits, 0), "quantity")
    else:
        quantity = quantity.cast(T.DecimalType(digits, 0))
    value = quantity * price
    return exact_sum(value)


def exact_sum(value: Column) -> Column:
    """The sum of decimals, or an error if it has more than 38 digits.

    Without ANSI mode Spark gives NULL for such a sum.
    """
    total = F.sum(value)
    too_long = total.isNull() & (F.count(value) > 0)
    return F.when(too_long, F.raise_error(F.lit("sum overflow: more than 38 digits"))).otherwise(
        total
    )


def rounded_revenue_sum(df: DataFrame) -> Column:
    """``exact_revenue_sum`` rounded half up to two places."""
    return F.round(exact_revenue_sum(df), 2)


def round_half_away(value: Column, places: int = 2) -> Column:
    """Round a double half away from zero on its binary value.

    Spark's ``round`` works on the shortest decimal text instead and differs
    on values such as 1.005, which as a double lies just below the half.
    """
    factor = F.lit(float(10**places))
    return F.signum(value) * F.floor(F.abs(value) * factor + F.lit(0.5)) / factor


def divide_rounded(numerator: Column, denominator: Column, scale_by: int = 1) -> Column:
    """``numerator / denominator * scale_by`` in doubles, rounded to 2 places.

    NULL where the denominator is zero.
    """
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return round_half_away(ratio * F.lit(float(scale_by)))
