"""Rounding that looks at the exact binary value and breaks true ties to even.

Spark's ``round`` works on the shortest decimal form and rounds it half up,
so 0.01075 gives 0.0108 although the stored value lies below the tie. Only
values near a tie take the slower text path.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 0.01


def rounded_sql(value: str, digits: int) -> str:
    unit, half = f"1e-{digits}D", 5 / 10 ** (digits + 1)
    # Below one unit the text path drops the half itself, so it is compared here.
    above = ">=" if Decimal(half) > Decimal(5).scaleb(-digits - 1) else ">"
    small = f"IF(abs({value}) {above} {half!r}D, signum({value}) * {unit}, 0D)"
    near = f"abs(pmod({value} * {10 ** digits}D, 1D) - 0.5D) < {NEAR}D"
    exact = f"CAST(format_number({value}, '0.{'0' * digits}') AS DOUBLE)"
    return f"CASE WHEN NOT {near} THEN round({value}, {digits}) WHEN abs({value}) < {unit} THEN {small} ELSE {exact} END"


def rounded(value: Column, digits: int) -> Column:
    x = value.cast("double")
    unit, half = 10.0 ** -digits, 5 / 10 ** (digits + 1)
    above = F.abs(x) >= half if Decimal(half) > Decimal(5).scaleb(-digits - 1) else F.abs(x) > half
    near = F.abs(F.pmod(x * float(10 ** digits), F.lit(1.0)) - 0.5) < NEAR
    exact = F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")
    return (
        F.when(~near, F.round(x, digits))
        .when(F.abs(x) < unit, F.when(above, F.signum(x) * unit).otherwise(0.0))
        .otherwise(exact)
    )
