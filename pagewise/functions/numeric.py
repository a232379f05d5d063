"""Exact decimal rounding of integer ratios.

``ROUND(AVG(int), 2)`` in the original database is decimal-exact half-up.
Rounding the double ``sum/count`` can land on the wrong side of a .xx5 tie
(e.g. 1/40), so averages of whole numbers are rounded on the integer ratio
instead: floor((2*10^s*|n| + d) / (2*d)) with the sign put back.  Pure
integer arithmetic: identical in every engine, and codegen-friendly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_round_half_up(num: Column | str, den: Column | str, scale: int = 2) -> Column:
    """round(num/den, scale) half away from zero, exact; NULL when den is 0/NULL."""
    n, d = _c(num).cast("decimal(25,0)"), _c(den).cast("decimal(20,0)")
    p = 10**scale
    # 25 digits of |n| times 2p, plus d: exact in 38 digits; floor of an exact quotient of whole numbers
    top = F.abs(n) * F.lit(2 * p).cast("decimal(4,0)") + d
    q = F.call_function("div", top, d * F.lit(2).cast("decimal(1,0)"))
    return F.when(d > 0, F.signum(n) * q / F.lit(float(p))).cast("double")


def half_up_js(c: Column | str, scale: int = 2) -> Column:
    """Math.round(x*100)/100 (rounds .5 towards +infinity)."""
    p = float(10**scale)
    return F.floor(_c(c) * p + 0.5) / p
