"""Missing-value and ANSI arithmetic helpers.

Missing is NULL everywhere. Spark runs with ANSI mode on, so a plain
division by zero raises; every ratio in the library goes through
``safe_div`` and yields NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or either side is NULL."""
    return F.try_divide(as_col(num), as_col(den))


def nan_to_null(c) -> Column:
    """Turn floating NaN into NULL (Spark orders NaN above every number)."""
    c = as_col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def ne_keep_null(c, value) -> Column:
    """``c != value`` that keeps NULL rows (pandas ``!=`` keeps NaN)."""
    return ~as_col(c).eqNullSafe(F.lit(value))


def not_in_keep_null(c, values) -> Column:
    c = as_col(c)
    return c.isNull() | ~c.isin(list(values))


def dash_to_zero(c, token: str = "--") -> Column:
    """Replace a textual null token by the string ``'0'``."""
    c = as_col(c)
    return F.when(c == F.lit(token), F.lit("0")).otherwise(c)


def lossy_double(c) -> Column:
    """Numeric cast that gives NULL instead of raising on bad text."""
    return as_col(c).try_cast("double")


def safe_corr_parts(x, y):
    """Moments for a correlation that is NULL (not an error) on constants.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant column.
    Returns the aggregate expressions whose ratio is the Pearson r over
    rows where both sides are present.
    """
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x)
    yy = F.when(both, y)
    return F.covar_pop(xx, yy), F.stddev_pop(xx), F.stddev_pop(yy)
