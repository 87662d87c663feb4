"""Numbers with three distinct states: a value, NaN (computed but undefined) and NULL (missing)."""
from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """True only for an ordinary number; NULL, NaN and infinities are false."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def number(text: Column) -> Column:
    """Numeric text to double; empty text is NULL and 'nan' stays NaN."""
    return F.nullif(text, F.lit("")).try_cast("double")


def defined(c: Column) -> Column:
    """The value where it is finite, NULL elsewhere: safe inside avg, max and sort."""
    return F.when(finite(c), c)


def zero_with_flag(c: Column) -> tuple[Column, Column]:
    """Missing becomes zero, and a 0/1 availability column says so."""
    return F.coalesce(defined(c), F.lit(0.0)), finite(c).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL when either column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def snap(c: Column, digits: int = 4) -> Column:
    """Round for comparison between engines.

    Exact ties are moved off the rounding boundary, so that a different summation order cannot
    turn one of them the other way.
    """
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale) + F.lit(1e-5), 0) / F.lit(scale) + F.lit(0.0)


def same(a: Column, b: Column, rtol: float = 1e-10, atol: float = 1e-10) -> Column:
    """Tolerant equality of two text cells: numeric closeness with NaN = NaN, else equal text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    close = (F.isnan(x) & F.isnan(y)) | (x == y) | (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    blank = (F.coalesce(a, F.lit("")) == "") & (F.coalesce(b, F.lit("")) == "")
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, close).otherwise(blank | F.coalesce(a == b, F.lit(False)))
