"""Two-column statistics that give null, not an error, where a column is constant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _paired(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    a = F.col(x) if isinstance(x, str) else x
    b = F.col(y) if isinstance(y, str) else y
    return F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the complete pairs; ``corr`` divides by zero in ANSI mode."""
    a, b = _paired(x, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x over the complete pairs."""
    b, a = _paired(y, x)
    return F.try_divide(F.covar_pop(a, b), F.var_pop(a))
