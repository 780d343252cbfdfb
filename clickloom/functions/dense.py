"""Dense (numeric) and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_missing(c: Column | str, default: str = "0") -> Column:
    """NULL, the empty string and a lone newline become ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | c.isin("", "\n"), F.lit(default)).otherwise(c)


def fill_missing_typed(df: DataFrame, dense, sparse) -> DataFrame:
    """NULL by role: 0.0 in dense columns, ``'0'`` in sparse ones."""
    defaults = {c: 0.0 for c in dense} | {c: "0" for c in sparse}
    return df.na.fill(defaults)


def neg_to_zero(c: Column) -> Column:
    """Negative values become 0; NULL and NaN are left alone."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def log1p(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def neg_to_zero_log(c: Column) -> Column:
    """Strict clip and log of a whole number.

    Fractions in numeric columns are cut toward zero; text that is not a whole
    number, or a missing value, fails the query.
    """
    whole = F.coalesce(
        c.try_cast("bigint"),
        F.raise_error(F.lit("dense value is missing or not a whole number")).cast(
            "bigint"
        ),
    )
    return F.log1p(neg_to_zero(whole).cast("double"))


def neg_to_zero_log_lenient(c: Column) -> Column:
    """Clip and log that keeps fractions; what cannot be read becomes 0.0."""
    return F.coalesce(log1p(neg_to_zero(c.try_cast("double"))), F.lit(0.0))


def _strict(c: Column, kind: str, what: str) -> Column:
    """A cast that fails on text that cannot be read, whatever the ANSI setting; NULL stays."""
    value = c.try_cast(kind)
    failure = F.raise_error(F.lit(f"{what} cannot be read")).cast(kind)
    return F.when(c.isNotNull() & value.isNull(), failure).otherwise(value)


def dense_double(c: Column) -> Column:
    return _strict(c, "double", "dense value")


def label_int(c: Column) -> Column:
    return _strict(c, "int", "label")


def label_float(c: Column) -> Column:
    return _strict(c, "float", "label")
