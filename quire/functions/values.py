"""Dates, amounts and vectors read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYYMMDD``, else null (week dates are not read)."""
    value = F.trim(c)
    dashed = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    plain = F.when(value.rlike(r"^\d{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd")))
    return F.coalesce(dashed, plain).cast("date")


def french_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*\d{2}/\d{2}/\d{4}\s*$"), F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy"))).cast("date")


def add_years(c: Column, years) -> Column:
    """Calendar years; 29 February falls on the 28th."""
    return F.add_months(c, F.lit(12) * years if isinstance(years, Column) else F.lit(12 * years))


def amount(c: Column) -> Column:
    """A decimal number with a point or a comma, else null."""
    value = F.trim(F.replace(c, F.lit(","), F.lit(".")))
    return F.when(value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"), value.try_cast("double"))


def cents(c: Column) -> Column:
    return F.bround(c * 100).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def l2_normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x / norm))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
