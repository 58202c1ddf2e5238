"""Machine-readable zones of identity cards as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters by value: digits, then A to Z from 10 on; the filler counts zero.
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BIRTH_PIVOT = 25


def normalise(c: Column) -> Column:
    return F.replace(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), F.lit(">"), F.lit("<"))


def is_mrz_line(c: Column) -> Column:
    """Of a normalised line."""
    return (F.length(c) >= 25) & c.contains("<") & c.rlike("^[A-Z0-9<]+$")


def zone_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, zone)``: each document's lines of a machine-readable zone, from the top of the page down, ties
    in reading order; documents with fewer than two have no row."""
    clean = lines.select("doc_id", "y0", "line_no", normalise(F.col("text")).alias("zone")).where(is_mrz_line(F.col("zone")))
    grouped = clean.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "line_no", "zone"))).alias("found")).where(F.size("found") >= 2)
    return grouped.select("doc_id", F.transform("found", lambda x: x["zone"]).alias("zone"))


def check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 in turn, modulo 10.  The argument is cut into characters once, as an argument
    inside a lambda would be evaluated for each of them."""
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    value = lambda x: F.greatest(F.position(x, F.lit(VALUES)) - 1, F.lit(0))
    parts = F.transform(F.split(c, ""), lambda x, i: value(x) * F.element_at(weights, i % 3 + 1))
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x) % 10


def _digit(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), c.try_cast("int"))


def _holds(part: Column, digit: Column) -> Column:
    """Whether a check digit holds; null where there is none."""
    return check_digit(part) == _digit(digit)


def clean_names(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.replace(c, F.lit("<"), F.lit(" ")), " +", " ")), F.lit(""))


def iso(c: Column, future: bool = False) -> Column:
    """YYMMDD as ISO text, without a look at the calendar."""
    year = F.substring(c, 1, 2).try_cast("int")
    century = F.lit(2000) if future else F.when(year > BIRTH_PIVOT, 1900).otherwise(2000)
    made = F.concat_ws("-", (century + year).cast("string"), F.substring(c, 3, 2), F.substring(c, 5, 2))
    return F.when(c.rlike("^[0-9]{6}$"), made)


def _sex(c: Column) -> Column:
    return F.when(c.isin("M", "F"), c)


def _checks(**found: Column) -> Column:
    """The checks that could be made, by name."""
    made = F.map_from_arrays(F.array(*(F.lit(k) for k in found)), F.array(*found.values()))
    return F.map_filter(made, lambda _, held: held.isNotNull())


def parse_two_lines(first: Column, second: Column) -> Column:
    """The national card's two lines of 36."""
    a, b = F.rpad(first, 36, "<"), F.rpad(second, 36, "<")
    return F.struct(
        F.lit("french_2line").alias("mrz_format"),
        clean_names(F.substring(a, 6, 25)).alias("surname"),
        clean_names(F.substring(b, 14, 14)).alias("given_names"),
        iso(F.substring(b, 28, 6)).alias("birth_date"),
        F.lit(None).cast("string").alias("expiry_date"),
        _sex(F.substring(b, 35, 1)).alias("sex"),
        F.lit(None).cast("string").alias("document_number"),
        _checks(
            administrative=_holds(F.substring(b, 1, 12), F.substring(b, 13, 1)),
            birth_date=_holds(F.substring(b, 28, 6), F.substring(b, 34, 1)),
            composite=_holds(F.concat(a, F.substring(b, 1, 35)), F.substring(b, 36, 1)),
        ).alias("checks"),
    )


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def parse_td1(lines: Column) -> Column:
    """Three lines of 30, any of which may be missing; the numeric line is claimed before the names'."""
    document = _first(F.filter(lines, lambda x: F.substring(x, 1, 2).isin("ID", "I<")))
    place = F.array_position(lines, document)
    numeric = _first(F.filter(F.transform(lines, lambda x, i: F.when((i + 1 != F.coalesce(place, F.lit(0))) & x.rlike("^[0-9]{6}"), x)), lambda x: x.isNotNull()))
    names = _first(F.filter(lines, lambda x: ~x.eqNullSafe(document) & ~x.eqNullSafe(numeric) & x.contains("<<")))
    parts = F.filter(F.split(names, "<<"), lambda p: F.replace(p, F.lit("<"), F.lit("")) != "")
    d, n = F.rpad(document, 30, "<"), F.rpad(numeric, 30, "<")
    composite = F.concat(F.substring(d, 6, 25), F.substring(n, 1, 7), F.substring(n, 9, 7), F.substring(n, 19, 11))
    return F.struct(
        F.lit("td1").alias("mrz_format"),
        clean_names(F.get(parts, F.lit(0))).alias("surname"),
        clean_names(F.get(parts, F.lit(1))).alias("given_names"),
        iso(F.substring(n, 1, 6)).alias("birth_date"),
        iso(F.substring(n, 9, 6), future=True).alias("expiry_date"),
        _sex(F.substring(n, 8, 1)).alias("sex"),
        F.nullif(F.replace(F.substring(d, 6, 9), F.lit("<"), F.lit("")), F.lit("")).alias("document_number"),
        _checks(
            document_number=_holds(F.substring(d, 6, 9), F.substring(d, 15, 1)),
            birth_date=_holds(F.substring(n, 1, 6), F.substring(n, 7, 1)),
            expiry_date=_holds(F.substring(n, 9, 6), F.substring(n, 15, 1)),
            composite=_holds(composite, F.substring(n, 30, 1)),
        ).alias("checks"),
    )


def parse(lines: Column) -> Column:
    """By the longest line: 34 or more characters are the two-line form."""
    longest = F.array_max(F.transform(lines, F.length))
    return F.when(F.size(lines) >= 2, F.when(longest >= 34, parse_two_lines(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)))).otherwise(parse_td1(lines)))


def passing(checks: Column) -> Column:
    return F.size(F.filter(F.map_values(checks), lambda held: held))


def is_trustworthy(checks: Column) -> Column:
    return (F.size(checks) > 0) & F.forall(F.map_values(checks), lambda held: held)
