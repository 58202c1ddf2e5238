"""Configurable checks on extracted fields, and the verdict that follows.

Fields are a ``map<string, string>`` column; a rule is a dictionary; a check builds, from both, a
column with an array of failures ``(reason, kind, determined)``.  A failure that only says "can't
tell" is not determined: severity never changes it, so an unknown never becomes a reject.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text, values

REJECT, REVIEW, AUTO = "reject", "review", "auto"
FAILURES = "array<struct<reason:string,kind:string,determined:boolean>>"


@dataclass
class Context:
    """What checks know beyond the document; None means not available, which is not the same as empty.

    ``holder``: a column with the declared holder's name.  ``registry``: a table with one column of
    recognised identifiers.  ``attestations``: a table ``(holder_name, issue_date, expiry_date)``."""

    today: datetime.date | None = None
    holder: str | None = None
    registry: DataFrame | None = None
    attestations: DataFrame | None = None


def failure(reason: Column | str, kind: str, determined: bool) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(reason.alias("reason"), F.lit(kind).alias("kind"), F.lit(determined).alias("determined"))


def _one(condition: Column, made: Column) -> Column:
    return F.when(condition, F.array(made)).otherwise(none())


def none() -> Column:
    return F.array().cast(FAILURES)


def _field(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _missing(found: dict[str, Column]) -> Column:
    """Names, in order, of values that could not be read, comma-joined; empty if all could."""
    return F.array_join(F.array_compact(F.array(*(F.when(value.isNull(), F.lit(name)) for name, value in found.items()))), ", ")


def present(fields: Column, rule: dict, context: Context) -> Column:
    return _one(~_filled(_field(fields, rule["field"])), failure(f"{rule['field']}: required (presence) but not read", REVIEW, False))


def sums(fields: Column, rule: dict, context: Context) -> Column:
    total_name, tolerance = rule["equals"], rule.get("tolerance", 0.01)
    parts = {name: values.amount(_field(fields, name)) for name in rule["terms"]}
    total = values.amount(_field(fields, total_name))
    missing = _missing(parts | {total_name: total} if total_name not in parts else parts)
    summed = reduce(lambda a, b: a + b, parts.values(), F.lit(0.0))
    off = F.abs(values.cents(summed) - values.cents(total)) > round(tolerance * 100)
    wrong = F.concat(F.lit(f"sum check failed: {' + '.join(rule['terms'])} = "), F.format_string("%.2f", summed), F.lit(f" != {total_name} = "), F.format_string("%.2f", total), F.lit(f" (tolerance {tolerance})"))
    return F.when(missing != "", F.array(failure(F.concat(F.lit(f"sum check ({total_name}): missing/unreadable "), missing), REVIEW, False))).otherwise(_one(off, failure(wrong, REVIEW, True)))


def _two_dates(fields: Column, names: tuple[str, str], check: str, found) -> Column:
    a, b = (values.iso_date(_field(fields, n)) for n in names)
    missing = _missing(dict(zip(names, (a, b), strict=True)))
    return F.when(missing != "", F.array(failure(F.concat(F.lit(f"{check} check: missing/unreadable "), missing), REVIEW, False))).otherwise(found(a, b))


def date_order(fields: Column, rule: dict, context: Context) -> Column:
    first, last = rule["earlier"], rule["later"]

    def found(a: Column, b: Column) -> Column:
        order = F.concat(F.lit(f"date_order check failed: {first} "), a.cast("string"), F.lit(f" is not before {last} "), b.cast("string"))
        made = _one(a >= b, failure(order, REJECT, True))
        if not rule.get("require_future"):
            return made
        today = F.lit(context.today) if context.today else F.current_date()
        past = F.concat(F.lit(f"date_order check failed: {last} "), b.cast("string"), F.lit(" is in the past (expired as of "), today.cast("string"), F.lit(")"))
        return F.concat(made, _one(b < today, failure(past, REJECT, True)))

    return _two_dates(fields, (first, last), "date_order", found)


def date_span(fields: Column, rule: dict, context: Context) -> Column:
    start, end, years, tolerance = rule["start"], rule["end"], rule["years"], rule.get("tolerance_days", 2)

    def found(a: Column, b: Column) -> Column:
        due = values.add_years(a, years)
        off = F.abs(F.datediff(b, due))
        reason = F.concat(F.lit(f"date_span check failed: {end} "), b.cast("string"), F.lit(f" != {start} + {years}y ("), due.cast("string"), F.lit("), off by "), off.cast("string"), F.lit(f" days (tolerance {tolerance})"))
        return _one(off > tolerance, failure(reason, REJECT, True))

    return _two_dates(fields, (start, end), "date_span", found)


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def vocabulary(fields: Column, rule: dict, context: Context) -> Column:
    name, allowed = rule["field"], sorted({a.strip().casefold() for a in rule["allowed"]})
    value = _field(fields, name)
    words = F.filter(F.split(value, r"(?U)[\s,;/]+"), lambda t: t != "")
    unknown = F.filter(words, lambda t: ~F.array_contains(F.array(*map(F.lit, allowed)).cast("array<string>"), fold(t)))
    wrong = F.concat(F.lit(f"vocabulary check failed ({name}): "), F.array_join(unknown, ", "), F.lit(" not in the allowed list"))
    missing = F.array(failure(f"vocabulary check ({name}): missing/unreadable", REVIEW, False))
    return F.when(~_filled(value), missing).otherwise(_one(F.size(unknown) > 0, failure(wrong, REJECT, True)))


def holder_matches(fields: Column, rule: dict, context: Context) -> Column:
    name = rule["field"]
    absent = failure(f"reconcile_ci ({name}): no CI reference on file to compare against", REVIEW, False)
    if context.holder is None:
        return F.array(absent)
    value, holder = _field(fields, name), F.col(context.holder)
    unread = failure(f"reconcile_ci ({name}): holder name missing/unreadable", REVIEW, False)
    wrong = F.concat(F.lit(f"reconcile_ci check failed ({name}): holder "), text.quoted(value), F.lit(" does not match the CI record "), text.quoted(holder), F.lit(" (strict)"))
    return F.when(holder.isNull(), F.array(absent)).when(~_filled(value), F.array(unread)).otherwise(_one(text.strict_key(value) != text.strict_key(holder), failure(wrong, REJECT, True)))


def issuer_known(fields: Column, rule: dict, context: Context) -> Column:
    """Reads the column that ``with_context`` has joined for this rule."""
    name = rule["field"]
    if context.registry is None:
        return F.array(failure(f"issuer_registry ({name}): no organism registry available", REVIEW, False))
    value = _field(fields, name)
    unread = failure(f"issuer_registry ({name}): issuer missing/unreadable", REVIEW, False)
    wrong = F.concat(F.lit(f"issuer_registry check failed ({name}): issuer "), text.quoted(value), F.lit(" is not in the recognized-organism registry"))
    return F.when(~_filled(value), F.array(unread)).otherwise(_one(F.col(f"_known_{name}").isNull(), failure(wrong, REVIEW, True)))


def corroborated(fields: Column, rule: dict, context: Context) -> Column:
    """Reads the column that ``with_context`` has joined for this rule."""
    holder_name, issue_name = rule["holder_field"], rule["issue_field"]
    if context.attestations is None:
        return F.array(failure(f"corroborated_by ({holder_name}): no validated attestations on file", REVIEW, False))
    holder, issue = _field(fields, holder_name), values.iso_date(_field(fields, issue_name))
    no_holder = failure(f"corroborated_by ({holder_name}): holder name missing/unreadable", REVIEW, False)
    no_issue = failure(f"corroborated_by ({issue_name}): titre issue date missing/unreadable", REVIEW, False)
    wrong = F.concat(F.lit(f"corroborated_by check failed ({holder_name}): no validated attestation corroborates the self-declared titre for "), text.quoted(holder), F.lit(" at "), issue.cast("string"))
    held = F.exists(F.coalesce(F.col(f"_windows_{holder_name}"), F.array().cast("array<struct<issue:date,expiry:date>>")), lambda w: (w["issue"] <= issue) & (issue <= w["expiry"]))
    return F.when(~_filled(holder), F.array(no_holder)).when(issue.isNull(), F.array(no_issue)).otherwise(_one(~held, failure(wrong, REVIEW, True)))


#: Checks by name; a new check is a function and a line here.
CHECKS = {
    "present": present,
    "sum": sums,
    "date_order": date_order,
    "date_span": date_span,
    "vocabulary": vocabulary,
    "reconcile_ci": holder_matches,
    "issuer_registry": issuer_known,
    "corroborated_by": corroborated,
}


def with_context(df: DataFrame, rules: list[dict], context: Context, fields_col: str = "fields") -> DataFrame:
    """Joins what the rules' context checks read: registry hits and attestation windows by key."""
    for rule in rules:
        if rule.get("check") == "issuer_registry" and context.registry is not None and f"_known_{rule['field']}" not in df.columns:
            known = context.registry.select(text.strict_key(F.col(context.registry.columns[0])).alias("_key")).distinct().withColumn(f"_known_{rule['field']}", F.lit(True))
            df = df.withColumn("_key", text.strict_key(_field(F.col(fields_col), rule["field"]))).join(known, "_key", "left").drop("_key")
        if rule.get("check") == "corroborated_by" and context.attestations is not None and f"_windows_{rule['holder_field']}" not in df.columns:
            read = context.attestations.select(text.strict_key(F.col("holder_name")).alias("_key"), values.iso_date(F.col("issue_date")).alias("issue"), values.iso_date(F.col("expiry_date")).alias("expiry"))
            windows = read.where("issue IS NOT NULL AND expiry IS NOT NULL").groupBy("_key").agg(F.collect_set(F.struct("issue", "expiry")).alias(f"_windows_{rule['holder_field']}"))
            df = df.withColumn("_key", text.strict_key(_field(F.col(fields_col), rule["holder_field"]))).join(windows, "_key", "left").drop("_key")
    return df


def _with_severity(found: Column, severity: str) -> Column:
    kind = lambda f: F.when(f["determined"], F.lit(severity)).otherwise(f["kind"])
    return F.transform(found, lambda f: F.struct(f["reason"].alias("reason"), kind(f).alias("kind"), f["determined"].alias("determined")))


def failures_of(fields: Column, rules: list[dict], context: Context) -> Column:
    """All failures in rule order, severities applied."""
    parts = [none()]
    for rule in rules:
        name, severity = rule.get("check"), rule.get("severity")
        if severity is not None and severity not in (REJECT, REVIEW):
            reason = f"unknown severity {severity!r} on check '{name}' — config error (expected 'reject' or 'review'), routed to review"
            parts.append(F.array(failure(reason, REVIEW, False)))
            severity = None
        if name not in CHECKS:
            parts.append(F.array(failure(f"unknown validation check: {name!r}", REVIEW, False)))
            continue
        found = CHECKS[name](fields, rule, context)
        if severity is not None:
            found = _with_severity(found, severity)
        parts.append(found)
    return F.concat(*parts)


def verdict(failures: Column) -> Column:
    """Reject before review before auto."""
    has = lambda kind: F.exists(failures, lambda f: f["kind"] == kind)
    return F.when(has(REJECT), REJECT).when(has(REVIEW), REVIEW).otherwise(AUTO)


def reasons(failures: Column) -> Column:
    """Reject reasons, then review reasons, each in rule order."""
    of = lambda kind: F.transform(F.filter(failures, lambda f: f["kind"] == kind), lambda f: f["reason"])
    return F.concat(of(REJECT), of(REVIEW))


def evaluate(df: DataFrame, rules: list[dict], context: Context | None = None, fields_col: str = "fields") -> DataFrame:
    """``df`` with ``failures``, ``verdict`` and ``reasons``."""
    context = context or Context()
    joined = with_context(df, rules, context, fields_col)
    made = joined.withColumn("failures", failures_of(F.col(fields_col), rules, context))
    return made.select(*df.columns, "failures", verdict(F.col("failures")).alias("verdict"), reasons(F.col("failures")).alias("reasons"))


def flat_reasons(df: DataFrame, rules: list[dict], context: Context | None = None, fields_col: str = "fields") -> DataFrame:
    """``df`` with ``reasons`` alone, for gates that only ask whether checks pass: none means they do."""
    return evaluate(df, rules, context, fields_col).select(*df.columns, "reasons")
