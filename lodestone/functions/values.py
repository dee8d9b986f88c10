"""Values with their status, calculators with their guards, and answers drawn from statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import parse_date, parse_number
from lodestone.functions.vocabulary import METRIC_UNITS


def planned(raw: Column) -> Column:
    return raw.rlike("예정|잠정|계획")


def value_status(raw: Column, value_type: Column | str, metric: Column, withheld: Column) -> Column:
    """struct(status, certainty, numeric_value, date_value, text_value) of a cell.

    The first that holds decides: not applicable; a dash where a reason for withholding is given; a dash; a text that
    its type cannot read; else disclosed. ``withheld``: whether the table gives such a reason.
    """
    kind = F.lit(value_type) if isinstance(value_type, str) else value_type
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\((예정|잠정|계획)\)", ""))
    dash, number, day = text.rlike("^[-–—]?$"), parse_number(text), parse_date(text)
    missing = dash | ((kind == "NUMERIC") & number.isNull()) | ((kind == "DATE") & day.isNull())
    status = (
        F.when(text.rlike("(?i)^(해당없음|해당사항없음|해당 없음|해당사항 없음|비해당|n/?a)$"), "NOT_APPLICABLE")
        .when(dash & withheld & ~metric.startswith("WITHHELD_"), "WITHHELD")
        .when(missing, "MISSING")
        .otherwise("DISCLOSED")
    )
    open_ = status == "DISCLOSED"
    certainty = F.when(~open_, "NOT_RELEVANT").when(planned(F.coalesce(raw, F.lit(""))), "PLANNED").otherwise("CONFIRMED")
    return F.struct(
        status.alias("status"),
        certainty.alias("certainty"),
        F.when(open_ & (kind == "NUMERIC"), number).alias("numeric_value"),
        F.when(open_ & (kind == "DATE"), day).alias("date_value"),
        F.when(open_ & (kind == "TEXT"), text).alias("text_value"),
    )


def calculate(op: Column, inputs: Column, units: Column) -> Column:
    """struct(value, error) of SUM (one input or more), DIFF, RATIO or PERCENTAGE_CHANGE (exactly two, in order).

    error: the first of UNKNOWN_OPERATION, ARITY, NOT_FINITE, UNIT_MISMATCH, ZERO_DENOMINATOR.
    """
    n = F.size(inputs)
    a, b = F.try_element_at(inputs, F.lit(1)), F.try_element_at(inputs, F.lit(2))
    known = op.isin("SUM", "DIFF", "RATIO", "PERCENTAGE_CHANGE")
    error = (
        F.when(~known, "UNKNOWN_OPERATION")
        .when(((op == "SUM") & (n < 1)) | ((op != "SUM") & (n != 2)), "ARITY")
        .when(F.exists(inputs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE")
        .when(F.size(F.array_distinct(units)) > 1, "UNIT_MISMATCH")
        .when(((op == "RATIO") & (b == 0)) | ((op == "PERCENTAGE_CHANGE") & (a == 0)), "ZERO_DENOMINATOR")
    )
    value = (
        F.when(op == "SUM", F.aggregate(inputs, F.lit(0.0), lambda s, x: s + x))
        .when(op == "DIFF", a - b)
        .when(op == "RATIO", F.try_divide(a, b))
        .when(op == "PERCENTAGE_CHANGE", F.try_divide(b - a, a) * 100)
    )
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def effective(day: Column, known: Column, valid_from: Column, valid_to: Column, strict: bool = False) -> Column:
    """Whether a fact holds on a day: known by then and valid then; open ends are null. strict: known before that day."""
    is_known = (known.cast("date") < day) if strict else (known.cast("date") <= day)
    return is_known & (valid_from.isNull() | (valid_from <= day)) & (valid_to.isNull() | (valid_to >= day))


def answerability(statuses: Column) -> Column:
    """The answer that the statuses of all needed facts allow: withheld before not applicable before unanswerable."""
    return (
        F.when(F.array_contains(statuses, "WITHHELD"), "WITHHELD")
        .when(F.array_contains(statuses, "NOT_APPLICABLE"), "NOT_APPLICABLE")
        .when((F.size(statuses) == 0) | F.array_contains(statuses, "MISSING"), "UNANSWERABLE")
        .otherwise("SUPPORTED")
    )


def quote_resolves(text: Column, cells: Column, quote: Column) -> Column:
    """Whether the quote stands in the text or in one single cell."""
    return F.coalesce(text.contains(quote), F.lit(False)) | F.coalesce(F.exists(F.flatten(cells), lambda c: c.contains(quote)), F.lit(False))


def risk_flags(quote: Column, duplicate: Column, calculated: Column, in_table: Column) -> Column:
    """The reasons for which a quote may be weak evidence."""
    return F.array_compact(
        F.array(
            F.when(quote.rlike(r"^[\d\s\p{P}\p{S}]*$"), "NUMERIC_OR_SYMBOL_ONLY"),
            F.when(F.length(quote) <= 8, "SHORT_QUOTE"),
            F.when(duplicate, "DUPLICATE_QUOTE"),
            F.when(calculated, "CALCULATION_INPUT"),
            F.when(in_table, "TABLE_CELL"),
        )
    )


def risk_level(flags: Column) -> Column:
    return F.when(F.array_contains(flags, "NUMERIC_OR_SYMBOL_ONLY") | F.array_contains(flags, "CALCULATION_INPUT"), "CRITICAL").when(F.size(flags) > 0, "HIGH").otherwise("MEDIUM")


def metric_unit(metric: Column) -> Column:
    """struct(unit, currency, raw_unit, scale) of a metric's values; all null for metrics that are no numbers."""
    known = F.create_map(*(x for m, unit in METRIC_UNITS.items() for x in (F.lit(m), F.struct(*(F.lit(v).cast(k).alias(n) for (n, k), v in zip(_UNIT_FIELDS, unit, strict=True))))))
    none = F.struct(*(F.lit(None).cast(k).alias(n) for n, k in _UNIT_FIELDS))
    return F.coalesce(F.try_element_at(known, metric), none)


_UNIT_FIELDS = (("unit", "string"), ("currency", "string"), ("raw_unit", "string"), ("scale", "int"))


def ordered_intersection(claimed: Column, verified: Column) -> Column:
    """What of ``claimed`` is in ``verified``, each once, in the order of ``claimed``."""
    return F.array_distinct(F.filter(claimed, lambda x: F.coalesce(F.array_contains(verified, x), F.lit(False))))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def natural_key(text: Column) -> Column:
    """A key in Korean order without regard to case and accents, in which runs of digits count as numbers of any length.

    A number stands as its length and its digits, so a longer one comes later. The key is a collated string: sorts, groups
    and comparisons of it follow ICU's rules for Korean.
    """
    parts = F.regexp_extract_all(F.collate(text, "UTF8_BINARY"), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    whole = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 9, "0"), number(p))).otherwise(p))
    return F.collate(F.array_join(whole, ""), "ko_CI_AI")


def bounded(n: Column, most: int) -> Column:
    """Whether a limit may be asked for: a whole number from 1 to ``most`` (100 results of retrieval, 1,000 records)."""
    return F.coalesce(n.between(1, most) & (n == F.floor(n)), F.lit(False))
