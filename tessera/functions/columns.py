"""Column helpers shared by every operator: missing values, ratios, calendar, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Spellings that mean "missing" in imported text.
MISSING_TOKENS = ["", "nan", "none", "nat", "null", "<na>"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Report rounding. A nudge far below the last digit makes halves fall the same way in whatever order a sum was
    taken; adding 0.0 keeps a negative zero out of results."""
    return F.round(col(c) + F.lit(10.0 ** -(digits + 4)), digits) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or missing."""
    return F.try_divide(col(a), col(b))


def change(now: Column | str, before: Column | str) -> Column:
    return ratio(now, before) - 1


#: Relative changes that sums over large groups lose or gain by the order they are taken in.
NOISE = 1e-9


def without_noise(c: Column) -> Column:
    """A relative change, zero where it is no more than the rounding of sums."""
    return F.when(F.abs(c) < NOISE, 0.0).otherwise(c)


def blank_to_null(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.when(~F.lower(text).isin(MISSING_TOKENS), text)


def first_nonblank(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def falsy_or(*cols: Column | str) -> Column:
    """First value that is neither missing nor zero; the last one is returned as it is."""
    *head, tail = cols
    return F.coalesce(*[zero_to_null(c) for c in head], col(tail))


def clip(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp to [low, high] keeping NULL (greatest/least would skip it)."""
    value = col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def differs(a: Column | str, b: Column | str) -> Column:
    return ~col(a).eqNullSafe(col(b))


def rule_names(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules that hold for a row, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


# --- calendar -----------------------------------------------------------------------------

def month_end(d: Column | str) -> Column:
    return F.last_day(col(d))


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "quarter"), 2))


def year_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "year"), 11))


def week_friday(d: Column | str) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(col(d), 1), "Fri")


def quarter_ordinal(d: Column | str) -> Column:
    return F.year(col(d)) * 4 + F.quarter(col(d))


def is_quarter_end(d: Column | str) -> Column:
    return (F.month(col(d)) % 3 == 0) & (F.last_day(col(d)) == col(d))


def period_of(d: Column | str, frequency: str) -> Column:
    return {
        "month": month_end,
        "quarter": quarter_end,
        "year": year_end,
        "week": week_friday,
    }[frequency](d)


def last_completed_quarter(today: Column) -> Column:
    end = quarter_end(today)
    return F.when(end <= today, end).otherwise(F.date_sub(F.trunc(today, "quarter"), 1))


# --- text ---------------------------------------------------------------------------------

# Accented letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold_text(c: Column | str) -> Column:
    """Lower-case ASCII form with single spaces."""
    plain = F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def money(c: Column | str) -> Column:
    """'$1,234.50', '2.5K', '3M', '1B' to a number."""
    text = F.upper(F.regexp_replace(col(c), r"[$,\s]", ""))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)[KMB]?$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([KMB])$", 1)
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
