"""Scalar functions on columns (F1 to F26): none raises on bad input, unreadable values are null."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status fragments in the order in which they are tried.
STATUS_FRAGMENTS = (
    ("unrealiz", "Unrealized"), ("unrealis", "Unrealized"), ("partial", "Unrealized"), ("active", "Unrealized"), ("current", "Unrealized"),
    ("writ", "Realized"), ("realiz", "Realized"), ("realis", "Realized"), ("exited", "Realized"), ("divested", "Realized"), ("sold", "Realized"),
)
# Formats of dates in text, in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "yyyy-M-d H:m:s")
# Blank tokens of the different rules.
DATE_BLANKS = ("", "-", "n/a", "N/A", "#N/A")
NUMBER_BLANKS = ("", "-", "n/a", "N/A", "#N/A", "#VALUE!", "#REF!", "#DIV/0!")
ROW_BLANKS = ("", "-", "n/a", "N/A", "#N/A", "nan", "NaT")
LABEL_BLANKS = ("", "none", "nan", "nat", "-")

# Thresholds of the nine bucketings, and how a label shows a bound.
THRESHOLDS = {
    "hold": (2, 4, 6, 8),
    "ic": (250, 500, 1000, 1250, 1500),
    "moic": (1.0, 2.0, 3.0),
    "ebitda": (0, 100, 200, 300, 400),
    "revenue": (0, 250, 500, 1000, 1500),
    "entry_ev": (0, 500, 1000, 1500, 2000),
    "entry_multiple": (0, 5, 10, 15, 20),
    "entry_margin": (0.2, 0.3, 0.4, 0.5),
    "irr": (0.0, 0.1, 0.2),
}
_STYLES = {
    "hold": ("{} yrs", "{} yrs", " "),
    "ic": ("${}m", "${}", ""), "ebitda": ("${}m", "${}", ""), "revenue": ("${}m", "${}", ""), "entry_ev": ("${}m", "${}", ""),
    "moic": ("{:.1f}x", "{:.1f}x", ""), "entry_multiple": ("{}x", "{}x", ""),
    "entry_margin": ("{:.0%}", "{:.0%}", ""), "irr": ("{:.0%}", "{:.0%}", ""),
}
#: Bucketings that show a missing value as a label of its own.
SHOWS_MISSING = ("moic", "irr")


def bucket_labels(kind: str, thresholds: tuple | None = None) -> list[str]:
    """Labels from the first, open bucket to the last."""
    t = thresholds or THRESHOLDS[kind]
    full, low, space = _STYLES[kind]
    between = [f"{low.format(a)}{space} - {full.format(b)}" for a, b in zip(t, t[1:])]
    return [f"<={full.format(t[0])}", *between, f">={full.format(t[-1])}"]


def bucket(value: Column, kind: str, thresholds: tuple | None = None) -> Column:
    """The first bucket whose threshold is not below the value; missing is null, or n/a where it shows."""
    t = thresholds or THRESHOLDS[kind]
    labels = bucket_labels(kind, t)
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    out = F.when(~known, F.lit("n/a" if kind in SHOWS_MISSING else None))
    for bound, label in zip(t, labels):
        out = out.when(value <= bound, label)
    return out.otherwise(labels[-1])


def normalise_status(raw: Column) -> Column:
    """Realized or Unrealized by the first fragment found; Unrealized if none is."""
    s, out = F.lower(F.trim(raw)), None
    for part, state in STATUS_FRAGMENTS:
        out = F.when(s.contains(part), state) if out is None else out.when(s.contains(part), state)
    return out.otherwise("Unrealized")


def to_date(raw: Column) -> Column:
    """a date from mixed text, by the first format that reads the whole of it."""
    s = F.trim(raw.cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]
    return F.when(~s.isin(*DATE_BLANKS), F.coalesce(*tries).cast("date"))


def to_number(raw: Column) -> Column:
    """a number from text, without thousands commas, percent signs and a trailing x; 25% is 25."""
    s = F.trim(raw.cast("string"))
    bare = F.translate(s, ",%", "")
    n = F.when(bare.contains("x"), F.regexp_replace(bare, "x+$", "")).otherwise(bare).try_cast("double")
    return F.when(~s.isin(*NUMBER_BLANKS), F.nanvl(n, F.lit(None).cast("double")))


def hold_period(entry: Column, exit_: Column) -> Column:
    """years of 365 days."""
    return F.datediff(exit_, entry) / 365


def divide(a: Column, b: Column) -> Column:
    """null where the divisor is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(value: Column, places: int) -> Column:
    """A double to places, halves away from zero: scaled, rounded to a whole number and scaled back, as SQL does.

    F.round goes by the digits that print the double, which gives another last bit where it holds fewer than places.
    """
    return F.round(value * 10.0**places) / 10.0**places


def to_decimal(value: Column, digits: int = 30, places: int = 7) -> Column:
    """A double as a decimal, scaled as in rounded(); null beyond digits.

    A cast goes by the digits that print the double. The whole number that the scaled double is stands here in two
    exact parts, of which the lower has 40 bits; that holds for 30 digits.
    """
    whole = F.round(value * 10.0**places)
    high = F.floor(whole / 2.0**40)
    low = (whole - high.cast("double") * 2.0**40).cast("long")
    units = (high.cast("decimal(19,0)") * F.lit(Decimal(2**40)) + low.cast("decimal(13,0)")).cast(f"decimal({digits},0)")
    return F.when(F.abs(whole) < 10.0**digits, (units * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal({digits},{places})"))


def cagr(start: Column, end: Column, years: Column) -> Column:
    """F16: yearly growth where both ends and the years are positive."""
    return F.when((start > 0) & (end > 0) & (years > 0), F.pow(divide(end, start), F.try_divide(F.lit(1.0), years.cast("double"))) - 1)


def cagr_of_ratio(start: Column, end: Column, years: Column) -> Column:
    """F16 as the operating reports have it: the ratio is positive and the years are not 0."""
    ratio = divide(end, start)
    return F.when((ratio > 0) & (years != 0), F.pow(ratio, F.try_divide(F.lit(1.0), years.cast("double"))) - 1)


def currency_guard(raw: Column) -> Column:
    """null for numbers and for more than 12 characters."""
    s = F.trim(raw)
    number = F.regexp_replace(s, ",", "").try_cast("double").isNotNull()
    return F.when(~number & (F.length(s) <= 12) & (s != ""), s)


def coi_flag(raw: Column) -> Column:
    """Yes, No, or n/a where missing."""
    return F.when(raw.isNull(), "n/a").when(F.lower(F.trim(raw)).isin("yes", "y", "true", "1"), "Yes").otherwise("No")


def valuation_method(raw: Column) -> Column:
    """F19."""
    return F.when(~raw.isin("-", "None", "none"), raw)


def company_not_fund(company: Column, funds: Column) -> Column:
    """null where the company is one of the array of fund names."""
    return F.when(~F.coalesce(F.array_contains(funds, F.trim(company)), F.lit(False)), company)


def unique_id(company: Column, fund: Column) -> Column:
    """F21."""
    return F.concat(company, F.lit("-"), fund)


def label(raw: Column) -> Column:
    """null for blank labels."""
    s = F.trim(raw)
    return F.when(~F.lower(s).isin(*LABEL_BLANKS), s)


def finite(raw: Column) -> Column:
    """null for NaN and infinities."""
    d = raw.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def scaled(value: Column, factor: Column) -> Column:
    """F23."""
    return value * F.coalesce(factor, F.lit(1.0))


def with_default(value: Column, default: Column) -> Column:
    """F24."""
    return F.coalesce(value, default)


def clean_header(raw: Column) -> Column:
    """white space collapsed."""
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def column_name(raw: Column) -> Column:
    """footnotes of small letters or digits in parentheses gone, white space collapsed, lower case."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\(([a-z]+|[0-9]+)\)", "")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def is_blank(raw: Column) -> Column:
    """Blank in the sense of row cleaning."""
    return raw.isNull() | F.trim(raw.cast("string")).isin(*ROW_BLANKS)


def is_number(raw: Column) -> Column:
    """A number once commas, percent, x and currency signs are gone."""
    s = F.trim(raw.cast("string"))
    n = F.regexp_replace(s, "[,%x€$]", "").try_cast("double")
    return F.coalesce(~s.isin("", "-", "n/a", "N/A", "#N/A") & n.isNotNull() & ~F.isnan(n), F.lit(False))
