"""Column expressions that the operators share. All stay inside generated code; none is a Python function at run time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Terms of the error function's series (arguments below 2) and levels of its continued fraction (from 2 on): enough for 12 digits.
SERIES, LEVELS = 45, 60


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Half-even rounding, as in numpy; a negative zero counts as zero."""
    return F.bround(c(x), digits) + F.lit(0.0)


def exact_mean(x: Column | str) -> Column:
    """Mean of values below 100 in size by decimal sums: the order of adding leaves no trace that could tip a rounding. Values that are no numbers give the plain mean."""
    plain = F.count_if(F.isnan(c(x)) | (F.abs(c(x)) >= 100)) > 0
    return F.when(plain, F.avg(c(x))).otherwise(F.avg(c(x).try_cast("decimal(20,18)")).cast("double"))


def nan_to_null(x: Column | str) -> Column:
    """NaN compares greater than all numbers, so it is taken out where data come in."""
    return F.when(~F.isnan(c(x)), c(x))


def two_sided_p(z: Column | str) -> Column:
    """2 (1 - Phi(|z|)), that is erfc(|z| / sqrt 2), with relative accuracy: small p-values keep their digits.

    Few rows have p-values, so folds over short arrays do; nothing is nested in the generated code.
    """
    x = F.abs(c(z).cast("double")) / F.sqrt(F.lit(2.0))
    steps = lambda n: F.array(*[F.lit(float(k)) for k in n])
    first = F.struct(x.alias("term"), x.alias("sum"))

    def add(acc, k):
        term = acc["term"] * (2 * x * x) / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    near = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * F.aggregate(steps(range(1, SERIES)), first, add)["sum"]
    far = F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / F.aggregate(steps(range(LEVELS, 0, -1)), x, lambda acc, k: x + k / 2 / acc)
    return F.when(x < 2, near).when(x.isNotNull(), far)


def digamma(n: Column | str) -> Column:
    """The logarithmic derivative of the gamma function for numbers of at least 1: ten steps up, then the asymptotic series (12 digits)."""
    x = c(n).cast("double") + 10
    steps = sum((1 / (x - i) for i in range(1, 11)), F.lit(0.0))
    return F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0))) + 1 / (240 * F.pow(x, F.lit(8.0))) - steps


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is null or not positive."""
    return F.when(c(b) > 0, c(a) / c(b))


def clipped(x: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Clipping that keeps nulls (least and greatest alone would not)."""
    out = c(x)
    out = out if low is None else F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    out = out if high is None else F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(c(x).isNotNull(), out)


def logit(p: Column | str, eps: float = EPS) -> Column:
    q = clipped(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def not_negative(x: Column | str) -> Column:
    return F.when(c(x) >= 0, c(x))


def differs(x: Column | str, value: object) -> Column:
    """x != value where null differs too."""
    return ~c(x).eqNullSafe(F.lit(value))


def row_sum(*cols: Column | str) -> Column:
    """Sum over columns; null if all are null."""
    some = reduce(lambda a, b: a | b, [c(x).isNotNull() for x in cols])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols]))


def first_group(x: Column | str, pattern: str) -> Column:
    """First group of a pattern; null instead of an empty string where nothing matches."""
    return F.nullif(F.regexp_extract(c(x), pattern, 1), F.lit(""))


def padded(x: Column | str, width: int) -> Column:
    """Zeros to the left; longer texts stay as they are."""
    return F.when(F.length(c(x)) < width, F.lpad(c(x), width, "0")).otherwise(c(x))


def ordinal(x: Column | str, levels: list[str]) -> Column:
    """Place (from 1) in a list of levels; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), c(x)), F.lit(0)).cast("int")


def has_text(x: Column | str) -> Column:
    return (c(x).isNotNull() & (F.trim(c(x)) != "")).cast("int")


def equals_flag(x: Column | str, value: str) -> Column:
    return F.coalesce((F.trim(c(x)) == value).cast("int"), F.lit(0))


def month(x: Column | str) -> Column:
    return F.trunc(c(x), "MM")


def month_label(x: Column | str) -> Column:
    return F.date_format(c(x), "yyyy-MM")


def months_of(x: Column | str) -> Column:
    return F.year(c(x)) * 12 + F.month(c(x))


def months_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole months by calendar; null if negative."""
    return not_negative(months_of(later) - months_of(earlier))


def parsed_day(x: Column | str) -> Column:
    """'YYYY-MM-DD' or 'dd-mm-YYYY' to a date; null where it is neither."""
    return F.coalesce(F.to_date(F.try_to_timestamp(c(x), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(c(x), F.lit("dd-MM-yyyy"))))


def numeric(x: Column | str) -> Column:
    """A number; null where the text is none."""
    return F.trim(c(x)).try_cast("double")


def plain(x: Column | str) -> Column:
    """Lower case without outer blanks; hard blanks count as blanks."""
    return F.lower(F.trim(F.replace(c(x), F.lit("\u00a0"), F.lit(" "))))


def years_employed(x: Column | str) -> Column:
    """'< 1 year' is 0, 'n/a' null, else the first number."""
    text = F.trim(c(x))
    return F.when(text == "< 1 year", 0).when(text == "n/a", None).otherwise(first_group(text, r"(\d+)").cast("int"))


def looked_up(x: Column | str, table: dict[str, object]) -> Column:
    """The table's value; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), c(x))


def parsed_month(x: Column | str) -> Column:
    """'Mon-YYYY' to the first of the month; null where it can't be read."""
    return F.to_date(F.try_to_timestamp(c(x), F.lit("MMM-yyyy")))


def bins_left(x: Column | str, edges: Column) -> Column:
    """Number of edges below x."""
    return F.size(F.filter(edges, lambda e: e < c(x)))


def bins_right(x: Column | str, edges: Column) -> Column:
    """Number of edges at or below x."""
    return F.size(F.filter(edges, lambda e: e <= c(x)))


def tertile(x: Column | str, q1: Column, q2: Column) -> Column:
    return F.when(c(x) <= q1, "Low").when(c(x) <= q2, "Medium").when(c(x).isNotNull(), "High")
