"""Column functions shared by the operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount) -> Column:
    """Whole cents, so that remainders and sums are exact."""
    return F.round(F.col(amount) * 100).cast("long") if isinstance(amount, str) else F.round(amount * 100).cast("long")


def money_sum(amount: str) -> Column:
    """A sum that does not depend on the rows' order: exact decimals, cast back at the end."""
    return F.sum(F.col(amount).cast("decimal(18,2)")).cast("double")


def alert_id(subject: Column, period: Column, rules: Column) -> Column:
    """Twenty digits from subject, period and fired rules."""
    name = F.concat_ws("|", subject, F.date_format(period, "yyyy-MM-dd"), F.array_join(rules, ","))
    return F.lpad(F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10), 20, "0")


def pseudonym(party: Column) -> Column:
    """The name that may be published for a party."""
    return F.concat(F.lit("Party-"), F.upper(F.substring(F.sha2(party, 256), 1, 10)))


def draw(*parts: Column) -> Column:
    """A reproducible 60-bit number from its parts, for shuffles and resampling."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def day_number(day: str | Column) -> Column:
    """Days since 1970-01-01, for calendar-range windows."""
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit("1970-01-01").cast("date"))
