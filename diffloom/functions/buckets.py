"""Calendar buckets of timestamps: day, week, half month, month, quarter, labelled as calendar libraries do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("D", "W", "SME", "ME", "QE")


def bucket(ts: Column, rule: str) -> Column:
    """The label, a date, of the bucket that holds ``ts``.

    D is the day; W its week, labelled by the Sunday that ends it; SME the half month, labelled by the 15th or month's
    end that begins it; ME and QE month and quarter, labelled by their last day. Null stays null.
    """
    day = F.to_date(ts)
    if rule == "D":
        return day
    if rule == "W":
        return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    if rule == "SME":
        middle = F.make_date(F.year(day), F.month(day), F.lit(15))
        return F.when(day == F.last_day(day), day).when(F.dayofmonth(day) >= 15, middle).otherwise(F.last_day(F.add_months(day, -1)))
    if rule == "ME":
        return F.last_day(day)
    if rule == "QE":
        return F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", ts)), 2))
    raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")


def spine(first: Column, last: Column, rule: str) -> Column:
    """The array of all labels from ``first`` to ``last``, both labels of ``rule``; null if either is."""
    if rule in ("D", "W"):
        return F.sequence(first, last, F.expr(f"INTERVAL {1 if rule == 'D' else 7} DAYS"))
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr(f"INTERVAL {3 if rule == 'QE' else 1} MONTHS"))
    if rule != "SME":
        return F.transform(months, F.last_day)
    both = F.flatten(F.transform(months, lambda m: F.array(F.date_add(m, 14), F.last_day(m))))
    return F.filter(both, lambda d: (d >= first) & (d <= last))
