"""Generator day numbers and the date dimension's parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's calendar starts on 1992-01-01 and spans 2,557 days;
# orders are dated up to 151 days (121 ship + 30 receipt) before the end;
# line status flips on 1995-06-17; time keys count days from 1970-01-01 (+1).
START_DATE = dt.date(1992, 1, 1)
TOTAL_DAYS = 2557
CURRENT_DATE = dt.date(1995, 6, 17)
ORDER_DATE_MAX = START_DATE + dt.timedelta(days=TOTAL_DAYS - 151 - 1)
T_START_DAY = 3


def day_to_date(n) -> Column:
    """Generator day ``n`` (1 = 1992-01-01) to DATE."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.date_add(F.lit(START_DATE), (n - 1).cast("int"))


def julian(d: Column) -> Column:
    """``yyddd``: two-digit year offset from 1900, then day of year."""
    return (F.year(d) - 1900) * 1000 + F.dayofyear(d)


def unjulian(yyddd: Column) -> Column:
    """Inverse of ``julian``."""
    year = F.floor(yyddd / 1000) + 1900
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)),
                      (yyddd % 1000 - 1).cast("int"))


def date_parts(d: Column) -> list[Column]:
    """Time key, text, year, month index, week of year, day of month."""
    return [
        (F.datediff(d, F.lit(dt.date(1970, 1, 1))) + 1).alias("t_timekey"),
        F.date_format(d, "yyyy-MM-dd").alias("t_alpha"),
        F.year(d).alias("t_year"),
        ((F.year(d) - 1970) * 12 + F.month(d)).alias("t_month"),
        (F.floor((F.dayofyear(d) + T_START_DAY - 1) / 7) + 1).cast("int").alias("t_week"),
        F.dayofmonth(d).alias("t_day"),
    ]
