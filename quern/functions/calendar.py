"""Deadlines, prescription periods and yearly pay as Spark columns."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.tables import written

# Years by kind of action, with the article they come from.
PRESCRIPTION = [
    ("written_contract", 10, "Art. 1144(1)"),
    ("obligation_created_by_law", 10, "Art. 1144(2)"),
    ("judgment", 10, "Art. 1144(3)"),
    ("oral_contract", 6, "Art. 1145(1)"),
    ("quasi_contract", 6, "Art. 1145(2)"),
    ("injury_to_rights", 4, "Art. 1146(1)"),
    ("quasi_delict", 4, "Art. 1146(2)"),
    ("forcible_entry_detainer", 1, "Art. 1147(1)"),
    ("defamation", 1, "Art. 1147(2)"),
    ("other", 5, "Art. 1149"),
]

# Days by kind of filing, with the rule they come from.
FILINGS = [
    ("motion_new_trial", 15, "Rule 37, Sec. 1"),
    ("motion_reconsideration", 15, "Rule 37, Sec. 1"),
    ("appeal_rtc_to_ca", 15, "Rule 41, Sec. 3(a)"),
    ("appeal_rtc_to_ca_record_on_appeal", 30, "Rule 41, Sec. 3(a)"),
    ("appeal_certiorari_sc", 15, "Rule 45, Sec. 2"),
    ("certiorari_prohibition_mandamus", 60, "Rule 65, Sec. 4"),
]
EXTENDABLE, MOST_EXTENSION = "appeal_certiorari_sc", 30
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def prescription_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESCRIPTION, "action_type string, years int, article string")


def filing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILINGS, "filing_type string, base_days int, rule string")


def _once(value: Column, use) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rolled(y: Column, m: Column, d: Column) -> Column:
    """The date of three numbers, where days and months past the end roll over; years under 100 are of the 20th century."""
    y = F.when(y < 100, y + 1900).otherwise(y)
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def rolled_date(text: Column) -> Column:
    """The date of a strict ``YYYY-MM-DD`` text; else null."""
    numbers = F.split(text, "-").cast("array<int>")
    return F.when(text.rlike(ISO_DATE), _once(numbers, lambda n: _rolled(n[0], n[1], n[2])))


def years_later(start: Column, years: Column) -> Column:
    """Same month and day some years after a date; February 29 becomes March 1 of a common year."""
    return _rolled(F.year(start) + years, F.month(start), F.dayofmonth(start))


def prescription_deadline(date_text: Column, years: Column) -> Column:
    """``years_later`` than a strict ISO text; else null."""
    return years_later(rolled_date(date_text), years)


def next_working_day(day: Column, holidays: Column) -> Column:
    """``day``, or the first later day that is no Saturday, Sunday or holiday (an array of ISO texts)."""
    horizon = F.date_add(day, 2 * F.size(holidays) + 4)
    open_days = F.filter(F.sequence(day, horizon), lambda x: F.weekday(x) < 5)
    free = F.array_except(open_days, F.transform(holidays, lambda h: h.try_cast("date")))  # keeps the order of days
    return F.try_element_at(free, F.lit(1))


def filing_deadline(notice_text: Column, days: Column, holidays: Column) -> Column:
    """The last day to file: the notice day is not counted, and a last day off rolls forward. Null if the notice or a holiday is no ISO date."""
    good = F.forall(holidays, lambda h: h.rlike(ISO_DATE))
    return F.when(good, _once(F.date_add(rolled_date(notice_text), days), lambda day: next_working_day(day, holidays)))


def court_calendar(courts: DataFrame, holidays: DataFrame, first: Column, last: Column) -> DataFrame:
    """(court, day, open, number): each day from ``first`` to ``last``, whether its court works, and how many days it has worked by then.

    ``courts`` (court) and ``holidays`` (court, day) may repeat rows; a court without holidays is closed at weekends only. A court has a row a day,
    so the running count is over a few ten thousand rows.
    """
    days = courts.select("court").distinct().select("court", F.explode(F.sequence(first, last)).alias("day"))
    off = holidays.select("court", F.col("day").cast("date").alias("day")).filter("day IS NOT NULL").distinct().withColumn("off", F.lit(True))
    same = days["court"].eqNullSafe(off["court"]) & (days["day"] == off["day"])
    known = days.join(off, same, "left").select(days["court"], days["day"], ((F.weekday(days["day"]) < 5) & F.col("off").isNull()).alias("open"))
    return known.withColumn("number", F.sum(F.col("open").cast("int")).over(Window.partitionBy("court").orderBy("day")))


def court_deadlines(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    """``rows`` (with ``court`` and ``due``, a date) with ``last_day``: the day itself if its court works then, else the first later day on which it does.

    Two equi-joins with the courts' calendar, by day and by number of the working day; no days are listed for each row. A null due date has no last day.
    """
    reach = rows.agg(F.min("due").alias("low"), F.max("due").alias("high")).first()
    if reach["low"] is None:
        return rows.withColumn("last_day", F.lit(None).cast("date"))
    most = holidays.groupBy("court").agg(F.countDistinct("day").alias("n")).agg(F.max("n")).first()[0] or 0
    last = F.date_add(F.lit(reach["high"]), 7 * (most + 2))  # in so many days each court works at least once
    known = written(court_calendar(rows.select("court"), holidays.select("court", "day"), F.lit(reach["low"]), last))
    key = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("court"))  # noqa: E731  null is a court too
    by_day = known.select(key(F.col("court")).alias("_court"), F.col("day").alias("due"), (F.col("number") + F.when(F.col("open"), 0).otherwise(1)).alias("_number"))
    by_number = known.filter("open").select(key(F.col("court")).alias("_court"), F.col("number").alias("_number"), F.col("day").alias("last_day"))
    return rows.withColumn("_court", key(F.col("court"))).join(by_day, ["_court", "due"], "left").join(by_number, ["_court", "_number"], "left").drop("_court", "_number").select(*rows.columns, "last_day")


@F.pandas_udf(T.StringType())
def to_fixed_2(values: pd.Series) -> pd.Series:
    """Two decimals of the exact binary value, half up: 1.005 is a little less than it looks. Nothing built in rounds that value, hence Python's decimals, in Arrow batches."""
    return values.map(lambda x: None if pd.isna(x) else str(Decimal(float(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)))


def thirteenth_month(total: Column) -> Column:
    """A twelfth of the year's basic pay, with two decimals as text; null for negative totals."""
    return F.when(total >= 0, to_fixed_2(total / 12))


def compute_prescription(spark: SparkSession, action_type: str, date: str | None = None) -> DataFrame:
    """One row: status, years, article, cause_of_action_date, deadline."""
    known = prescription_table(spark).filter(F.col("action_type") == action_type)
    if action_type not in {k for k, _, _ in PRESCRIPTION}:
        raise ValueError(f"no action type {action_type!r}")
    out = known.withColumn("cause_of_action_date", F.lit(date).cast("string"))
    deadline = prescription_deadline(F.col("cause_of_action_date"), F.col("years"))
    bad = F.col("cause_of_action_date").isNotNull() & deadline.isNull()
    return out.select(F.when(bad, "invalid_date").otherwise("ok").alias("status"), "action_type", "years", "article", "cause_of_action_date", F.date_format(deadline, "yyyy-MM-dd").alias("deadline"))


def compute_deadline(spark: SparkSession, filing_type: str, notice_date: str, holidays: list[str] | None = None, extension_days: int | None = None) -> DataFrame:
    """One row: status, rule, base_days, extension_days, total_days, last_day."""
    if filing_type not in {k for k, _, _ in FILINGS}:
        raise ValueError(f"no filing type {filing_type!r}")
    if extension_days is not None and not 1 <= extension_days <= MOST_EXTENSION:
        raise ValueError(f"an extension has 1 to {MOST_EXTENSION} days")
    extra = extension_days or 0
    if extra and filing_type != EXTENDABLE:
        raise ValueError(f"only {EXTENDABLE} can be extended")
    out = filing_table(spark).filter(F.col("filing_type") == filing_type).withColumns({"notice": F.lit(notice_date), "holidays": F.lit(holidays or []).cast("array<string>")})
    last = filing_deadline(F.col("notice"), F.col("base_days") + extra, F.col("holidays"))
    return out.select(F.when(last.isNull(), "invalid_date").otherwise("ok").alias("status"), "filing_type", "rule", "base_days", F.lit(extra).alias("extension_days"), (F.col("base_days") + extra).alias("total_days"), F.date_format(last, "yyyy-MM-dd").alias("last_day"))


def compute_13th_month(spark: SparkSession, total_basic_salary: float) -> DataFrame:
    """One row: total_basic_salary, amount."""
    if total_basic_salary < 0:
        raise ValueError("a salary is not negative")
    return spark.createDataFrame([(float(total_basic_salary),)], "total_basic_salary double").withColumn("amount", thirteenth_month(F.col("total_basic_salary")).cast("double"))
