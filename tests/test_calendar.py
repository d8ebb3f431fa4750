import pytest
from pyspark.sql import functions as F

from quern.functions import calendar


def test_prescription(spark):
    get = lambda *a: calendar.compute_prescription(spark, *a).first()
    assert get("written_contract")["years"] == 10 and get("forcible_entry_detainer")["years"] == 1 and get("other")["years"] == 5
    assert get("oral_contract", "2020-03-01")["deadline"] == "2026-03-01"
    assert get("oral_contract", "03/01/2020")["status"] == "invalid_date"
    assert get("defamation", "2020-02-29")["deadline"] == "2021-03-01"
    with pytest.raises(ValueError):
        get("nothing")


@pytest.mark.parametrize("text, wanted", [("2026-02-31", "2026-03-03"), ("2026-13-01", "2027-01-01"), ("2026-1-01", None), ("x", None), (None, None)])
def test_rollover(spark, text, wanted):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(calendar.rolled_date(F.col("t")), "yyyy-MM-dd").alias("d")).first()[0]
    assert got == wanted


def test_deadline(spark):
    get = lambda *a: calendar.compute_deadline(spark, *a).first()
    assert get("motion_new_trial", "2026-01-05")["last_day"] == "2026-01-20"
    assert get("motion_new_trial", "2026-01-17")["last_day"] == "2026-02-02"
    assert get("motion_new_trial", "2026-01-05", ["2026-01-20"])["last_day"] == "2026-01-21"
    assert get("appeal_certiorari_sc", "2026-01-05", [], 30)["total_days"] == 45
    assert get("motion_new_trial", "2026-01-05", ["soon"])["status"] == "invalid_date"
    many = [f"2026-01-{d}" for d in range(20, 32)]
    assert get("motion_new_trial", "2026-01-05", many)["last_day"] == "2026-02-02"
    with pytest.raises(ValueError):
        get("motion_new_trial", "2026-01-05", [], 5)


@pytest.mark.parametrize("total, wanted", [(360000.0, 30000.0), (180000.0, 15000.0), (60.06, 5.0), (1.5, 0.13)])
def test_thirteenth_month(spark, total, wanted):
    # 60.06 / 12 is a little under 5.005; 1.5 / 12 is exactly 0.125
    assert calendar.compute_13th_month(spark, total).first()["amount"] == wanted


def test_deadlines_of_courts_equal_a_walk_over_days(spark):
    import datetime as dt
    import random

    rng, start = random.Random(22), dt.date(2024, 2, 20)
    holidays = [(c, start + dt.timedelta(rng.randrange(90))) for c in ["a", "b", None] for _ in range(40)] + [("b", start + dt.timedelta(k)) for k in range(30)] + [("a", None)]
    rows = [(k, rng.choice(["a", "b", "c", None]), None if k % 17 == 0 else start + dt.timedelta(rng.randrange(90))) for k in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, court string, due date, day string")
    off = set(holidays)

    def walk(court, day):
        while day and (day.weekday() > 4 or (court, day) in off):
            day += dt.timedelta(1)
        return day

    got = {r["id"]: r["last_day"] for r in calendar.court_deadlines(df, spark.createDataFrame(holidays + holidays, "court string, day date")).collect()}
    assert got == {k: walk(c, d) for k, c, d in rows}
    none = spark.createDataFrame([], "court string, day date")
    assert calendar.court_deadlines(df.filter("id % 17 = 0"), none).filter("last_day IS NOT NULL").isEmpty()


def test_courts_that_never_work_are_as_in_the_sql(spark, tmp_path):
    """A court on holiday for more than the SQL's 200 days has no deadline; an order given twice has one."""
    import duckdb

    from quern.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT range AS o_orderkey, CASE WHEN range % 7 = 0 THEN 'b' ELSE 'a' END AS o_orderpriority, 'P' AS o_orderstatus, TIMESTAMP '1995-01-01' + to_days(CAST(range AS INT)) AS o_orderdate FROM range(400)")
    con.sql("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 50 = 0")
    con.sql(f"COPY orders TO '{tmp_path}/orders.parquet'")
    want = sorted(con.sql(f"SELECT o_orderkey, filing_type, last_day FROM ({ORACLES['deadline_by_court']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["deadline_by_court"](spark, str(tmp_path)).collect())
    assert got == want and 0 < len(want) < 400
