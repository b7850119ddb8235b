import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stamps import with_stamp
from tidemark.operators.zones import normalise_stamps

CASES = {
    "29-Oct-08 12:30pm GMT": "2008-10-29 12:30:00",
    " 2-MAY-2019  12:05 a.m. ET ": "2019-05-02 04:05:00",
    "9-Jan-17 1:00am ET": "2017-01-09 06:00:00",
    "6 September 2012 15:30 BST": "2012-09-06 14:30:00",
    "Thursday, 28 December 2017 at 13:00 UTC": "2017-12-28 13:00:00",
    "March 22, 2013 11:30 a.m. ET": "2013-03-22 15:30:00",
    "2019-01-24T03:30:00.000+0530": "2019-01-23 22:00:00",
    "2019-06-11 14:00+01:00": "2019-06-11 13:00:00",
    "2019-07-16T13:30:00.000000Z": "2019-07-16 13:30:00",
    "03/04/2019 12:30 PM UTC": "2019-03-04 12:30:00",
    "15-May-19 10:00 JST": "2019-05-15 01:00:00",
    "12-jul-18 8:30am cst": "2018-07-12 14:30:00",
    "1556551800": "2019-04-29 15:30:00",
    "1556551800000": "2019-04-29 15:30:00",
    # no zone: the default
    "20190718140000": "2019-07-18 14:00:00",
    "2018/05/08 20:00": "2018-05-08 20:00:00",
    "11/05/2008 13:51": "2008-11-05 13:51:00",
    "22-Oct-18 4:00pm": "2018-10-22 16:00:00",
    # a clock that the New York day of the change does not have, or has twice
    "10-Mar-19 2:30am ET": "2019-03-10 07:30:00",
    "3-Nov-19 1:30am ET": "2019-11-03 05:30:00",
    # neither day nor time
    "TBD": None, "": None, None: None, "2016-01-07": None, "3-Jun-13": None, "0000-00-00 00:00": None, "31-Feb-12 1:00pm GMT": None,
    "1-Jul-19 time to be announced": None, "25:00": None, "2019-01-01 25:10": None, "x" * 5000: None, "99999999999999": None,
}


def test_spellings(spark):
    rows = list(CASES.items())
    df = spark.createDataFrame(rows, "stamp string, expected string")
    got = normalise_stamps(df, "stamp").select("stamp", "expected", F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("utc")).collect()
    assert len(got) == len(rows)
    assert {r.stamp: r.utc for r in got} == CASES


def test_missing_zone_is_estimated_from_contradictions(spark):
    rows = []
    for i in range(200):
        local = dt.datetime(2015 if i < 100 else 2016, 3, 1, i % 24, 0) + dt.timedelta(days=i % 100)
        zone = 9 if i < 100 else 0
        rows.append((local.strftime("%Y-%m-%d %H:%M:%S"), (local - dt.timedelta(hours=zone)).date(), (local - dt.timedelta(hours=zone)).hour))
    df = spark.createDataFrame(rows, "stamp string, day date, hour int")
    contradictions = lambda utc: [F.to_date(utc) != F.col("day"), F.hour(utc) != F.col("hour")]
    got = normalise_stamps(df, "stamp", contradictions=contradictions).collect()
    assert all((r.utc.date(), r.utc.hour) == (r.day, r.hour) for r in got)
    # a few contradictions are no reason to leave the default
    few = df.where("false").unionByName(spark.createDataFrame(rows[100:105], df.schema)).withColumn("hour", F.lit(3))
    assert all(r.stamp.startswith(str(r.utc)[:13]) for r in normalise_stamps(few, "stamp", contradictions=contradictions).collect())


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("1-Jan-10 1:00pm GMT", "a", "b", 1)], "stamp string, utc string, source string, minutes int")
    row = normalise_stamps(df, "stamp").first()
    assert str(row.utc) == "2010-01-01 13:00:00" and (row.source, row.minutes) == ("b", 1)
    assert normalise_stamps(df.where("false"), "stamp").count() == 0
    assert with_stamp(df, "stamp", "read").columns == [*df.columns, "read"]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("9-Jan-17 1:00am ET",)], "stamp string")
        assert str(normalise_stamps(df, "stamp").first().utc) == "2017-01-09 06:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
