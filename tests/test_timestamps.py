import pytest
from pyspark.sql import functions as F

from kinloom.operators.timestamps import candidates, normalize_timestamps

CASES = [
    ("1950-02-05", None, "ok", ["1950-02-05"]),
    ("１９７３-０５-２８", None, "ok", ["1973-05-28"]),
    ("13/02/1994", None, "ok", ["1994-02-13"]),
    ("08/02/1994", None, "ok", ["1994-02-08", "1994-08-02"]),
    ("05/05/1994", None, "ok", ["1994-05-05"]),
    ("31/02/1994", None, "invalid", []),
    ("1967-366x", None, "no_day", []),
    ("1980-366", None, "ok", ["1980-12-31"]),
    ("1981-366", None, "invalid", []),
    ("1974-W08-7", None, "ok", ["1974-02-24"]),
    ("le 1er juin 1986", None, "ok", ["1986-06-01"]),
    ("14. März 2010, 08:22 Uhr", "Europe/Berlin", "ok", ["2010-03-14T07:22:00Z"]),
    ("2012-12-09 12:08 EST", "America/New_York", "ok", ["2012-12-09T17:08:00Z"]),
    ("2012-12-09 12:08 EST", "Europe/Berlin", "ambiguous", []),
    ("2010-03-28 02:30", "Europe/Berlin", "dst", []),
    ("2010-10-31 02:30", "Europe/Berlin", "dst", []),
    ("2010-10-31 02:30 CEST", "Europe/Berlin", "ok", ["2010-10-31T00:30:00Z"]),
    ("2015-02-25 13:53:36 America/Chicago", None, "ok", ["2015-02-25T19:53:36Z"]),
    ("1200663173", None, "ok", ["2008-01-18T13:32:53Z"]),
    ("1650365012168", None, "ok", ["2022-04-19T10:43:32Z"]),
    ("1996-04-12T25:10:00Z", None, "invalid", []),
    ("approx. 1994", None, "no_day", []),
    ("", None, "empty", []),
    (None, None, "empty", []),
]


@pytest.mark.parametrize("raw,zone,status,forms", CASES)
def test_readings(raw, zone, status, forms):
    got, found = candidates(raw, zone)
    assert (got, [f for _, f in found if f]) == (status, forms)


def test_open_orders_take_the_desk(spark):
    desks = spark.createDataFrame([("d", "UTC", "dmy"), ("m", "UTC", "mdy")], "source string, zone string, order string")
    rows = spark.createDataFrame([(1, "01/02/1990", "d"), (2, "01/02/1990", "m"), (3, "01/02/1990", None), (3, "01/02/1990", None), (4, "13/02/1990", "m"), (5, None, "d"), (None, "1990-01-01", "d")], "id int, v string, s string")
    got = {r.key: (r.status, r.normal_form) for r in normalize_timestamps(rows.withColumn("status", F.lit("x")), desks, "id", "v", "s").collect()}
    assert got == {1: ("ok", "1990-02-01"), 2: ("ok", "1990-01-02"), 3: ("ambiguous", None), 4: ("ok", "1990-02-13"), 5: ("empty", None)}
    assert normalize_timestamps(rows.limit(0), desks, "id", "v", "s").count() == 0


def test_many_values_outweigh_a_declared_order(spark):
    desks = spark.createDataFrame([("m", "UTC", "mdy"), ("few", "UTC", "mdy")], "source string, zone string, order string")
    rows = [(i, f"{13 + i % 15}/02/{1950 + i % 50}", "m") for i in range(3000)] + [(9000, "03/04/1990", "m"), (9001, "03/04/1990", "few"), (9002, "13/02/1990", "few")]
    got = {r.key: r for r in normalize_timestamps(spark.createDataFrame(rows, "id int, v string, s string"), desks, "id", "v", "s").where("key >= 9000").collect()}
    # under equal weights the declaration alone would give 1990-03-04 at both desks
    assert (got[9000].status, got[9000].normal_form, got[9000].label) == ("ok", "1990-04-03", "dmy")
    assert (got[9001].status, got[9001].normal_form) == ("ok", "1990-03-04")
    some = [(i, f"{13 + i % 15}/02/{1950 + i % 50}", "m") for i in range(60)] + [(9000, "03/04/1990", "m")]
    open_ = normalize_timestamps(spark.createDataFrame(some, "id int, v string, s string"), desks, "id", "v", "s").where("key = 9000").first()
    assert open_.status == "ambiguous" and open_.normal_form is None and sorted(open_.alternatives) == ["1990-03-04", "1990-04-03"]
