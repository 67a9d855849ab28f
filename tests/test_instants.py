from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.operators.instants import resolve_instants

DEVICES = [("b", "Europe/Berlin", "dmy", date(2022, 8, 17)), ("n", "America/New_York", "mdy", date(2022, 9, 16)), ("l", "Australia/Lord_Howe", "dmy", date(2023, 1, 9)), ("z", None, "dmy", date(2022, 12, 9)), ("o", "UTC", None, date(2022, 1, 1))]


def utc(*a, zone="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp())


# device, date, time, instant or status
CASES = [
    ("b", None, "2023-06-03T04:00:11.719", utc(2023, 6, 3, 4, 0, 11, zone="Europe/Berlin")),
    ("b", None, " 2023-06-03 04:00 ", utc(2023, 6, 3, 4, 0, 0, zone="Europe/Berlin")),
    ("z", None, "3 Mar 2022 18:39:53 PST", utc(2022, 3, 4, 2, 39, 53)),
    ("z", None, "20230817T201622Z", utc(2023, 8, 17, 20, 16, 22)),
    ("n", None, "20230817201622", utc(2023, 8, 17, 20, 16, 22, zone="America/New_York")),
    ("b", "2023-07-04", "10:20:29+05:30", utc(2023, 7, 4, 4, 50, 29)),
    ("b", "2023-07-04", "10:20:29 -0330", utc(2023, 7, 4, 13, 50, 29)),
    ("b", None, "2023-02-30 05:23:22", "no such date or time"),
    ("b", None, "2024-02-29 05:23:22", utc(2024, 2, 29, 5, 23, 22, zone="Europe/Berlin")),
    ("b", "20221031", "12:23:59 pm", utc(2022, 10, 31, 12, 23, 59, zone="Europe/Berlin")),
    ("b", "20221031", "12:23:59 am", utc(2022, 10, 31, 0, 23, 59, zone="Europe/Berlin")),
    ("b", "20221031", "13:23:59 pm", "no such date or time"),
    ("b", "01.06.2022", "050456", utc(2022, 6, 1, 5, 4, 56, zone="Europe/Berlin")),
    ("n", None, "03/04/2022 11:00", utc(2022, 3, 4, 11, 0, 0, zone="America/New_York")),
    ("b", None, "03/04/2022 11:00", utc(2022, 4, 3, 11, 0, 0, zone="Europe/Berlin")),
    ("n", None, "31/12/2022 08:10", "no such date or time"),
    ("n", None, "01/03/2023 3:52 AM", utc(2023, 1, 3, 3, 52, 0, zone="America/New_York")),
    ("b", None, "1641175935", 1641175935), ("z", None, "1641625867388", 1641625867), ("z", None, "1641359242946608", 1641359242), ("z", None, "1641168149.19", 1641168149),
    ("b", "DAY2", "00163807", utc(2022, 8, 18, 0, 16, 38, zone="Europe/Berlin")),
    ("b", "day02", "814", utc(2022, 8, 18, 0, 0, 8, zone="Europe/Berlin")),
    ("b", None, "200163807", utc(2022, 8, 18, 0, 16, 38, zone="Europe/Berlin")),
    ("b", "DAY2", "24163807", "no such date or time"),
    ("z", "DAY2", "00163807", "no known zone"), ("z", None, "2023-06-03 04:00:11", "no known zone"), ("q", None, "2023-06-03 04:00:11", "no known zone"),
    ("b", None, "2022-03-27 02:30:00", "wall time twice or never"), ("b", None, "2022-10-30 02:30:00", "wall time twice or never"),
    ("b", None, "2022-10-30 03:00:00", utc(2022, 10, 30, 3, 0, 0, zone="Europe/Berlin")), ("b", None, "2022-10-30 02:30:00 CET", utc(2022, 10, 30, 1, 30, 0)),
    ("l", None, "2023-04-02 01:45:00", "wall time twice or never"), ("l", None, "2023-10-01 02:15:00", "wall time twice or never"), ("l", None, "2023-10-01 02:30:00", utc(2023, 10, 1, 2, 30, 0, zone="Australia/Lord_Howe")),
    ("z", None, "2022-01-04T00:14:35[Europe/London]", utc(2022, 1, 4, 0, 14, 35)), ("b", None, "2022-01-04T00:14:35[Mars/Base]", "no known zone"),
    ("b", None, "Fri, 01 Apr 2022 11:41:27 +0530", utc(2022, 4, 1, 6, 11, 27)), ("b", None, "10 Foo 2023, 09:33:50", "no such date or time"),
    ("b", "2022-01-09", "late", "unreadable"), ("b", "2022-01-09", None, "unreadable"), ("b", None, None, "unreadable"), ("b", "", "--:--", "unreadable"), (None, None, "2023-06-03 04:00:11Z", utc(2023, 6, 3, 4, 0, 11)),
    ("b", None, "x" * 100_000, "unreadable"),
]


def resolve(spark, rows, devices=DEVICES):
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "log_id long, device_id string, d string, t string").withColumn("zone", F.lit("clash")).withColumn("status", F.lit(1))
    return resolve_instants(log, spark.createDataFrame(devices, "device_id string, zone string, date_order string, day1_date date"), row_id="log_id", source="device_id", date=F.col("d"), time=F.col("t"))


def test_spellings(spark):
    found = {r["log_id"]: r for r in resolve(spark, [c[:3] for c in CASES] * 2).collect()}
    for i, (*_, want) in enumerate(CASES):
        r = found[i]
        assert (r["utc_s"] if r["status"] == "fixed" else r["status"]) == want, (CASES[i], r)


def test_undeclared_order_is_learnt_or_stays_ambiguous(spark):
    clear = [("o", None, f"{d}/01/2022 10:00") for d in range(13, 31)]
    found = resolve(spark, [*clear, ("o", None, "03/04/2022 11:00"), ("o", None, "05/05/2022 11:00")]).collect()
    by = {r["log_id"]: r for r in found}
    assert by[18]["utc_s"] == utc(2022, 4, 3, 11) and by[19]["posterior"] == 1.0
    alone = {r["log_id"]: r for r in resolve(spark, [("o", None, "03/04/2022 11:00")]).collect()}
    assert alone[0]["status"] == "ambiguous" and alone[0]["utc_s"] is None


def test_empty(spark):
    assert resolve(spark, []).count() == 0
    assert datetime.fromtimestamp(0, timezone.utc).year == 1970
