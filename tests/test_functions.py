from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sift.functions.text import strip
from sift.functions.times import parse_utc

DAYS = {
    "2024-01-02": (2024, 1, 2), "20240102": (2024, 1, 2), "2024-W01-1": (2024, 1, 1),
    "2024W011": (2024, 1, 1), "2024-W01": (2024, 1, 1), "2020-W53-7": (2021, 1, 3),
    "2024-02-29": (2024, 2, 29), "0001-01-01": (1, 1, 1), "1582-10-10": (1582, 10, 10),
}
NO_DAYS = [
    "2024-02-30", "0000-12-31", "2024", "2024-01", "2024-1-5", "2024-0102", "2024-W00-1", "2024-W53-1",
    "9999-W53-1", "garbage", "", "12:34:56",
]
CLOCKS = {
    "": (0, 0, 0, 0), "T03:04:05": (3, 4, 5, 0), " 03:04": (3, 4, 0, 0), "T030405": (3, 4, 5, 0),
    "x03": (3, 0, 0, 0), "T03:04:05.123456": (3, 4, 5, 123456), "T03:04:05,1": (3, 4, 5, 100000),
    "T03:04:05.1234567": (3, 4, 5, 123456), "T00:00": (0, 0, 0, 0), "T03:04:05:06": (3, 4, 5, 60000),
}
NO_CLOCKS = ["T23:59:60", "T03:0405", "T3:04", "T03:04:05.", "T"]
# Minutes east of Greenwich, seconds and microseconds added.
OFFSETS = {
    "": (0, 0), "Z": (0, 0), "+00:00": (0, 0), "-05:00": (-300, 0), "+0530": (330, 0), "+05": (300, 0),
    "-23:59": (-1439, 0), "+05:30:15": (330, 15), "+18:01": (1081, 0), "+05:30:15.5": (330, 15.5), "+05:60": (360, 0),
}
NO_OFFSETS = ["+24:00", "+5", " UTC", "ZZ", " ", "\n"]


def instants():
    """Written forms and the instants they mean, put together from their parts."""
    midnight = datetime(1970, 1, 1, tzinfo=timezone.utc)
    expected = {}
    for day, ymd in DAYS.items():
        for clock, (hour, minute, second, micro) in CLOCKS.items():
            for offset, (east, extra) in OFFSETS.items():
                if not clock and offset:
                    continue
                try:
                    local = datetime(*ymd, hour, minute, second, micro, tzinfo=timezone.utc)
                    at = local - timedelta(minutes=east, seconds=extra)
                except OverflowError:
                    expected[day + clock + offset] = None
                    continue
                expected[day + clock + offset] = (at - midnight) // timedelta(microseconds=1)
    wrong = [day + "T03:04:05Z" for day in NO_DAYS] + NO_DAYS
    wrong += [f"2024-01-02{clock}" for clock in NO_CLOCKS]
    wrong += [f"2024-01-02T03:04:05{offset}" for offset in NO_OFFSETS] + [" 2024-01-02"]
    return expected | dict.fromkeys(wrong)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_utc_gives_the_instants_that_are_written(spark, zone):
    expected = instants()
    frame = spark.createDataFrame([(f,) for f in sorted(expected)], "v string").repartition(8)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = frame.select("v", F.unix_micros(parse_utc(F.col("v"))).alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r.v, r.m, expected[r.v]) for r in rows if r.m != expected[r.v]] == []


def test_strip_takes_every_white_space_character(spark):
    texts = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", strip(F.col("v")))
    assert [r.v for r in rows.collect() if r[1] != r.v.strip()] == []


def test_week_dates_with_any_separator(spark):
    """A digit after a week date may part it from the time, as the standard library reads it."""
    import random
    import re

    rng = random.Random(6)
    texts = ["2024W011503", "2024W0115030", "2024-W01-1503", "2024-W01-15:30", "2024W01150304", "2024W0110203+01:00", "2024W01102", "2024W018", "2024W0181"]
    for _ in range(3000):
        date = f"{rng.randrange(2019, 2026)}{rng.choice(['', '-'])}W{rng.randrange(1, 54):02}" + rng.choice(["", "-", ""]) + rng.choice(["", str(rng.randrange(10))])
        time = "".join(rng.choices("0123456789", k=rng.randrange(7))) if rng.random() < 0.7 else f"{rng.randrange(24):02}:{rng.randrange(60):02}"
        text = date + rng.choice(["", "T", " ", "5", "0", "-"]) + time
        # Digits past the seconds without a point are an accident of that parser.
        texts += [] if re.search(r"-\d{8}$", text) else [text]

    def expected(text):
        try:
            read = datetime.fromisoformat(text)
        except ValueError:
            return None
        return (read if read.tzinfo else read.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.date_format(parse_utc(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("p")).collect()
    assert [(r.t, r.p) for r in rows if r.p != expected(r.t)] == []
    assert sum(r.p is not None for r in rows) > 300
