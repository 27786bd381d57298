"""Uploads: one conversion of zone, declared directions."""

import pytest

from saldo.operators import upload

TIMES = [
    ("2024-05-01 08:00:00", "2024-05-01 00:00:00"), ("2024/5/1 8:00", "2024-05-01 00:00:00"), ("2024-05-01T08:00:00Z", "2024-05-01 08:00:00"), ("2024-05-01 08:00:00+08:00", "2024-05-01 00:00:00"),
    ("2024-05-01 08:00:00-0530", "2024-05-01 13:30:00"), ("2024-05-01", "2024-04-30 16:00:00"), ("junk", None), ("", None), (None, None),
]


@pytest.mark.parametrize("session", ["UTC", "Asia/Shanghai", "America/New_York"])
def test_times_do_not_depend_on_the_session(spark, session):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, at string")
        got = [r["x"] for r in rows.select("i", upload.utc("at", "Asia/Shanghai").cast("string").alias("x")).orderBy("i").collect()]
        summer = spark.createDataFrame([("2024-07-01 12:00",), ("2024-01-01 12:00",)], "at string")
        new_york = [r[0] for r in summer.select(upload.utc("at", "America/New_York").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == [w for _, w in TIMES]
    assert new_york == ["2024-07-01 16:00:00", "2024-01-01 17:00:00"]


def test_signs_stay_and_only_declared_columns_turn(spark):
    rows = [(1, "@7.0", "2024-05-01", "-5", "3", "in"), (2, "7", "2024-05-01", "-5", "9", "out"), (3, "b", "2024-05-01", "x", None, None), (4, "b", None, "(2.5)", "", "in")]
    df = spark.createDataFrame(rows, "n int, key string, at string, paid string, fee string, direction string")
    out = upload.canonical(df, "key", "at", {"paid": "as_is", "fee": "negative", "freight": "negative"}, ["business_key", "occurred_at", "paid"], ["n"], defaults={"direction": "none"})
    got = {r["n"]: (r["business_key"], float(r["paid"]), float(r["fee"]), float(r["freight"]), r["direction"], r["unread"]) for r in out.collect()}
    assert got == {1: ("7", -5.0, -3.0, 0.0, "in", 0), 3: ("b", 0.0, 0.0, 0.0, "none", 1), 4: ("b", -2.5, 0.0, 0.0, "in", 0)}
    with pytest.raises(ValueError, match="directions"):
        upload.canonical(df, "key", "at", {"paid": "abs"}, ["key"], ["n"])
