import datetime as dt

from pyspark.sql import functions as F

from mercato.functions import (calendar_days, elapsed_days, local_date, sentinel, week_label,
                               key_audit, null_profile)


def _one(spark, row, schema, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_day_edges(spark):
    cases = [  # start, end, elapsed whole days, calendar days
        ("2018-01-01 23:00:00", "2018-01-02 22:00:00", 0, 1),
        ("2018-01-01 10:00:00", "2018-01-02 10:00:00", 1, 1),
        ("2018-01-03 12:00:00", "2018-01-02 00:00:00", -1, -1),
        ("2018-01-03 01:00:00", "2018-01-01 13:00:00", -1, -2),
    ]
    rows = [(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)) for a, b, _, _ in cases]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = df.select(elapsed_days("a", "b").alias("e"), calendar_days("a", "b").alias("c")).collect()
    assert [(r.e, r.c) for r in got] == [(e, c) for _, _, e, c in cases]


def test_week_label_edges(spark):
    days = ["2017-01-01", "2017-01-02", "2018-12-31"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    got = [r.w for r in df.select(week_label("d").alias("w")).collect()]
    assert got == ["2017-00", "2017-01", "2018-53"]


def test_week_label_matches_strftime_every_day(spark):
    df = spark.sql("SELECT explode(sequence(DATE'1994-12-25', DATE'2031-01-07')) AS d")
    got = {r.d: r.w for r in df.select("d", week_label("d").alias("w")).collect()}
    assert len(got) > 13000
    assert all(w == d.strftime("%Y-%W") for d, w in got.items())


def test_istanbul_date(spark):
    row = (dt.datetime(2017, 1, 1, 22, 30),)
    assert _one(spark, row, "t timestamp_ntz", local_date("t")) == dt.date(2017, 1, 2)
    assert _one(spark, row, "t timestamp_ntz", local_date("t", "UTC")) == dt.date(2017, 1, 1)


def test_istanbul_date_zone_aware(spark):
    row = (dt.datetime(2017, 1, 1, 22, 30),)  # session zone is UTC
    from pyspark.sql import types as T
    got = _one(spark, row, "t timestamp", local_date("t", dtype=T.TimestampType()))
    assert got == dt.date(2017, 1, 2)


def test_sentinel_literal(spark):
    got = spark.range(1).select(sentinel().alias("s")).first()["s"]
    assert got == dt.datetime(1453, 5, 29)


def test_key_audit_and_null_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    a = key_audit(df, "k").first()
    assert (a.row_count, a.distinct_keys, a.null_keys, a.is_key) == (3, 1, 1, False)
    ok = key_audit(spark.createDataFrame([("a",), ("b",)], "k string"), "k").first()
    assert ok.is_key
    p = null_profile(df, ["k", "v"]).first()
    assert (p.null_k, p.null_v) == (1, 1)


def test_row_number_split_matches_window_on_a_hot_key(spark):
    from pyspark.sql import Window
    from mercato.functions.ranking import row_number_split
    # two thirds of the rows share one key
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"),
        (F.col("id") * 7919 % 30011).alias("v"))
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    split = row_number_split(df, "k", ["v"], "rn", pieces=16)
    assert sorted(plain.collect()) == sorted(split.collect())
    # the hot key is numbered in several pieces, not in one task
    assert split.filter("k = -1").agg(F.max("rn")).first()[0] == 20000


def test_row_number_split_moves_rows_of_small_keys_once(spark):
    from mercato.functions.ranking import row_number_split
    from mercato.plans.inspect import explain_text
    df = spark.range(6000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("v"))
    split = row_number_split(df, "k", ["v"], "rn")
    # no join with offsets: one exchange, from the source to the window
    text = explain_text(split, "simple")
    assert text.count("Exchange") == 1 and "Join" not in text and "Range" in text
    assert sorted(split.collect()) == sorted((k, k + 1500 * i, i + 1)
                                             for k in range(1500) for i in range(4))


def test_row_number_split_of_hot_and_other_keys(spark, monkeypatch):
    from pyspark.sql import Window
    from mercato.functions import ranking
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 999).otherwise(-(F.col("id") % 3)).alias("k"),
        (F.col("id") * 7919 % 30011).alias("v"))
    pieced = []
    real = ranking._numbered_in_pieces
    monkeypatch.setattr(ranking, "_numbered_in_pieces",
                        lambda df, *a: (pieced.append({r.k for r in df.select("k").distinct().collect()}),
                                        real(df, *a))[1])
    monkeypatch.setattr(ranking, "TASK_ROWS", 1000)
    split = ranking.row_number_split(df, "k", ["v"], "rn", pieces=16, hot_rows=5000)
    assert pieced == [{-1, -2}]
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert sorted(plain.collect()) == sorted(split.collect())
    assert split.schema == plain.schema


def test_text_labels_ignore_the_session_zone(spark):
    from mercato.functions import timestamp_text, year_month
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # 02:30 on 2001-04-01 does not exist in Los Angeles (clocks jump)
        df = spark.createDataFrame([(dt.datetime(2001, 4, 1, 2, 30, 5),)], "t timestamp_ntz")
        r = df.select(timestamp_text("t").alias("s"), year_month("t").alias("m")).first()
        assert (r.s, r.m) == ("2001-04-01 02:30:05", "2001-04")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
