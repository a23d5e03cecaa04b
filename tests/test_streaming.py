import datetime as dt

from pyspark.sql import functions as F

from loadscape.streaming import readings


def test_windows_and_late_data(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    parts = [[("a", t0, 1.0), ("a", t0 + dt.timedelta(minutes=5), 2.0)], [("a", t0 + dt.timedelta(hours=5), 4.0)], [("a", t0 + dt.timedelta(minutes=7), 8.0), ("a", t0 + dt.timedelta(hours=9), 1.0)], [("a", t0 + dt.timedelta(hours=12), 1.0)]]
    schema = "meter_id string, ts timestamp, value double"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        for f in (tmp_path / "in" / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    stream = readings.read(spark, f"{tmp_path}/in/*.parquet", schema)
    q = readings.windowed(stream, "meter_id", "ts", "value").writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = {r.start.hour: (r.n, r.total) for r in spark.table("windows").where(F.col("meter_id") == "a").collect()}
    assert got[0][0] in (2, 3) and got[5] == (1, 4.0)


def test_sessions_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0), ("a", t0 + dt.timedelta(minutes=30)), ("a", t0 + dt.timedelta(hours=3))], "meter_id string, ts timestamp")
    assert sorted(r.n for r in readings.sessions(df, "meter_id", "ts").collect()) == [1, 2]
