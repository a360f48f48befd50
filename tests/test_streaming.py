from datetime import datetime, timedelta

from clickloom.operators import flow
from clickloom.streaming import jobs


def test_token_bucket_streams_like_batch(spark, tmp_path):
    start = datetime(2020, 1, 1)
    rows = [(n, f"k{n % 3}", start + timedelta(seconds=n)) for n in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    for part, (a, b) in enumerate(((0, 30), (30, 60))):
        df.filter(f"id >= {a} and id < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.token_bucket(stream, "k", "ts", 2, 9).writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(r["id"] for r in spark.table("passed").collect())
    assert got == sorted(r["id"] for r in flow.token_bucket(df, "k", "ts", "id", 2, 9).collect())


def test_click_counts(spark, tmp_path):
    rows = [(1, "CLICK", datetime(2020, 1, 1, 1), 7), (1, "TRAC", datetime(2020, 1, 1, 2), None), (2, "HOP", datetime(2020, 1, 1, 2), None)]
    df = spark.createDataFrame(rows, "key long, kind string, ts timestamp, media_id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = jobs.click_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["key"], r["media_id"], r["n_trac"], r["n_hop"]) for r in spark.table("counts").collect()] == [(1, 7, 1, 0)]


def test_side_table_is_loaded_anew(spark):
    loads, seen = [], []
    run = jobs.reloaded(lambda: loads.append(1) or spark.range(len(loads)), lambda batch, side: seen.append((batch.count(), side.count())), max_age=3600)
    run(spark.range(3), 0)
    run(spark.range(4), 1)
    assert (len(loads), seen) == (1, [(3, 1), (4, 1)])
    at_once = jobs.reloaded(lambda: loads.append(1) or spark.range(len(loads)), lambda batch, side: seen.append(side.count()), max_age=-1)
    at_once(spark.range(1), 0)
    at_once(spark.range(1), 1)
    assert seen[2:] == [2, 3]


def test_metrics_and_sessions(spark, tmp_path):
    start = datetime(2020, 1, 1)
    rows = [(start + timedelta(minutes=m), "a", v) for m, v in ((0, 1.0), (0.5, 3.0), (90, 5.0))]
    df = spark.createDataFrame(rows, "ts timestamp, name string, value double")
    df.write.parquet(str(tmp_path / "in"))
    for name, stream in (("m", jobs.metrics), ("s", lambda x: jobs.sessions(x, "name", "ts"))):
        made = stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["n"], r["total"], r["last_value"], r["members"]) for r in spark.table("m").collect()) == [(1, 5.0, 5.0, 1), (2, 4.0, 3.0, 2)]
    assert sorted(r["n"] for r in spark.table("s").collect()) == [1, 2]
