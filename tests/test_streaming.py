"""Bounded streams: each file once, late rows and duplicates within the watermark, windows equal to batch."""

from pyspark.sql import functions as F

from millrace.operators import generate
from millrace.streaming import ingest

SF = "/root/testdata/sf0.001"


def events(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return ingest.read_stream(spark, f"{SF}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def collect(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_files_are_taken_once(spark, tmp_path):
    src, out, marks = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "marks")
    docs = spark.createDataFrame([(1, "a b c"), (2, " "), (3, None)], "doc_id long, text string")
    docs.write.parquet(src)
    run = lambda: ingest.ingest(ingest.prepared(ingest.read_stream(spark, src, docs.schema), 2), out, marks)
    run()
    run()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, "a b")]
    spark.createDataFrame([(4, "d")], docs.schema).write.mode("append").parquet(src)
    run()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [1, 4]


def test_windows_equal_batch(spark):
    got = collect(spark, ingest.windowed_counts(events(spark), "ts", "event_type", "1 day", "30 days"), "w", "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_within_watermark(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 00:10:00'), (2, TIMESTAMP '2024-01-01 00:20:00') AS t(k, ts)").write.parquet(src)
    stream = ingest.first_seen(ingest.read_stream(spark, src, "k int, ts timestamp"), ["k"], "ts")
    assert sorted(r["k"] for r in collect(spark, stream, "d", "append").collect()) == [1, 2]


def test_message_helpers(spark):
    df = spark.createDataFrame([([("user", [("image", "i"), ("text", "t")]), ("assistant", [("text", "u")])], ["a", "b", "c"])], "m array<struct<role:string,content:array<struct<type:string,value:string>>>>, a array<string>")
    row = df.select(generate.images_of(F.col("m")).alias("i"), generate.favoured(F.col("a")).alias("f")).first()
    assert [p["value"] for p in row["i"]] == ["i"] and row["f"] == ["a", "b", "c", "a", "b"]
