from pyspark.sql import functions as F

from annalist.streaming import memory


def test_stream_closes_the_batches_that_the_batch_form_closes(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("user_id"), F.col("id").alias("ord"), (5 + F.col("id") * 13 % 29).alias("cost"))
    for k in range(3):
        rows.filter((F.col("ord") >= 100 * k) & (F.col("ord") < 100 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = memory.short_buffer_stream(stream, 60).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("closed").collect()}
    batch = [tuple(r) for r in memory.short_buffer(rows, 60).collect()]
    last = {u: max(b for v, b, *_ in batch if v == u) for u in range(7)}
    assert got == {r for r in batch if r[1] < last[r[0]]}


def test_windows_with_watermark(spark, tmp_path):
    rows = spark.range(600).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30)).alias("at"), F.lit("view").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = memory.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 600
