from pyspark.sql import functions as F

from quern.streaming.buckets import buckets


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = buckets(stream, ["event_type"], late="400 days").writeStream.outputMode("complete").format("memory").queryName("b").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("b").collect()))
    assert got == sorted(map(tuple, buckets(table, ["event_type"]).collect())) and got
    assert sum(r[3] for r in got) == table.select(F.count("*")).first()[0]
