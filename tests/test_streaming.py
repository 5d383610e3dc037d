import json

from pyspark.sql import functions as F

from scrivane.sources import geometry as G
from scrivane.streaming import document_batches, stream_rows

DATA = "/root/testdata/sf0.001/events.parquet"


def _stream(spark, tmp_path):
    spark.read.parquet(DATA).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(DATA).schema).parquet(str(tmp_path / "in"))


def test_rows(spark, tmp_path):
    q = stream_rows(_stream(spark, tmp_path)).writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [json.loads(r[0]) for r in spark.table("encoded").collect()]
    assert len(rows) == 1000 and set(rows[0]) == {"event_id", "ts", "user_id", "event_type", "value", "props"}


def test_features_in_batches(spark, tmp_path):
    out = []
    df = _stream(spark, tmp_path).select("event_id", G.point(F.col("value"), F.col("value")).alias("g"))
    q = document_batches(df, lambda d, n: out.append(d.first()[0]), "g", "event_id").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(len(json.loads(x)["features"]) for x in out) == 1000
