import datetime

from docmill.streaming.ingest import new_versions


def test_new_versions(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", day), (1, "a", day), (1, "b", day), (2, None, day), (2, "", day)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = new_versions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.doc_id, r.text or "") for r in spark.table("versions").collect()) == [(1, "a"), (1, "b"), (2, "")]
