"""Both ways of meeting the windows give the same rows."""

from pyspark.sql import functions as F

from lectern.llm import decontam

SMALL = "/root/testdata/sf0.001"


def test_windows_by_shuffle_equal_windows_by_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "no id"), (7000, None), (7001, ""), (7001, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = items.unionByName(docs.where("doc_id = 3").select(F.lit(99).cast(items.schema["item_id"].dataType).alias("item_id"), F.substring("text", 1, 60).alias("text")), allowMissingColumns=True)
    sent = sorted(map(str, decontam.scan(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    dealt = decontam.scan(docs, items)
    assert sorted(map(str, dealt.collect())) == sent and len(sent) == docs.count()
    assert dealt.where("contaminated").count() > 0
    assert decontam.scan(docs.where("false"), items).count() == 0 and decontam.scan(docs, items.where("false")).where("contaminated").count() == 0
