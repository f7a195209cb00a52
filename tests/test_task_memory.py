"""Rows that are small in a shuffle and large in memory: partitions are not merged, texts are not repeated."""

from pyspark.sql import functions as F

from sourceloom.operators import citations, retrieval


def test_citation_joins_keep_their_partitions(spark):
    quotes = spark.range(40).select(
        F.col("id").alias("clue_id"), F.concat(F.lit("u"), "id").alias("source_url"), F.lit("Ann Lee").alias("author"), F.lit("Nature").alias("journal"),
        F.array(F.lit("red steel"), F.lit("blue tin")).alias("keywords"),
        F.array(F.lit("Ann Lee. red steel blue tin. Nature. 10.1234/w.1"), F.lit("Article published 2023-01-02 10.1234/w.1")).alias("quotes"))
    docs = spark.range(40).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("text").alias("content"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = citations.formal_joins(citations.quote_rows(quotes), docs)
        assert out.count() == 40
        assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_cover_does_not_carry_questions(spark, monkeypatch):
    tasks = spark.createDataFrame([("p", f"t{i}", "search", f"q{i % 2}" * 100, None) for i in range(4)],
                                  "pool_id string, task_id string, action string, question string, locator string")
    options = spark.createDataFrame([("p", f"t{i}", f"v{i % 3}") for i in range(4)], "pool_id string, task_id string, version_id string")
    kept, cut = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: kept.append(df.schema) or cut(df))
    assert retrieval.greedy_cover(tasks, options, 3).count() == 3
    assert "question" not in str(kept) and all(s["_rank"].dataType.typeName() == "integer" for s in kept)
