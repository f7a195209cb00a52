"""Small tables with the awkward cases every operator must handle."""

from pyspark.sql import functions as F

AWKWARD = [None, "", " ", "\n\n", "word", "a b", "Aa aa AA aa", "x" * 5_000, "<|endoftext|>", "<|startoftext|> <|im_end|>",
           "tab\tand  two spaces \n end ", "Straße İstanbul ΣΑΣ 中文 é   \x1c", "it's we'LL 12 345", "same text here", "same text here"]


def awkward_documents(spark, texts=AWKWARD, extra=True):
    """documents with null ids, repeated rows and further columns whose names clash with those of results."""
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("n_tokens", "ids", "rank", "start", "length", "piece", "kept", "failed", "score", "block"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
