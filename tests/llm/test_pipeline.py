"""The pipeline's stages on their own inputs, against brute force."""

import pytest
from common import awkward_documents, empty_documents
from pyspark.sql import functions as F
from test_quality import brute
from test_similar import left_by_similarity
from test_tokens import check_packing

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


def kept_by_quality(text):
    words, chars, symbols, lines, dup_lines, repeated = brute(text)
    return not (words < 50 or 100 * repeated > 50 * words or chars < 2 * words or chars > 20 * words or 4 * symbols > words
                or 100 * dup_lines > 60 * lines)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in P.STAGES:
        found = stage(spark, docs, FOLDER)
        rows = found.collect()
        out.append((name, docs, found.columns, rows))
        if name != P.STAGES[-1][0]:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_columns_stay(stages):
    for _, docs, columns, rows in stages[:-1]:
        assert columns == docs.columns and set(rows) <= set(docs.collect())


def test_language(stages):
    _, docs, _, rows = stages[0]
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rows}
    assert all(len((r["text"] or "").split()) < 20 for r in docs.collect() if r["doc_id"] in gone) and len(gone) < 5


def test_quality(stages):
    _, docs, _, rows = stages[1]
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect() if kept_by_quality(r["text"])}


def test_near_copies(stages):
    _, docs, _, rows = stages[2]
    assert sorted(r["doc_id"] for r in rows) == left_by_similarity([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing(stages):
    _, docs, _, rows = stages[3]
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run_is_all_stages(spark, stages):
    got = P.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[3][3])


def test_awkward_and_empty_tables(spark):
    docs = awkward_documents(spark).withColumn("lang", F.lit("en"))
    for table in (docs, empty_documents(spark)):
        for name, stage in P.STAGES:
            out = stage(spark, table, FOLDER)
            assert out.count() <= max(1, table.count())
            assert name == "packing" or out.columns == table.columns
