"""Derived frames, long documents with many dropped lines, sliced benchmarks, and the pipeline's edge cases."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triagelake.llm import decontam, line_dedup, packed, substring_dedup, suffix_dedup


def test_buckets_of_a_derived_frame(spark):
    a = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"))
    b = a.join(a.select(F.col("doc_id").alias("other")), F.col("other") % 10 == F.col("doc_id") % 10).join(a.select(F.col("doc_id").alias("third")), F.col("third") == F.col("other"))
    assert packed.bucket_count(b.select("doc_id", "text").limit(1000)) == 64
    assert packed.bucket_count(spark.createDataFrame([(1, None)], "doc_id long, text string")) == 64


@pytest.mark.parametrize("make", [lambda d: suffix_dedup.suffix_dedup(d), lambda d: substring_dedup.substring_dedup(d)])
def test_dedup_of_a_joined_frame(spark, make):
    text = " ".join(f"w{i}" for i in range(80))
    left = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    docs = left.join(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), "doc_id")
    got = {r.doc_id: r.n_removed for r in make(docs).collect()}
    assert got[1] == 0 and got[2] > 0 and got[3] == 0


def test_a_long_document_that_loses_most_lines(spark):
    lines = [f"this line of more than forty characters is number {i:06d}" for i in range(20_000)]
    docs = spark.createDataFrame([(k, "\n".join(lines) + f"\nown {k}") for k in range(5)] + [(9, "a\n\nb")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert [got[k].text for k in range(4)] == [f"own {k}" for k in range(4)] and got[4]._n_dropped == 0 and got[9].text == "a\n\nb"
    assert got[0]._n_dropped == 20_000 and got[0]._n_lines == 20_001


def test_a_benchmark_in_slices_gives_the_same_leaks(spark, monkeypatch):
    items = [(k, " ".join(f"item{k} word{i}" for i in range(20))) for k in range(12)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(99, "clean text"), (100, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontam.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "SLICE_BYTES", 500)
    assert sorted(decontam.find_leaks(docs, bench).collect()) == whole and len(whole) == 12
    assert sorted(r.doc_id for r in decontam.remove_leaks(docs, bench).collect()) == [99, 100]


def test_pipeline_with_nulls_repeats_and_further_columns(spark, tmp_path):
    words = " ".join(f"plain{i} word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 5, 7), (1, words, "en", "a", 5, 7), (2, None, None, None, None, None), (None, "no id at all here", "en", "b", 3, 1), (3, "", "en", "b", 0, 2), (4, words + " end", "en", "b", 0, 2)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, _in long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, shape).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # texts without words are copies of each other and the smaller doc_id stays; the row without an id has its own text
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2]
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], shape).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
