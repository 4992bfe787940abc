"""Stages of the pipeline decide for each row, not for each id."""

import random

import corpus_pipeline

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n):
    r = random.Random(5)
    return [" ".join(f"u{r.randrange(5000)}" for _ in range(80)) for _ in range(n)]


def test_near_duplicates_of_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, e, f = texts(6)
    near = a + " tail"
    rows = [(None, b), (None, c), (None, near), (1, a), (2, d), (2, near), (3, e), (3, f), (None, c), (4, None), (None, None), (5, b)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SHAPE).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, frame, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (2, d), (3, e), (3, f), (None, c), (4, None), (None, None), (5, b)], key=repr)


def test_leaks_of_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, leak = texts(5)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, b + " " + leak), (1, c), (1, d + " " + leak), (2, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SHAPE).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_leaks(spark, frame, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, a), (1, c), (2, None)], key=repr)
