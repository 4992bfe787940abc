"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of
``documents``.  ``ORACLE_SQL`` is None: token ids cannot be computed in SQL; the tests hold the stages against
brute-force versions.

Defined results of all stages: rows are decided each for itself, whether ids are null, shared or repeated; null and empty
texts have no words, so the quality rules reject them, and the other stages keep them; an empty table gives no rows; columns
beside ``doc_id``, ``text`` and ``n_chars`` pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.decontaminate import contamination
from logweave.llm.jaccard_join import jaccard_components
from logweave.llm.phrase_dedup import without_repeats
from logweave.llm.quality_rules import apply_policy, ledger
from logweave.llm.queries import packed_documents
from logweave.plans.session import scratch, small, table, written

ORACLE_SQL = None
#: Columns that stages read or set; the others are numbered while a stage works, so that no name of theirs is taken.
_OWN = ("doc_id", "text", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in _OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the numbered ones."""
    return rows.select(*[F.col(held).alias(c) for held, c in zip(_numbered(docs).columns, docs.columns, strict=True)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule of the policy rejects go."""
    return _named(apply_policy(ledger(_numbered(docs))).where("kept"), docs)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``: rows of equal ids (null too) and equal texts share it. It is never null, and null ids come last."""
    same = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        F.xxhash64("text").alias("digest"),
    )
    return docs.withColumn("_row", same)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (then digest of the text).

    Of rows with one id and one text, the one whose other columns have the smallest hash stays.
    """
    keyed = with_row_key(_numbered(docs))
    with scratch(spark) as folder:
        found = written(jaccard_components(keyed, key="_row").select("_row", "component_id"), "found", folder)
        gone = written(found.where("_row <> component_id").select("_row").distinct(), "gone")
        repeated = written(found.groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    kept = keyed.join(small(gone), "_row", "left_anti")
    if repeated.isEmpty():
        return _named(kept, docs)
    every = F.struct(*[F.col(c) for c in kept.columns if c != "_row"])
    one = kept.join(small(repeated), "_row", "left_semi").groupBy("_row").agg(F.min_by(every, F.xxhash64(every)).alias("one")).select("one.*")
    return _named(kept.join(small(repeated), "_row", "left_anti").drop("_row").unionByName(one), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left goes too. Other texts stay as they are, with their line breaks."""
    kept = without_repeats(_numbered(docs)).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _named(kept.withColumns(new), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    keyed = with_row_key(_numbered(docs))
    leaked = contamination(keyed, table(spark, sf_dir, "benchmark"), key="_row").where(F.size("spans") > 0).select("_row").distinct()
    return _named(keyed.join(small(written(leaked, "leaked")), "_row", "left_anti"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
