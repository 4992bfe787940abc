"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.conversation_repair import damaged, joined_sha256, repair
from logweave.llm.decontaminate import contamination
from logweave.llm.hard_negatives import hard_negatives, integer_vectors, with_moved_labels
from logweave.llm.html_extract import extract_main_text
from logweave.llm.jaccard_join import jaccard_components
from logweave.llm.lattice_lm import score_documents
from logweave.llm.license_scan import scan
from logweave.llm.packing import pack, token_pieces
from logweave.llm.phrase_dedup import without_repeats
from logweave.llm.quality_rules import apply_policy, ledger
from logweave.llm.token_counts import with_token_counts
from logweave.llm.token_files import part_starts, read_token_files, write_token_files
from logweave.llm.tokens import tokenizer_path, vocabulary_size
from logweave.llm.toxicity import fit_severity, score_severity
from logweave.plans.session import table


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any benchmark window of 10 words, and the items they come from."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["b"] - x["a"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: five-word shingles, similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxic severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, table(spark, sf_dir, "labels")))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write bit-packed token files, read them back, and digest each document's ids."""
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    path = write_token_files(table(spark, sf_dir, "documents"), vocabulary, end_id=2, vocabulary=vocabulary_size(vocabulary))
    rows = read_token_files(spark, path).select("part", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(part_starts(spark, path), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of 20 words or more."""
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document by its header or, where the table has a ``path``, by its nearest licensed directory."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.col("path") if "path" in docs.columns else F.lit(None).cast("string"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The packing query over any documents table: pieces with the digest of their ids, and their places."""
    pieces = token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    rows = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(rows)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of the quality rules for every document."""
    book = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "rule_bits")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation, after the damage that the query does to its rows."""
    given = table(spark, sf_dir, "conversations")
    found = repair(damaged(given))
    audits = found.audits.select(F.col("c").alias("ac"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = joined_sha256(found.rows).select(F.col("c").alias("dc"), "sha256")
    every = given.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("ac")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("dc")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five best positives of every hundredth vector."""
    return hard_negatives(integer_vectors(with_moved_labels(table(spark, sf_dir, "embeddings"))))


def lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice log10 probabilities of every document."""
    return score_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": decontaminate,
    "op2_html_main_text": html_main_text,
    "op3_jaccard_join": jaccard,
    "op4_toxicity": toxicity,
    "op5_token_counts": token_counts,
    "op6_token_files": token_files,
    "op7_substring_dedup": substring_dedup,
    "op8_license_scan": license_scan,
    "op9_packing": packing,
    "op10_quality_rules": quality_rules,
    "op11_conversation_repair": conversation_repair,
    "op12_hard_negatives": negative_mining,
    "op13_lattice_lm": lattice_lm,
    "pipeline": pipeline,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = f"list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
        b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
                FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM win),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win USING (k, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY doc_id),
        m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
              FROM l LEFT JOIN rep USING (doc_id)),
        r AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                     + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
                     + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS rule_bits FROM r""",
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
