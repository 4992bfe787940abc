"""Null, shared and repeated ids, clashing columns, long texts and ties in the token, packing, join and licence operators."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import jaccard_join, license_scan, packing, queries, token_counts, token_files, toxicity
from logweave.llm.tokens import LETTERS, MARKS, Encoder, tokenizer_path, vocabulary_size

ROWS = [(None, "a b"), (None, "a b"), (None, "c"), (1, "x y"), (1, "x y"), (1, "z"), (2, None), (3, ""), (4, "Word, word. " * 4000)]
CLASHING = "k string, piece string, length string, ids string, sequence_id string, n_tokens string, part string, path string, component_id string"


def frame(spark, rows=ROWS):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, {CLASHING}").repartition(3)


def library(name, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain_gaps(lengths, capacity):
    """Gaps that pieces go to (capacity: a new bin), by trying all of them and adding up all squares."""
    counts, out = {}, []
    for s in lengths:
        tries = []
        for gap in sorted({g for g, n in counts.items() if n and g >= s} | {capacity}):
            new = dict(counts)
            if gap < capacity:
                new[gap] -= 1
            if gap > s:
                new[gap - s] = new.get(gap - s, 0) + 1
            tries.append((sum(n * n for n in new.values()), gap == capacity, gap, new))
        _, _, gap, counts = min(tries, key=lambda x: x[:3])
        out.append(gap)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pieces_go_where_the_squares_are_least(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 3, 5, 8, 13, 20]) for _ in range(150)]
    bins, offsets = packing.place(np.array(lengths), 20)
    filled, gaps = {}, []
    for s, b, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        assert filled.get(b, 0) == at
        gaps.append(20 - at)
        filled[b] = at + s
    assert gaps == plain_gaps(lengths, 20) and max(filled.values()) <= 20


def test_packing_query_of_odd_rows(spark):
    got = sorted(((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in queries.packed_documents(frame(spark)).collect()))
    want = []
    for (i, _), ids in zip(ROWS, library("word_bpe_49k.json", [t for _, t in ROWS]), strict=True):
        ids = np.array([*ids, 0], dtype="<u4")
        want += [(i or 0, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want) and queries.packed_documents(frame(spark).where("false")).count() == 0


def test_shards_do_not_depend_on_ids(spark):
    rows = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (1 + F.col("id") % 50).alias("length"))
    packed = packing.pack(rows, capacity=64, shard_pieces=100).collect()
    shards = {}
    for r in packed:
        shards[r["sequence_id"] >> 40] = shards.get(r["sequence_id"] >> 40, 0) + 1
    assert len(packed) == 900 and len(shards) == 9 and max(shards.values()) < 200


def test_token_files_of_odd_rows(spark):
    name = tokenizer_path("byte_bpe_50k.json")
    path = token_files.write_token_files(frame(spark), name, end_id=2, vocabulary=vocabulary_size(name))
    rows = token_files.read_token_files(spark, path).join(token_files.part_starts(spark, path), "part").collect()
    want = {}
    for (i, _), ids in zip(ROWS, library("byte_bpe_50k.json", [t for _, t in ROWS]), strict=True):
        want.setdefault(i, []).append(np.array([*ids, 2], dtype="<u4").tobytes())
    got = {}
    for r in sorted(rows, key=lambda r: r["part_start"] + r["local_start"]):
        got.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert list(got) == sorted(want, key=lambda i: (i is not None, i)) and {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    starts = sorted((r["part_start"] + r["local_start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    empty = token_files.write_token_files(frame(spark).where("false"), name, end_id=2, vocabulary=100_000)
    assert token_files.read_token_files(spark, empty).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(frame(spark), name, end_id=2, vocabulary=64)


def test_token_counts_of_odd_rows(spark):
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.with_token_counts(frame(spark), tokenizer_path("byte_bpe_50k.json")).collect())
    assert got == sorted((i or 0, len(x)) for (i, _), x in zip(ROWS, library("byte_bpe_50k.json", [t for _, t in ROWS]), strict=True))


def test_cuts_at_marks_and_line_feeds_change_no_ids():
    r = random.Random(8)
    parts = ["word", "Été", "x", "'s", "n't", ",", ".", "...", "?!", "\n", "\n\n", " ", "  ", "\t", "7", "77", "é", "́", "日本", "\x1f", "<|endoftext|>", " ", "ſ", "İ", "ß", "Σ", ":", ";"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Encoder(tokenizer_path(name))
        own.BATCH_BYTES, own.MEMORY_BYTES = 4_000, 30_000
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.ids(texts)] == library(name, texts)


def test_cuts_behind_every_letter_before_every_mark():
    """Every member of the class is a letter, and a cut behind it changes no ids, whatever stands around; nor behind what lies near the class."""
    members = [chr(c) for c in range(0x20, 0x260) if re.fullmatch(f"[{LETTERS}]", chr(c))]
    assert len(members) == 52 + 0x250 - 0xC0 - 3 and all(unicodedata.category(x)[0] == "L" for x in members)
    texts = [f"{before}{chr(c)}{mark}{after}" for c in [*range(0x20, 0x260)] for mark in MARKS for before, after in (("5", ""), ("a", "b"), ("", " x"))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in Encoder(tokenizer_path(name)).ids(texts)] == library(name, texts)


def test_cuts_in_texts_of_all_of_the_basic_plane():
    r = random.Random(11)
    plane = [c for c in range(1, 0xFFFE) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(r.choice(plane)) if r.random() < 0.4 else r.choice("ab X×÷é.,;:!? \n'7") for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, step = Encoder(tokenizer_path(name)), 5_000
        for i in range(0, len(texts), step):
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.ids(texts[i : i + step])] == library(name, texts[i : i + step])


def test_join_of_odd_rows(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(None, near), (None, near), (5, near + " end"), (5, "other text of five words"), (6, None), (None, None), (7, near)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 56, 5), (None, 56, 5), (5, 57, 5), (5, 1, 5), (6, 0, 6), (None, 0, None), (7, 56, 5)], key=repr)


def test_licences_of_odd_rows(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(None, mit), (None, "nothing"), (1, gpl), (1, "plain"), (1, gpl), (2, None), (3, "word " * 50_000 + mit)]
    got = sorted(((r["doc_id"], r["license"], r["via"]) for r in license_scan.scan(frame(spark, rows), F.lit(None).cast("string")).collect()), key=repr)
    assert got == sorted([(None, "MIT", "header"), (None, None, "none"), (1, "GPL-3.0", "header"), (1, None, "none"), (1, "GPL-3.0", "header"), (2, None, "none"), (3, "MIT", "header")], key=repr)


def test_severity_of_odd_rows(spark):
    rows = [(i % 7, f"{'vile ' if i % 2 else 'kind '} word") for i in range(60)] + [(None, "vile"), (1, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(None, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit_severity(frame(spark, rows), labels)
    assert toxicity.score_severity(frame(spark, rows), model).count() == len(rows)


def test_join_sends_one_text_for_each_class(spark):
    """Rows of one id (null) with different texts, and equal rows, make no more rows than they are."""
    pairs = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(60)]
    rows = [(None, t + end) for t in pairs for end in ("", " tail")] + [(None, pairs[0])] * 50
    source = frame(spark, rows).selectExpr("doc_id as k", "xxhash64(text) as t", "cast(text as binary) as body")
    got = jaccard_join.jaccard_components(frame(spark, rows), key="doc_id")
    assert got.count() == len(rows) and got.select("class_id").distinct().count() == 120 and got.groupBy("component_id").count().count() == 1
    names = [jaccard_join.class_of(jaccard_join.shingle_set(t.encode(), 5)) for _, t in rows]
    ends = spark.createDataFrame([(a, b) for a, b in zip(names[:120:2], names[1:120:2], strict=True)], "u long, v long")
    senders = source.groupBy("t").agg(F.first("k").alias("k")).join(spark.createDataFrame([(n, t) for n, (_, t) in zip(names[:120], rows, strict=False)], "c long, x string").selectExpr("c", "xxhash64(x) as t"), "t").select("c", "k", "t")
    from logweave.plans.session import scratch

    with scratch(spark) as folder:
        assert jaccard_join._sources(source, senders, ends, folder).count() == 120 + 50


def test_rows_that_differ_in_nulls_are_told_apart(spark):
    """With ids as text, (x, null) and (null, x) are two rows."""
    from logweave.llm import decontaminate, phrase_dedup

    words = "alpha beta gamma"
    docs = spark.createDataFrame([(words, None), (None, words), ("b", None)], "doc_id string, text string")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], len(r["spans"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {words: (0, 0), None: (3, 1), "b": (0, 0)}
    long = " ".join(f"q{i}" for i in range(30))
    rows = spark.createDataFrame([(long, None), (None, long), ("z", long)], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in phrase_dedup.without_repeats(rows).collect()}
    assert got == {long: (0, 0), None: (30, 0), "z": (30, 30)}
