"""The whole pipeline against plain Python versions of its stages, and the queries that SQL can express."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from logweave.llm import queries
from logweave.llm.tokens import Encoder, tokenizer_path

from test_brute_force import SPACE, brute_components, brute_hits, brute_measures

DATA = "/root/testdata/sf0.001"


def raw_documents():
    r = random.Random(11)
    words = [f"v{i}" for i in range(900)]
    shared = " ".join(r.choice(words) for _ in range(45))
    base = [r.choice(words) for _ in range(140)]
    leak = " ".join(r.choice(words) for _ in range(30))
    docs = []
    for i in range(40):
        t = " ".join(r.choice(words) for _ in range(r.randint(55, 160)))
        if i % 8 == 1:
            w = list(base)
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif i % 8 == 2:
            t += " " + shared
        elif i % 8 == 3:
            t += "\n" + leak
        elif i % 8 == 4:
            t = "too short"
        elif i % 8 == 5:
            t = " ".join(w + "%%%" for w in t.split())
        docs.append((i, t, "en", "s", len(t)))
    docs += [(100, docs[0][1], "en", "s", 5), (101, None, None, None, None), (102, "", "en", "s", 0), (103, shared * 40, "en", "s", 1)]
    return docs, [(1, leak), (2, None)]


def kept(t):
    n, chars, symbols, dup, repeat = brute_measures(t)
    lines = len([x for x in (t or "").split("\n") if SPACE.search(x)])
    return n >= 50 and 100 * repeat <= 50 * n and 2 * symbols <= n and 100 * dup <= 50 * lines and 2 * n <= chars <= 20 * n


def brute_pipeline(docs, items):
    rows = [(i, t) for i, t, *_ in docs if kept(t)]
    roots = brute_components(rows)
    rows = sorted((i, t) for i, t in rows if roots[i][1] == i)
    seen, cut = set(), []
    for i, t in rows:
        w = SPACE.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            g = tuple(w[a : a + 20])
            if g in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(g)
        if any(gone):
            t = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        if t:
            cut.append((i, t))
    hits = brute_hits(cut, items)
    return {i: t for i, t in cut if not hits[i][1]}


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, items = raw_documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = brute_pipeline(docs, items)
    assert sorted(got) == sorted(want) and 5 < len(want) < len(docs) - 8
    import zlib

    for (i, t), body in zip(want.items(), Encoder(tokenizer_path("word_bpe_49k.json")).ids(list(want.values())), strict=True):
        ids = np.frombuffer(body + bytes(4), dtype="<u4")
        pieces = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted(got[i]) == pieces


def test_one_document_of_repeated_rows_stays(spark, tmp_path):
    t = " ".join(f"k{i}" for i in range(80))
    frame = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, "en", "s", 1), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, str(tmp_path)).collect()) == [1, 3]


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"pipeline", "op3_jaccard_join"}))
def test_queries_return_a_row_per_input(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    key, table = next((k, t) for k, t in (("page_id", "pages"), ("conv_id", "conversations"), ("doc_id", "documents")) if k in rows.columns)
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().count()
