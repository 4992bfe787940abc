"""Operators against plain Python versions, on small fixtures with nulls, empty and repeated rows, ties and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

from logweave.llm import decontaminate, html_extract, jaccard_join, license_scan, packing, phrase_dedup, quality_rules, text, token_counts, token_files, toxicity
from logweave.llm.tokens import Encoder, tokenizer_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(seed=3, n=60):
    """Documents with shared passages, exact and near copies, long texts, nulls and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "né", "X,y"]
    passage = " ".join(r.choice(words) for _ in range(70))
    base = [r.choice(words) for _ in range(150)]
    docs = []
    for i in range(n):
        if i % 6 == 0:
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif i % 6 == 1:
            w = passage.split()
            a = r.randint(0, 40)
            t = " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + "\n" + " ".join(w[a : a + r.randint(15, 70)])
        elif i % 6 == 2 and docs:
            t = docs[r.randrange(len(docs))][1]
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 19, 20, 21, 60])))
        docs.append((i, t))
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, passage * 30), (1004, "a " * 300), (1005, "x" * 5000), (1006, "b c d")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, "clash", "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, path string").repartition(5)


def test_repeats_match_brute_force(docs):
    seen, want = set(), {}
    for i, t in sorted(corpus()):
        words = SPACE.findall(t or "")
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            w = tuple(words[a : a + 20])
            if w in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(w)
        want[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrase_dedup.without_repeats(docs).collect()}
    assert got == want


def test_repeats_null_ids_and_empty_table(spark, docs):
    long = " ".join(f"q{i}" for i in range(30))
    rows = spark.createDataFrame([(None, long), (5, long), (5, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in phrase_dedup.without_repeats(rows).collect())
    assert got == [(False, 30), (False, 30), (True, 0)]
    assert phrase_dedup.without_repeats(docs.where("false")).count() == 0


def shingles(t):
    w = SPACE.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("shuffled", [False, True])
def test_jaccard_components_match_brute_force(docs, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(jaccard_join, "small", lambda frame: frame)
    for name, value in (("SALT_SHINGLES", 20), ("SALT_TIMES", 1), ("FAN_IN", 2), ("SEND_BYTES", 5_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(corpus())


def test_jaccard_chains_cross_groups(spark):
    """Texts that drift a few words at a time link along a chain whose ends don't."""
    r = random.Random(5)
    words, rows = [f"t{i}" for i in range(120)], []
    for i in range(25):
        rows.append((i, " ".join(words)))
        for _ in range(r.randint(1, 3)):
            words[r.randrange(len(words))] = f"n{r.random()}"
    rows += [(100 + i, " ".join(r.choice(["a", "b", "c"]) for _ in range(12))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r_["doc_id"]: (r_["n_shingles"], r_["component_id"]) for r_ in jaccard_join.jaccard_components(frame).collect()}
    assert got == brute_components(rows)
    empty = jaccard_join.jaccard_components(frame.where("false"))
    assert empty.count() == 0


def brute_hits(rows, items):
    wins = {}
    for k, t in items:
        w = ALNUM.findall(lower(t or ""))
        for i in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[i : i + 10]), set()).add(k)
    out = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in wins}:
                if (x := wins.get(tuple(w[a : a + n]))) and a + n <= len(w):
                    hit.update(range(a, a + n))
                    found |= x
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_contamination_matches_brute_force(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    words = corpus()[1][1].split()
    items = [(1, " ".join(words[5:40]).upper()), (2, " ".join(words[10:22])), (2, "b C d"), (3, "zz yy"), (4, None), (5, ""), (None, "x" * 5000), (6, corpus()[0][1]), (7, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == brute_hits(corpus(), items)
    none = decontaminate.contamination(docs, bench.where("false"))
    assert none.where("size(spans) > 0").count() == 0 and none.count() == len(corpus())


def test_repeated_documents_keep_their_number(spark):
    rows = spark.createDataFrame([(1, "b c d"), (1, "b c d"), (None, "e"), (1, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c d"), (2, "e f g h i j k l m n o p q r s")], "item_id long, text string")
    got = decontaminate.contamination(rows, bench)
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["spans"])) for r in got.collect()) == [(0, 1, 0), (1, 1, 0), (1, 3, 1), (1, 3, 1)]


def brute_measures(t):
    w = SPACE.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_measures_match_brute_force(spark, docs):
    extra = [(2000, "a b c\na b c\n\n \na b c d ## $$"), (2001, "x y x y x y x y"), (2002, "\x0b\x0c one\rtwo 日本 語")]
    frame = spark.createDataFrame([(i, t) for i, t in corpus() + extra], "doc_id long, text string")
    book = quality_rules.ledger(frame)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book.collect()}
    assert got == {i: brute_measures(t) for i, t in corpus() + extra}
    kept = quality_rules.apply_policy(book, "base").where("kept")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in corpus() + extra for m in [brute_measures(t)] if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert quality_rules.ledger(docs).select("n_words").dtypes == [("n_words", "bigint")]
    report = {r["rule"]: r for r in quality_rules.ablations(book, "base").collect()}
    few = sum(brute_measures(t)[0] < 50 for _, t in corpus() + extra)
    assert report["too_few_words"]["n_failed"] == few and report["repeated_trigrams"]["n_only_this"] + few + kept.count() == len(corpus() + extra)


ODD = ["", None, " ", "a  b", " lead", "trail ", "x \n y", "tab\tx y", "<|endoftext|> a <|endoftext|>", "é ́x 's don't", "a \x1c b\x1c c", "\xa0 a\xa0b c d", "日本 語 テスト", "👍 🏽x ok", "word " * 3000, "z" * 9000, "ΣΑΣ ΑΣ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoder_equals_the_library(name):
    own = Encoder(tokenizer_path(name))
    own.MEMORY_BYTES, own.BATCH_BYTES = 20_000, 3_000
    texts = ODD + [t for _, t in corpus()]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path(name))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode([t or "" for t in texts])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.ids(texts)] == want
    assert own.counts(texts).tolist() == [len(x) for x in want]


def test_token_counts_keep_rows_and_columns(spark):
    rows = [(i, t, "mine") for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts.with_token_counts(frame, tokenizer_path("byte_bpe_50k.json")).collect()}
    want = Encoder(tokenizer_path("byte_bpe_50k.json")).counts(ODD).tolist()
    assert [(got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) for i in range(len(ODD))] == [(len((t or "").encode()), n, n > 1024) for t, n in zip(ODD, want, strict=True)]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, size=1000).astype("<u4")
    raw = token_files.packed(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert (token_files.unpacked(raw, bits, 0, 1000) == ids).all()
    for a, b in ((0, 1), (63, 65), (130, 131), (500, 1000), (999, 1000)):
        assert (token_files.unpacked(raw, bits, a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)
    rows = token_files.read_token_files(spark, path).join(token_files.part_starts(spark, path), "part").collect()
    got = {r["doc_id"]: (r["part_start"] + r["local_start"], bytes(r["ids"])) for r in rows}
    start, flat = 0, []
    for (i, _), body in zip(sorted(corpus()), Encoder(tokenizer_path("byte_bpe_50k.json")).ids([t for _, t in sorted(corpus())]), strict=True):
        ids = [*np.frombuffer(body, dtype="<u4").tolist(), 2]
        assert got[i] == (start, np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
        flat += ids
    some = sorted((r["position"], r["id"]) for r in token_files.token_slice(spark, path, 700, 900).collect())
    assert some == list(enumerate(flat))[700:1600]


def test_packing_is_gapless_and_close_to_the_bound(spark, docs):
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), capacity=128)
    rows = packing.pack(pieces, capacity=128).collect()
    texts = dict(corpus())
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, body in zip(texts, Encoder(tokenizer_path("word_bpe_49k.json")).ids(list(texts.values())), strict=True):
        own = [whole[i][k] for k in sorted(whole[i])]
        assert b"".join(bytes(r["ids"]) for r in own) == body + bytes(4)
        assert [r["start"] for r in own] == [128 * k for k in range(len(own))] and all(r["length"] == 128 for r in own[:-1])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 128 + 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<!-- x --><div class="ad">Buy</div><article><header><h1>A &amp;&lt; B</h1></header><p><b>One  two<br>three.<p>Four &copy</p><aside>Side</aside><ul><li>i<li>j</ul></article>
<section class="comments"><p>First!</p></section><div id="cookie-banner">We use</div><footer>End</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(html_extract.blocks(PAGE), []) == "A &< B\n\nOne two three.\n\nFour ©\n\ni\n\nj"
    assert html_extract.blocks(None) == [] and html_extract.blocks("<p>open <b>text") == [("open text", False)]


def test_neighbours_differ_only_in_main_text(spark):
    frame = "<div>Site name</div><div>Menu a</div>{}<div>Imprint</div>"
    rows = [(i, f"http://h.example/a/{i}?q=1", frame.format("".join(f"<p>page {i} line {k}</p>" for k in range(4)))) for i in range(6)]
    rows += [(90, None, None), (91, "http://h.example/a/5#x", rows[5][2]), (92, "http://alone.example/", "<p>only one</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[2] == "\n\n".join(f"page 2 line {k}" for k in range(4))
    assert got[92] == "only one" and got[90] == "" and len(got) == len(rows)


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_extract.common_lines(a, b)) == table[-1][-1]


def test_severity_ranks_toxic_documents(spark):
    r = random.Random(2)
    clean, bad = [f"c{i}" for i in range(300)], ["vile", "scum", "moron"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(clean) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(r.randint(2, 6) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
        if i < 400:
            labels.append((i, int(toxic)))
    docs_ = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.fit_severity(docs_, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    got = {x["doc_id"]: x for x in toxicity.score_severity(docs_, model).collect()}
    held_out = [(got[i]["toxic"], bool(t)) for i, _, t in rows[400:]]
    assert sum(a == b for a, b in held_out) / len(held_out) > 0.97 and not got[5000]["toxic"]
    none = toxicity.fit_severity(docs_, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_severity(docs_, none).where("expected_severity <> 0").count() == 0


def test_ordinal_slopes_are_right():
    rng = np.random.default_rng(0)
    x = rng.random((800, 6)) < 0.4
    true_w, true_t = np.array([2, 1, 0, 0, -1, -2.0]), np.array([0.5, 2.0])
    noise = rng.logistic(size=800)
    y = ((x @ true_w + noise)[:, None] > true_t).sum(axis=1)
    w, t = toxicity.fit_ordinal([(int(g), np.flatnonzero(f).tolist()) for g, f in zip(y, x, strict=True)], 6)
    assert np.abs(w - true_w).max() < 0.6 and np.abs(t - true_t).max() < 0.6


def test_license_headers_and_inheritance(spark):
    rows = [
        (1, "Released under the MIT License.", "a/b/LICENSE"),
        (2, "text\n  Licensed under the Apache License, Version 2.0.\nmore", "a/b/x"),
        (3, "nothing here", "a/b/y"),
        (4, "deep", "a/b/c/d/z"),
        (5, "other", "q/z"),
        (6, None, None),
        (7, "", "top"),
        (8, "This work is licensed under the GNU General Public License, version 3.\n" + "words " * 50, "q/w"),
        (9, "Licensed under CC BY-NC 4.0.", "a/LICENSE"),
        (10, "above", "a/k"),
    ]
    from pyspark.sql import functions as F

    docs_ = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r["doc_id"]: (r["license"], r["via"]) for r in license_scan.scan(docs_, F.col("path")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("Apache-2.0", "header"), 3: ("MIT", "inherited"), 4: ("MIT", "inherited"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none"), 8: ("GPL-3.0", "header"), 9: ("CC-BY-NC-4.0", "header"), 10: ("CC-BY-NC-4.0", "inherited")}
    assert license_scan.scan(docs_.where("false"), F.col("path")).count() == 0


def test_word_and_gram_hashes():
    words = [w.encode() for w in "ab a b abab é ééé a\x01 b".split()] * 40
    body = b" ".join(words)
    own = text.hashed_words(body)
    assert len(own) == len(words) and len(set(own.tolist())) == len(set(words))
    for k in (1, 3, 5, 8, 20):
        grams = text.gram_hashes(own, k).tolist()
        assert len(set(grams)) == len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    clashing = ("n_words", "kept", "_row", "_text", "c1", "kept_text", "spans", "rule_bits", "r", "component_id")
    frame = docs.select("doc_id", "text", *[F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in clashing], F.lit(7).alias("n_chars"))
    spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr qq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.schema.simpleString() == frame.schema.simpleString(), name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in clashing), name
        assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, str(tmp_path)).collect()}
    assert near == {i for i, (_, c) in brute_components(corpus()).items() if i == c}
