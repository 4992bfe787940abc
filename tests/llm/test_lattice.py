"""The lattice model against sums over all segmentations, and base scores and counts against a plain version."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logweave.llm import lattice_lm as lm
from logweave.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def segmentations(word, spans):
    if not word:
        yield ()
    for i in range(1, len(word) + 1):
        if word[:i] in spans:
            for rest in segmentations(word[i:], spans):
                yield (word[:i], *rest)


def test_forward_and_expected_counts_sum_all_segmentations():
    r = random.Random(2)
    spans = [b"", *{bytes([b]) for b in b" abc"}, *{"".join(r.choice(" abc"[k > 0 :]) for k in range(n)).encode() for n in (2, 2, 2, 3, 3, 4) for _ in range(5)}]
    spans = list(dict.fromkeys(spans))
    weights = np.log(np.array([r.random() for _ in spans]) / len(spans))
    lattice = lm.Lattice(spans)
    words = [b"", b"a", b"abc", b"cabba", b"aaaaaaa", b"bcabc"]
    counts = np.array([1.0, 2, 3, 4, 5, 6])
    got, times = lattice.walk(words, weights, counts)
    want = np.zeros(len(spans))
    for word, total, n in zip(words, got, counts, strict=True):
        ways = [(math.exp(sum(weights[spans.index(x)] for x in way)), way) for way in segmentations(b" " + word, spans)]
        mass = sum(p for p, _ in ways)
        assert math.isclose(total, math.log(mass), rel_tol=1e-9)
        for p, way in ways:
            for x in way:
                want[spans.index(x)] += n * p / mass
    assert np.allclose(times, want)


TEXTS = ["Alpha beta alpha\tGAMMA.", "", None, "beta\x0bbeta \n delta", "Ünï cödé ÄB", "x" * 30_000, "alpha " * 500, "naïve gap alpha"]


def given(seed=4, n=90):
    r = random.Random(seed)
    rows = [(i, r.choice(TEXTS) if i % 3 else " ".join(r.choice("red green Blue pink".split()) + str(r.randrange(9)) for _ in range(40))) for i in range(n)]
    return [*rows, (None, "alpha beta"), (None, "alpha beta"), (7, "beta"), (7, "other text")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, row string, word string, base string").repartition(5)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    own = Counter()
    for (_, t), out in zip(rows, held, strict=True):
        if not out:
            own.update([*words_of(t), None])
    total, types = sum(own.values()), len(own)
    result = []
    for (i, t), out in zip(rows, held, strict=True):
        tokens = [*words_of(t), None]
        result.append((i, out, len(tokens), sum(x in own for x in tokens), total, sum(math.log10((own[x] + 1) / (total + types + 1)) for x in tokens)))
    return result, own, held


@pytest.mark.parametrize("head", [4, lm.HEAD_WORDS])
def test_scores_of_documents(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rows = given()
    got = lm.score_documents(frame(spark, rows), PATH).collect()
    want, own, _ = plain_base(rows)
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted(([r[c] for c in names] for r in got), key=order)
    assert [r[:5] for r in got] == [list(x[:5]) for x in sorted(want, key=order)]
    assert np.allclose([r[5] for r in got], [x[5] for x in sorted(want, key=order)])
    known = lm.vocabulary(PATH)
    words = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in own.items() if w is not None], "word binary, trained long")
    weights = lm.fit_weights(words, own[None], PATH)
    lattice = lm.Lattice(known.spans)
    texts = sorted(((i, t) for i, t in rows), key=lambda x: order((x[0], 0, len(words_of(x[1])) + 1, 0, 0, 0)))
    scores = sorted((sum(lattice.walk([w.encode() for w in words_of(t)], weights)[0]) if words_of(t) else 0.0) + weights[0] for _, t in texts)
    assert np.allclose(sorted(r[6] for r in got), [s / math.log(10) for s in scores])


def test_weights_are_a_distribution_and_fitting_helps(spark):
    known = lm.vocabulary(PATH)
    assert math.isclose(known.prior.sum(), 1) and {bytes([b]) for b in range(256)} <= set(known.spans)
    rows = given()
    before, after = (lm.score_documents(frame(spark, rows), PATH, rounds=n).where("held_out").selectExpr("sum(score)").first()[0] for n in (0, 2))
    assert after > before


def test_no_training_documents_and_empty_table(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.score_documents(frame(spark, [(one, "some words")]), PATH).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(got["score"])
    assert lm.score_documents(frame(spark, given()).where("false"), PATH).count() == 0
