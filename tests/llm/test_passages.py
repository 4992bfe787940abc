"""Removal of repeated passages: shards, copies of shards, and rows that are equal or share an id."""

import random

import pytest

from logweave.llm import phrase_dedup
from test_brute_force import SPACE, corpus

SHAPE = "doc_id long, text string"


def brute_repeats(rows):
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if tuple(w[a : a + 20]) in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(tuple(w[a : a + 20]))
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return want


def removed(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in phrase_dedup.without_repeats(frame).collect()}


@pytest.mark.parametrize(("phrases", "documents"), [(3, 2_000), (10_000, 1), (5, 2)])
def test_small_shards_and_copies_change_nothing(spark, monkeypatch, phrases, documents):
    monkeypatch.setattr(phrase_dedup, "SHARD_PHRASES", phrases)
    monkeypatch.setattr(phrase_dedup, "SALT_DOCUMENTS", documents)
    rows = corpus(seed=9, n=48)
    assert removed(spark.createDataFrame(rows, SHAPE).repartition(3)) == brute_repeats(rows)


def test_only_what_the_automata_find_is_removed(spark, monkeypatch):
    class Nothing:
        def iter(self, text):
            return iter(())

    monkeypatch.setattr(phrase_dedup, "_automaton", lambda phrases: Nothing())
    long = " ".join(f"q{i}" for i in range(60))
    assert {x[1] for x in removed(spark.createDataFrame([(1, long), (2, long)], SHAPE)).values()} == {0}


def test_equal_rows_and_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SALT_DOCUMENTS", 2)
    r = random.Random(4)
    a, b = (" ".join(f"z{r.randrange(10**6)}" for _ in range(30)) for _ in range(2))
    rows = [(None, a)] * 5 + [(None, a + " " + b)] * 3 + [(7, b)] * 2 + [(8, "x " + b), (9, None), (None, None)]
    got = sorted(((x["doc_id"] is None, x["n_words"], x["n_removed"]) for x in phrase_dedup.without_repeats(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()))
    # Of the null ids' two texts one precedes the other: a is removed from exactly one of them.
    first = [(True, 30, 0)] * 5 + [(True, 60, 30)] * 3
    second = [(True, 30, 30)] * 5 + [(True, 60, 0)] * 3
    rest = [(False, 0, 0), (True, 0, 0), (False, 31, 30)] + [(False, 30, 30)] * 2
    assert got in (sorted(first + rest), sorted(second + rest))


def test_clashing_columns_are_kept_or_replaced(spark):
    rows = [(1, "a b c", "mine", 5, "x", "y")]
    out = phrase_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, r string, n_words int, _at string, id string"))
    assert [tuple(r) for r in out.select("r", "_at", "id", "n_words", "text").collect()] == [("mine", "x", "y", 3, "a b c")]
