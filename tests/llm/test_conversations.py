"""Conversation repair against a plain version that searches all edits, on odd rows and on conversations split over many tasks."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from logweave.llm import conversation_repair as cr
from logweave.llm import queries

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """Least (cost, audit) by Dijkstra over (place, state), and the lines that its edits leave."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        for x in "ua":
            if (state, x) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, x, (*lines, f"{NAMES[x]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for x in "ua":
                    if (state, x) in NEXT:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, x, (*lines, f"{NAMES[x]}:{text}")))
    raise AssertionError


def plain(given):
    """The contract of the query, a conversation at a time."""
    held = lambda x: " " if x is None else str(x)
    convs = {c: [] for c, *_ in given}
    for c, turn, role, text in given:
        kind = zlib.crc32(f"{held(c)}:{held(turn)}".encode()) % 20
        role, text = held(role), held(text)
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, lines = plain_repair(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        counts = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\n", None, "a.\n", "é?", "x\x0b", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "assistant", "user", "uncle"]
    return [(c if c else None, r.choice([None, t, t, t, t // 2, t + 3]), r.choice(roles), r.choice(texts)) for c in range(n) for t in range(r.randint(1, most))]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, c string, n string").repartition(parts)


def run(spark, tmp_path, rows):
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in queries.conversation_repair(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_matches_search_over_all_edits(spark, tmp_path, seed):
    given = conversations(seed)
    assert run(spark, tmp_path, given) == plain(given)


def test_long_conversation_spreads_over_batches_and_tasks(spark, tmp_path):
    r = random.Random(7)
    long = [(5, t, r.choice(["user", "assistant"]), f"{r.randrange(900)}{r.choice(['.', '.', ''])}") for t in range(1500)]
    given = long + [(9, 0, "user", "same.")] * 40 + [(8, None, None, None)] + conversations(3, 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert run(spark, tmp_path, given) == plain(given)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


@pytest.mark.parametrize("signatures", ["".join(x) for n in range(5) for x in itertools.product("suaUX", repeat=n)][::7])
def test_automaton_gives_the_cheapest_least_audit(signatures):
    own = cr.SuffixAutomaton()
    own.solve("uaXsua")
    cost, edits = own.solve(signatures[::-1])
    names = {"s": "system", "u": "user", "a": "assistant", "U": "user", "X": "user"}
    want = plain_repair([(names[x], "t", {"X": "blank", "U": "truncated"}.get(x, "")) for x in signatures])
    assert (cost, edits.translate(str.maketrans("UAua", "RRII"))) == want[:2]


def test_nodes_are_made_once_for_each_suffix():
    own = cr.SuffixAutomaton()
    given = sorted({x[::-1] for x in ("uaua", "saua", "xaua".replace("x", "o"), "ua", "ua", "au")})
    for x in given:
        own.solve(x)
    assert own.made == len({x[: i + 1] for x in given for i in range(len(x))})
