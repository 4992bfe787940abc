"""Hard negatives against all inner products, on vectors with ties, copies, nulls and odd components."""

import random

import numpy as np
import pytest

from logweave.llm import hard_negatives as hn
from logweave.llm import queries

SHAPE = "vec_id long, embedding array<float>, label int, id string, q string"


def rows(seed, n=700, d=8):
    r = random.Random(seed)
    hot = [r.gauss(0, 0.3) for _ in range(d)]
    out = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [round(r.gauss(0, 0.3), r.choice([1, 3])) for _ in range(d)]
        out.append((i, v, r.choice([0, 1, 2, 2, 9])))
    bad = [(n, None, 1), (n + 100, [0.1] * d, None), (n + 200, [float("nan")] * d, 1), (n + 300, [None, *[0.1] * (d - 1)], 1), (None, [0.5] * d, 2), (None, [0.4] * d, 0), (n + 400, [], 1), (n + 500, [0.3, 0.2], 2), (n + 600, [float("inf")] * d, 1)]
    return out + bad + out[:5]


def plain(given, d=8):
    held = []
    for i, v, label in given:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        held.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(q + [0] * (d - len(q)))))
    held = sorted(set(held), key=lambda x: (x[0] is None, x[0] or 0))
    out = []
    for anchor in held:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(anchor[2], x[2], strict=True)), x[0] is None, x[0] or 0, x[0], x[1]) for x in held if x != anchor))
        for s, _, _, i, _ in [x for x in scored if x[4] == anchor[1]][:5]:
            fits = [x for x in scored if x[4] != anchor[1] and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(anchor[0], i, k, x[3], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return out


def run(spark, tmp_path, given, **more):
    frame = spark.createDataFrame([(*r, "x", "y") for r in given], SHAPE).repartition(4)
    found = hn.hard_negatives(hn.integer_vectors(hn.with_moved_labels(frame)), **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_products(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 20)
    given = rows(seed)
    assert run(spark, tmp_path, given, shard_rows=150, codewords=4) == sorted(plain(given), key=repr)


def test_one_label_empty_table_and_few_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(0, [0.5] * 8, 1), (100, [0.5] * 8, 1), (3, [0.3] * 8, 1)]) == []
    given = [(0, [0.5] * 8, 3), (1, [0.4] * 8, 4), (2, [0.3] * 8, 2), (200, [0.6] * 8, 2)]
    assert run(spark, tmp_path, given) == sorted(plain(given), key=repr)


def test_search_stops_before_it_has_seen_all_cells():
    """Far clusters are not opened once the window is certain, and what is found is what all rows would give."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    centres = r.normal(0, 60, (12, 16))
    q = np.concatenate([c + r.normal(0, 3, (400, 16)) for c in centres]).astype(np.int64)
    books = hn.Codebooks(16, hn._means(q[:, :8], 12), hn._means(q[:, 8:], 12))
    (c1, d1), (c2, d2) = hn._nearest(q[:, :8], books.first), hn._nearest(q[:, 8:], books.second)
    n = len(q)
    shard = hn.Shard(books, pa.table({"id": pa.array(range(n), pa.int64()), "label": pa.array([i % 3 for i in range(n)], pa.int64()), "h": pa.array(range(n), pa.int64()), "q": pa.array(q.tolist(), pa.list_(pa.int64())), "c1": c1, "c2": c2, "d1": d1, "d2": d2}))
    seen = []
    own = shard._scores
    shard._scores = lambda rows, anchor: seen.append(len(rows)) or own(rows, anchor)
    hn.CHUNK_ROWS, held = 200, hn.CHUNK_ROWS
    try:
        found, scores = shard.positives(0, 0, 0, q[0], 5)
    finally:
        hn.CHUNK_ROWS = held
    all_scores = q @ q[0]
    want = sorted((i for i in range(1, n) if i % 3 == 0), key=lambda i: (-all_scores[i], i))[:5]
    assert shard.ids[found].tolist() == want and sum(seen) < n // 2


def test_query_reads_the_given_table(spark):
    assert queries.negative_mining(spark, "/root/testdata/sf0.001").count() > 0


def test_rows_are_converted_once_and_batches_change_nothing():
    """The rows of a shard get their type once, however many chunks and anchors there are; anchors ahead find what each finds alone."""
    import pyarrow as pa

    r = np.random.default_rng(7)
    q = r.integers(-90, 90, (3000, 8))
    books = hn.Codebooks(8, hn._means(q[:, :4], 4), hn._means(q[:, 4:], 4))
    (c1, d1), (c2, d2) = hn._nearest(q[:, :4], books.first), hn._nearest(q[:, 4:], books.second)
    columns = {"id": pa.array(range(3000), pa.int64()), "label": pa.array([i % 3 for i in range(3000)], pa.int64()), "h": pa.array(range(3000), pa.int64()), "q": pa.array(q.tolist(), pa.list_(pa.int64()))}
    shard = hn.Shard(books, pa.table(columns | {"c1": c1, "c2": c2, "d1": d1, "d2": d2}))

    class Counted:
        n, rows = 0, shard.q

        def astype(self, kind):
            self.n += 1
            return self.rows.astype(kind)

    shard.q = Counted()
    anchors = pa.record_batch({k: pa.array(v.to_pylist()[:80], v.type) for k, v in columns.items()} | {"aims": pa.nulls(80, pa.list_(pa.int64()))})
    (found,) = hn._found(shard, anchors, 5, False)
    alone = [shard.positives(i, i, i % 3, q[i], 5) for i in range(80)]
    assert found.column("found").to_pylist() == [x for rows, _ in alone for x in shard.ids[rows].tolist()]
    assert found.column("score").to_pylist() == [x for _, scores in alone for x in scores.tolist()] and shard.q.n == 1
