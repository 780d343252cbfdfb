"""Vector codes against a plain computation with Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import vector_codes as V

INTS = st.integers(-300, 300)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(1, 20), st.data())
def test_nearest(width, entries, points, data):
    row = st.lists(INTS, min_size=width, max_size=width)
    x = np.array(data.draw(st.lists(row, min_size=points, max_size=points)), np.int64)
    book = np.array(data.draw(st.lists(row, min_size=entries, max_size=entries)), np.int64)
    book[-1] = book[0]  # a tie
    distances = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    codes, found = V.nearest(V.walsh(x), V.walsh(book))
    assert codes.tolist() == distances.argmin(axis=1).tolist()
    assert found.tolist() == distances.min(axis=1).tolist()


def test_sequency_order():
    signs = V.walsh(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(row) != 0).sum() for row in signs] == list(range(8))


def brute(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = max((len(r[1]) for r in kept), default=0)
    width = max(1, -(-dim // parts))
    full = [[math.floor(256 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for q in full]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, full[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for q in cut:
                groups.setdefault(best(q[p], books[p])[1], []).append(q[p])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g)]
    out, errors = [], {}
    for r, q in zip(kept, cut):
        found = [best(x, b) for x, b in zip(q, books)]
        error = sum(d for d, _ in found)
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), error, r[2]))
        errors[r[2]] = errors.get(r[2], 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((a, b, c, errors[d]) for a, b, c, d in out), key=repr), digest


def check(spark, rows, parts=4, entries=5, rounds=2):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = V.compressed(frame, parts=parts, entries=entries, rounds=rounds)
    got = coded.select("row.vec_id", "code", "error", "group_error").collect()
    assert (sorted(map(tuple, got), key=repr), V.books_sha256(books)) == brute(rows, parts, entries, rounds)


def vectors(n, dim, seed=1):
    draw = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, v.tolist(), i % 3 if i % 4 else None) for i, v in enumerate(draw)]


def test_whole_result(spark, small_batches):
    check(spark, vectors(60, 12))


def test_hot_group_bound(spark, monkeypatch):
    """A bound of one crowded group sends the other groups through the join."""
    monkeypatch.setattr(V, "HOT_GROUPS", 1)
    check(spark, [(i, v, 0 if i % 3 else i) for i, v, _ in vectors(30, 8)])


def test_odd_rows(spark):
    """Nulls, non-finite values, repeats, equal ids, unlike lengths, fewer rows than entries."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 1.0, 0.0, 0.0], 1), (4, [inf, 1.0, 0.0, 0.0], None),
        (5, [0.5, -0.5, 0.25, 0.0], None), (5, [0.5, -0.5, 0.25, 0.0], None), (5, [-0.5, 0.0, 0.0, 0.1], 2),
        (None, [0.001, -0.001, 0.0, 0.0], 2), (6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 3), (7, [], 3),
    ]
    check(spark, rows)
    check(spark, rows, entries=50)
    check(spark, [r for r in rows if r[0] == 1])
    check(spark, [])


def test_other_columns(spark):
    rows = [(i, v, g, i, "x") for i, v, g in vectors(20, 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x long, code string")
    coded, _ = V.compressed(frame, parts=2, entries=4)
    assert sorted(r.row.x for r in coded.collect()) == list(range(20))


def test_too_large(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="too large"):
        V.compressed(frame)
