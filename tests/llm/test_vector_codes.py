"""Vector codes: exact products, a brute force in Python integers, edge rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorekit.llm import vector_codes as V

from .conftest import rows_of


def plain_codes(rows, parts, entries, rounds, scale=256):
    """``rows`` of (id, vector, label), ids distinct and not null."""
    kept = sorted((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows)
    w = len(kept[0][1]) // parts
    cut = {i: [v[p * w:(p + 1) * w] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i, _, _ in kept[:entries]] for p in range(parts)]

    def assign():
        return {i: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j)
                        for j, c in enumerate(books[p])) for p, v in enumerate(vs)]
                for i, vs in cut.items()}

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut[i][p] for i in cut if at[i][p][1] == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    errors = {i: sum(d for d, _ in a) for i, a in at.items()}
    by_label = {}
    for i, _, label in kept:
        by_label[label] = by_label.get(label, 0) + errors[i]
    out = sorted(str((i, bytes(j for _, j in at[i]), errors[i], by_label[label]))
                 for i, _, label in kept)
    return out, books


def coded(spark, rows, schema="vec_id long, embedding array<double>, label int", **kw):
    df, books = V.vector_codes(spark.createDataFrame(rows, schema), **kw)
    return sorted(str((r["vec_id"], r["codes"], r["error"], r["label_error"]))
                  for r in rows_of(df)), books


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2 ** 32), st.sampled_from([3, 12, 26, 27, 28]))
def test_products_are_exact(width, seed, bits):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2 ** bits, 2 ** bits + 1, (2, 5, width))
    c = rng.integers(-2 ** bits, 2 ** bits + 1, (2, 3, width))
    want = np.array([[[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c[p]] for u in x[p]]
                     for p in range(2)])
    assert (V.exact_products(x, c) == want).all()


@given(st.lists(st.integers(-2 ** 40, 2 ** 40), min_size=1, max_size=9), st.integers(2, 25))
def test_limbs_add_up_and_stay_small(values, bits):
    a = np.array(values, np.int64)
    parts = V.limbs(a, bits)
    assert sum(p.astype(np.int64) << (i * bits) for i, p in enumerate(parts)).tolist() == values
    assert all(np.abs(p).max() <= 2 ** bits for p in parts)


def test_first_of_equal_distances_wins():
    books = np.array([[[5, 5], [1, 1], [1, 1], [-1, 1]]])
    index, distance = V.nearest(np.array([[[0, 1], [1, 1], [6, 5]]]), books)
    assert index.tolist() == [[1, 1, 0]] and distance.tolist() == [[1, 0, 1]]


@pytest.mark.parametrize("size", [0.3, 3.0, 200_000.0])
def test_matches_brute_force(spark, size):
    rng = np.random.default_rng(int(size))
    rows = [(int(i), [float(x) for x in rng.normal(0, size, 8).round(3).clip(-250_000, 250_000)],
             [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    want, books = plain_codes(rows, 4, 7, 2)
    got, out = coded(spark, rows, parts=4, entries=7)
    assert got == want and out.entries.tolist() == books


def test_few_values_give_ties_and_unused_entries(spark):
    """Equal entries: only the first is ever used, the others stay."""
    rows = [(i, [float(i % 2), 1.0, -1.0, 0.5 * (i % 3)], 0) for i in range(50)]
    want, books = plain_codes(rows, 2, 6, 2)
    got, out = coded(spark, rows, parts=2, entries=6)
    assert got == want and out.entries.tolist() == books


def test_unusable_vectors_are_dropped(spark):
    good = [(i, [0.1 * i, -0.2, 0.3, 0.4 * i], i % 2) for i in range(1, 6)]
    bad = [(0, None, 1), (10, [0.1, None, 0.2, 0.3], 1), (11, [0.1, float("nan"), 0.2, 0.3], 1),
           (12, [0.1, float("inf"), 0.2, 0.3], None), (13, [0.1, -float("inf"), 0.2, 0.3], 1),
           (14, [], 0), (15, [0.5, 0.5, 0.5], 0), (16, [0.5] * 8, 0), (17, [V.LARGEST] * 4, 0)]
    want, books = plain_codes(good, 2, 3, 2)
    got, out = coded(spark, bad + good, parts=2, entries=3)
    assert got == want and out.entries.tolist() == books


def test_null_and_repeated_ids(spark):
    vectors = [[0.5, 0.25], [0.125, 0.75], [0.5, 0.25], [1.0, 1.0]]
    rows = [(None, vectors[0], 1), (3, vectors[1], None), (3, vectors[2], None),
            (3, vectors[2], None), (None, vectors[3], 1)]
    got, out = coded(spark, rows, parts=1, entries=3, rounds=0)
    # ids ascending, null last; vectors of one id by components
    assert out.entries.tolist() == [[[32, 192], [128, 64], [128, 64]]]
    assert len(got) == 5 and sum("b'\\x01'" in g for g in got) == 4


def test_fewer_vectors_than_entries_and_no_rows(spark):
    rows = [(1, [0.1] * 16, 5), (2, [0.9] * 16, 5)]
    want, books = plain_codes(rows, 16, 64, 2)
    got, out = coded(spark, rows)
    assert got == want and out.entries.shape == (16, 2, 1)
    got, out = coded(spark, [])
    assert got == [] and out.entries.size == 0
    got, _ = coded(spark, [(1, None, 0)])
    assert got == []


def test_extra_columns_and_labels_of_another_type(spark):
    rows = [(i, [0.1 * i] * 4, "ab"[i % 2], i, "x") for i in range(8)]
    schema = "vec_id long, embedding array<float>, label string, error long, codes string"
    want, _ = plain_codes([(i, [float(np.float32(x)) for x in v], lab)
                           for i, v, lab, _, _ in rows], 4, 3, 2)
    got, _ = coded(spark, rows, schema, parts=4, entries=3)
    assert got == want


def test_a_hot_label_is_summed_whole(spark):
    rows = [(i, [0.01 * (i % 50), 0.3], 1 if i % 3 else i) for i in range(1500)]
    want, _ = plain_codes(rows, 2, 4, 1)
    got, _ = coded(spark, rows, parts=2, entries=4, rounds=1)
    assert got == want


def test_digest_is_of_all_components():
    import hashlib
    books = V.Codebooks(np.array([[[1, -2], [3, 4]], [[0, 0], [5, 6]]]))
    assert books.sha256() == hashlib.sha256(b"1,-2,3,4,0,0,5,6").hexdigest()
