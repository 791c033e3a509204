import numpy as np
import pytest

from scorekit.llm.components import components
from scorekit.llm.near_dedup import (MISS, drop_near_copies, least_matches, near_groups, shingles,
                                     signature)

from .conftest import rows_of


def sets_of(rows, k):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        n = max(1, len(w) - k + 1) if w else 0
        out.append({b" ".join(w[i:i + k]) for i in range(n)})
    return out


def brute(rows, k, percent):
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def expected(rows, k, percent):
    sets, root = brute(rows, k, percent)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r["doc_id"] is not None:
            least[root[i]] = min(least.get(root[i], r["doc_id"]), r["doc_id"])
    return sorted((str(r["doc_id"]), len(sets[i]),
                   str(least.get(root[i]) if sets[i] else r["doc_id"]))
                  for i, r in enumerate(rows))


def got(df):
    return sorted((str(r["doc_id"]), r["n"], str(r["component_id"])) for r in rows_of(df))


def variants(spark, n=60):
    """Copies of one text, each changed in its own places: similarities on both sides of
    the threshold, so pivots do not cover all links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(n):
        words = list(base)
        for p in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            words[p] = f"new{d}x{p}"
        rows.append((d, " ".join(words)))
    rows += [(1000 + i, " ".join(f"o{i}y{j}" for j in range(30))) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, docs, edge, k, percent):
    for df in (docs, edge, variants(spark)):
        assert got(near_groups(df, k=k, percent=percent)) == expected(rows_of(df), k, percent)


def test_stage_keeps_one_row_of_each_component(edge):
    out = drop_near_copies(edge)
    assert out.columns == edge.columns
    rows, kept = rows_of(edge), rows_of(out)
    sets, root = brute(rows, 5, 80)
    groups = {r for r, s in zip(root, sets) if s}
    assert sum(bool(s) for s in sets_of(kept, 5)) == len(groups)
    assert len(kept) == len(groups) + sum(not s for s in sets)


def test_empty_table(empty):
    assert near_groups(empty).count() == 0
    assert drop_near_copies(empty).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.range(n - 1).selectExpr("(id * 7919) % 300 as i", "id").selectExpr(
        "id as a", "id + 1 as b").unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    found = {r["node"]: r["root"] for r in rows_of(components(links))}
    assert found == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_signature_estimates_similarity():
    a = shingles(" ".join(f"a{i}" for i in range(900)).encode(), 3)
    b = shingles(" ".join(f"a{i}" for i in range(100, 1000)).encode(), 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.12


def test_sequential_bounds_rarely_miss_a_true_link():
    least = least_matches(85, MISS)
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, 192)) < 0.85
    alive = np.ones(len(hits), bool)
    for i, need in enumerate(least):
        alive &= hits[:, :32 * (i + 1)].sum(axis=1) >= need
    assert alive.mean() > 0.9995
    assert ((rng.random((2000, 192)) < 0.5).sum(axis=1) >= least[-1]).mean() == 0
