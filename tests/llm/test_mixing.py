import re

import pytest

from scorekit.llm.mixing import mix, source_targets, take_mix

from .conftest import rows_of


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, hold what is above its limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, held = {}, set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in held)
        free = sum(w[s] for s in names if s not in held)
        out = {s: cap * sizes[s] if s in held else left * w[s] / free for s in names}
        above = {s for s in names if out[s] > cap * sizes[s] and s not in held}
        if not above:
            return out
        held |= above


def words(t):
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def check(source, got):
    sizes = {}
    for r in source:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(want[g["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    assert sorted((str(g["doc_id"]), g["size"]) for g in got) == sorted(
        (str(r["doc_id"]), len(words(r["text"]))) for r in source)
    for s, n in taken.items():
        assert want[s] - 1 - 1e-6 <= n <= want[s] + 1e-6


def test_targets_and_takes(docs, edge):
    check(rows_of(docs), rows_of(mix(docs)))
    check(rows_of(edge), rows_of(mix(edge)))


def test_reruns_and_partitions_agree(docs):
    pick = lambda d: sorted((r["doc_id"], r["taken"], r["before"]) for r in rows_of(mix(d)))
    assert pick(docs) == pick(docs.repartition(7))


def test_limits_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1, "c": 2, "d": 1000, None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in rows_of(source_targets(df))}
    want = targets(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1018)


def test_positions_follow_the_curriculum(docs):
    rows = [r for r in rows_of(mix(docs)) if r["taken"]]
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = {r["source"]: r["slope"] for r in rows}
    first = [early[r["source"]] for r in rows[:len(rows) // 4]]
    last = [early[r["source"]] for r in rows[-len(rows) // 4:]]
    assert sum(first) / len(first) > sum(last) / len(last)


def test_taken_copies(docs, edge):
    for df in (docs, edge):
        m, out = rows_of(mix(df)), take_mix(df)
        assert out.columns == df.columns
        got = rows_of(out)
        assert sum(len(words(r["text"])) for r in got) == sum(r["taken"] for r in m)
        texts = {}
        for r in rows_of(df):
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        assert all(any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in got)


def test_empty_table(empty):
    assert mix(empty).count() == 0 and take_mix(empty).count() == 0
