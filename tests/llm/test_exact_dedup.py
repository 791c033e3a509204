import hashlib
import re

from scorekit.llm.exact_dedup import drop_exact_copies, exact_groups, possibly_repeated

from .conftest import rows_of


def norm(t):
    return re.sub("[\x20\x09-\x0D]+", " ", t or "")


def brute(docs):
    best, size = {}, {}
    for r in docs:
        k = norm(r["text"])
        size[k] = size.get(k, 0) + 1
        i = (r["doc_id"] is None, r["doc_id"] or 0)
        best[k] = min(best.get(k, (True, float("inf"))), i)
    return best, size


def test_groups_match_brute_force_on_edge_rows(edge):
    source, got = rows_of(edge), rows_of(exact_groups(edge))
    best, size = brute(source)
    assert len(got) == len(source)
    sha = {hashlib.sha256(k.encode()).digest(): k for k in best}
    for g in got:
        k = sha[bytes(g["sha"])]
        assert g["group_size"] == size[k]
        assert g["keep_id"] == (None if best[k][0] else best[k][1])
    # one row of each group stays, repeated rows included
    assert sum(g["row"] == g["keep_row"] for g in got) == len(best)


def test_drop_keeps_one_row_of_each_text_and_all_columns(edge):
    out = drop_exact_copies(edge)
    assert out.columns == edge.columns
    kept = rows_of(out)
    best, _ = brute(rows_of(edge))
    assert sorted(norm(r["text"]) for r in kept) == sorted(best)
    assert all(((r["doc_id"] is None), r["doc_id"] or 0) in best.values() for r in kept)


def test_empty_table(empty):
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).count() == 0


def test_filter_lets_every_repeated_key_through(spark):
    keys = spark.range(5000).selectExpr("cast(id % 4000 as string) as sha")
    flagged = rows_of(possibly_repeated(keys, "sha"))
    assert all(r["maybe"] for r in flagged if int(r["sha"]) < 1000)
    assert sum(not r["maybe"] for r in flagged) > 2500  # most single keys do not shuffle


def test_only_possible_repeats_are_grouped(edge):
    plan = exact_groups(edge)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
