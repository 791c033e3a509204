import corpus_pipeline
from scorekit.llm.queries import ORACLES, QUERIES
from scorekit.session import materialize

from .conftest import SF, rows_of
from .test_exact_dedup import norm
from .test_near_dedup import brute
from .test_packing import check


def test_stages_pass_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"]: r["quality"] for r in rows_of(spark.read.parquet(f"{SF}/labels.parquet"))}
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "stage")
        by_stage[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns
    before, after = (rows_of(d) for d in by_stage["quality classifier"])
    kept = {r["doc_id"] for r in after}
    assert all(r["doc_id"] in kept for r in before if good.get(r["doc_id"]) == 1)
    before, after = (rows_of(d) for d in by_stage["exact dedup"])
    assert sorted({norm(r["text"]) for r in before}) == sorted(norm(r["text"]) for r in after)
    before, after = (rows_of(d) for d in by_stage["near dedup"])
    sets, root = brute(before, 5, 80)
    least = {}
    for r, s, c in zip(before, sets, root):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"]) if s else r["doc_id"]
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after = (rows_of(d) for d in by_stage["mixing"])
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(before) - words(after)) <= 20  # a word at most for each source
    before, pieces = (rows_of(d) for d in by_stage["packing"])
    check(before, pieces)


def test_registered_queries_name_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
