"""Quality classifier, toxicity and quality rules: held-out accuracy, exact counts, edges."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import quality_rules, resampling, toxicity
from scorekit.llm.boosting import fit_trees
from scorekit.llm.queries import QUERIES

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def marked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def truth(labels, column):
    return {r["doc_id"]: r[column] for r in rows_of(labels)}


def test_importance_keeps_good_documents(marked):
    docs, labels = marked
    rows = rows_of(resampling.resample(docs, labels))
    good = truth(labels, "quality")
    kept = {v: [r["kept"] for r in rows if good.get(r["doc_id"]) == v] for v in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.5
    n, share = len(rows), np.mean(list(good.values()))
    k = int(np.ceil(min(1, share + 3 * (share * (1 - share) / len(good)) ** 0.5) * n))
    order = sorted((r["gumbel"] for r in rows), reverse=True)
    assert [r["kept"] for r in rows] == [r["gumbel"] >= order[k - 1] for r in rows]


def test_gram_counts_and_importance_match_plain_loops(spark, marked):
    docs, labels = marked
    some = docs.where("doc_id < 60")
    good = {d for d, q in truth(labels, "quality").items() if q == 1}
    raw, target = (np.zeros(resampling.BUCKETS) for _ in range(2))
    shapes, grams = resampling.Shapes(), {}
    for r in rows_of(some):
        g = grams[r["doc_id"]] = resampling.ngrams((r["text"] or "").encode(), shapes)
        for b in g:
            raw[b] += 1
            target[b] += r["doc_id"] in good
    ratio = (np.log(target + 1) - np.log(target.sum() + resampling.BUCKETS)
             - np.log(raw + 1) + np.log(raw.sum() + resampling.BUCKETS))
    for r in rows_of(resampling.importance_keys(some, labels)[0]):
        assert r["importance"] == pytest.approx(ratio[grams[r["doc_id"]]].sum(), abs=1e-6)


@pytest.mark.parametrize("k", [1, 2, 499, 997, 1000])
def test_kth_largest(spark, k):
    values = [float(v) for v in np.random.default_rng(k).normal(0, 1000, 990)] + [7.5] * 10
    keys = spark.createDataFrame([(v,) for v in values], "gumbel double")
    assert resampling.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_toxicity_on_held_out_labels(spark, marked):
    sf = "/root/testdata/sf0.1"
    rows = rows_of(QUERIES["op9_toxicity"](spark, sf))
    toxic = truth(spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], r["predicted"], toxic[r["doc_id"]]) for r in rows
            if r["held_out"] and r["doc_id"] in toxic]
    pos, neg = ([x for x in held if x[2] == v] for v in (1, 0))
    auc = np.mean([(p[0] > n[0]) + 0.5 * (p[0] == n[0]) for p in pos for n in neg])
    assert auc > 0.85
    assert np.mean([p[1] for p in pos]) > 0.55 and np.mean([n[1] for n in neg]) < 0.06


def test_toxicity_is_fitted_on_whole_texts(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(4000)]
    marks = ["".join(rng.choice(list("nopqrstuvwxyz"), 8)) for _ in range(20)]

    def text(i):  # odd documents name the marked words after their 3,000th word only
        words = list(rng.choice(plain, 3000))
        tail = rng.choice(marks if i % 2 else plain, 40)
        return " ".join([*words, *tail])

    docs = spark.createDataFrame([(i, text(i)) for i in range(240)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) toxic")
    model = toxicity.fit_on(docs, labels, usable=F.col("doc_id") < 160)
    score = {r["doc_id"]: r["score"] for r in rows_of(toxicity.score(docs, model))}
    assert np.mean([(score[i] >= 0.5) == i % 2 for i in range(160, 240)]) > 0.95


def test_toxic_dictionary_holds_all_marked_words_and_runs(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(4000)]
    marks = ["".join(rng.choice(list("nopqrstuvwxyz"), 9)) for _ in range(300)]

    def text(i):
        words = list(rng.choice(plain, 600))
        for w in rng.permutation(marks[:-2]) if i % 2 else ():
            words.insert(rng.integers(len(words)), w)
        return " ".join([*words, *(marks[-2:] if i % 2 else ())])

    docs = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string")
    model = toxicity.fit_on(docs, docs.selectExpr("doc_id", "int(doc_id % 2) toxic"))
    assert all(f" {w}".encode() in model.toxic for w in marks)
    assert " ".join(marks[-2:]).encode() in model.toxic
    at = model.ordinary.index(toxicity.HEADER_END)
    assert model.toxic.endswith(model.ordinary[at + len(toxicity.HEADER_END):])


def test_quality_rules_counts_and_held_out_accuracy(marked):
    docs, labels = marked
    fit, rest = labels.where("doc_id % 2 = 0"), truth(labels.where("doc_id % 2 = 1"), "quality")
    rows = rows_of(quality_rules.judge(docs, quality_rules.fit_rules(docs, fit)))
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(docs)}
    for r in rows:
        t = texts[r["doc_id"]].encode()
        words = t.split()
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        count, gone = Counter(windows), [False] * len(words)
        for i, w in enumerate(windows):
            if count[w] > 1:
                gone[i:i + 8] = [True] * 8
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.encode().split()]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(texts[r["doc_id"]].count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == sum(gone)
        assert r["base_failed"] == (len(words) < 20 or 100 * sum(gone) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    judged = {r["doc_id"]: r["score"] >= quality_rules.KEEP_AT for r in rows}
    assert np.mean([judged[d] == bool(q) for d, q in rest.items()]) > 0.95


def test_trees_respect_the_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 3000) > 0.8).astype(float)
    trees = fit_trees(x, y, np.array([1, -1, 0]))
    for f, sign in ((0, 1), (1, -1)):
        for _ in range(20):
            row = np.repeat(rng.random((1, 3)), 200, axis=0)
            row[:, f] = np.linspace(0, 1, 200)
            assert (sign * np.diff(trees.margin(row)) >= -1e-12).all()
    free = fit_trees(x, y, np.zeros(3, int))
    assert ((free.probability(x) >= 0.5) == y).mean() > 0.8


def test_edge_rows(edge, empty, no_labels, marked):
    _, labels = marked
    n = edge.count()
    for use in (labels, no_labels):
        kept = rows_of(resampling.resample(edge, use))
        assert len(kept) == n and all(np.isfinite(r["gumbel"]) for r in kept)
        out = resampling.keep_resampled(edge, use)
        assert out.columns == edge.columns and out.count() == sum(r["kept"] for r in kept)
        model = toxicity.fit_on(edge, use)
        scores = rows_of(toxicity.score(edge, model))
        assert len(scores) == n and all(0 <= r["score"] <= 1 for r in scores)
        judged = rows_of(quality_rules.judge(edge, quality_rules.fit_rules(edge, use)))
        assert len(judged) == n
    assert all(r["kept"] for r in rows_of(resampling.resample(edge, no_labels)))
    for t in (resampling.resample(empty, labels), resampling.keep_resampled(empty, labels),
              toxicity.score(empty, toxicity.fit_on(empty, labels)),
              quality_rules.judge(empty, quality_rules.fit_rules(empty, labels))):
        assert t.count() == 0
