import hashlib
from collections import Counter

import numpy as np

from scorekit.llm.substring_dedup import WINDOW, WordHashes, remove_repeats

from .conftest import rows_of


def brute(rows, window):
    words = [(r["text"] or "").encode().split() for r in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(r["doc_id"]), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"])
                  for r in rows_of(df))


def test_matches_brute_force(docs, edge):
    assert got(remove_repeats(docs)) == brute(rows_of(docs), WINDOW)
    assert got(remove_repeats(edge, window=8, gram=3)) == brute(rows_of(edge), 8)


def test_repeat_inside_one_document_and_intervals(spark):
    part = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a {part} b c {part} d"), (2, "x " * 20)],
                               "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rows_of(remove_repeats(df, keep_text=True))}
    assert rows[1]["intervals"] == [{"start": 1, "end": 41}, {"start": 43, "end": 83}]
    assert rows[1]["kept_text"] == "a b c d" and rows[2]["n_removed"] == 0


def test_empty_table(empty):
    assert remove_repeats(empty).count() == 0


def test_rolling_hash_depends_on_the_words_alone():
    words = [f"w{i % 11}".encode() for i in range(300)]
    h = WordHashes(words).rolling(35)
    by = {}
    for i, x in enumerate(h):
        by.setdefault(int(x), set()).add(tuple(words[i:i + 35]))
    assert all(len(s) == 1 for s in by.values()) and len(by) == 11
    at, g = WordHashes(words).anchors(35, 16)
    assert all(g[p] == g[i:i + 20].min() for i, p in enumerate(at))
    assert np.all((at >= np.arange(len(at))) & (at < np.arange(len(at)) + 20))
