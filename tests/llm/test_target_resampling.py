"""Importance resampling towards a target text: brute force, blocks, ties, edge rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorekit.llm import target_resampling as T

from .conftest import SF, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000
                    for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, share=5):
    """``{(id, features, weight, score)...}`` and the ranks' scores, in order."""
    raw, aim = np.zeros(10_000, int), np.zeros(10_000, int)
    found = [(d, *plain_features(t)) for d, t in docs]
    for _, _, f in found:
        np.add.at(raw, f, 1)
    for t in target:
        np.add.at(aim, plain_features(t)[1], 1)
    s, t = int(raw.sum()) + 10_000, int(aim.sum()) + 10_000
    gain = [math.floor(1000 * math.log((int(b) + 1) * t_s / ((int(a) + 1) * t_t)))
            for a, b, t_s, t_t in zip(raw, aim, [float(s)] * 10_000, [float(t)] * 10_000)]
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, n, len(f), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    spots = sorted((r for r in rows if r[1] >= 20),
                   key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return rows, [(r[0], r[4]) for r in spots[:share * len(spots) // 100]]


def check(docs, target, out, share=5):
    rows, drawn = plain([(r["doc_id"], r["text"]) for r in rows_of(docs)],
                        [r["text"] for r in rows_of(target)], share)
    got = rows_of(out)
    key = ["doc_id", "n_words", "n_features", "weight", "score"]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in key)) for r in got)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.mark.parametrize("share", [5, 60])
def test_matches_brute_force(docs, benchmark, share):
    check(docs, benchmark, T.target_resample(docs, benchmark, share_percent=share), share)


def test_edge_rows(edge, benchmark):
    check(edge, benchmark, T.target_resample(edge, benchmark, share_percent=100), 100)


def test_empty_tables(empty, edge, benchmark):
    assert T.target_resample(empty, benchmark).count() == 0
    check(edge, benchmark.limit(0), T.target_resample(edge, benchmark.limit(0), share_percent=50),
          50)


def test_ties_and_repeated_rows_are_drawn_in_order(spark, benchmark):
    """400 rows of one text: ids 0-9 and null, so scores tie within an id."""
    text = F.lit(" ".join(f"w{i}" for i in range(30)))
    ids = F.when(F.col("id") % 11 < 10, F.col("id") % 11)
    rows = spark.range(400).select(ids.alias("doc_id"), text.alias("text"))
    check(rows, benchmark, T.target_resample(rows, benchmark, share_percent=30), 30)


def test_draw_when_the_sketch_misses(spark, monkeypatch):
    """A margin that puts the cut above the last drawn score is noticed."""
    monkeypatch.setattr(T, "MARGIN", -0.3)
    rows = spark.range(1000).selectExpr("id as doc_id", "id * 7919 % 1000 as score", "id as row")
    got = {r["doc_id"]: r["rank"] for r in rows_of(T.draw_top(rows, F.lit(True), 40))}
    want = sorted(range(1000), key=lambda i: -(i * 7919 % 1000))[:400]
    assert sorted((r, d) for d, r in got.items() if r) == list(enumerate(want, 1))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_change_nothing(block):
    text = "Ab c9-d ÉÉ été  x" * 9 + "\0z" * 5 + " " * 100 + "end of it all"
    n, want = plain_features(text)
    parts = list(T.features(text.encode(), block=block))
    assert sum(k for k, _ in parts) == n
    assert sorted(b for _, f in parts for b in f.tolist()) == sorted(want)


def test_byte_table_is_the_word_rule():
    for cp in [*range(0x800), 0x20AC, 0x3042, 0x1F600]:
        text = f"a{chr(cp)}B"
        words = [w for block in T.word_blocks(text.encode()) for w in block]
        assert b" ".join(words).decode() == " ".join(WORD.findall(text.translate(LOWER)))
