import re

import pytest

from scorekit.llm.licenses import (BLOCK, CONTAINMENT, PHRASES, STRIDE, TEMPLATES, license_digest,
                                   scan_licenses)

from .conftest import rows_of

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = [(i, name) for p, name in PHRASES for i in range(len(w))
              if w[i:i + len(p.split())] == p.split()]
    blocks = []
    for s in range(0, max(len(w) - (BLOCK - STRIDE) - 1, 0) + 1, STRIDE):
        b = set(w[s:s + BLOCK])
        for name, wording in TEMPLATES:
            t = set(wording.split())
            if 100 * len(b & t) >= CONTAINMENT * len(t):
                blocks.append((name, len(b & t) / len(t)))
    base = {n for _, n in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | {n for n, _ in blocks})),
            1.0 if places else max((c for _, c in blocks), default=0.0))


CASES = ["mit license mit license apache  LICENSE", "MIT", "é general public license é",
         "you may not use this file except in compliance with your license",
         "a " * 100 + "This program: you can redistribute it and/or modify it under the terms of "
         "the GNU public license " + "b " * 70,
         "Permission is granted free of charge to any person obtaining copy of this software and "
         "associated documentation", "b " * 45 + TEMPLATES[5][1] + " c" * 45, "mit\x00license"]


def test_matches_brute_force(spark, docs, edge):
    cases = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for df in (docs, edge, cases):
        got = sorted((str(r["doc_id"]), *[str(v) for k, v in r.items() if k != "doc_id"])
                     for r in rows_of(license_digest(df)))
        assert got == sorted((str(r["doc_id"]), *map(str, brute(r["text"]))) for r in rows_of(df))


def test_native_plan_and_empty_table(docs, empty):
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert license_digest(empty).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("This tool is released under the Apache License.", "apache"),
    ("released under the zlib license", ""),
    ("Licensed under the MIT license version 2 0", "mit"),
    ("The house was released under the license of the county; mit is a word here.", "")])
def test_notices_of_another_license_get_no_label(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows_of(license_digest(df))[0]["labels"] == labels


def test_each_clause_alone_gets_its_own_label(spark):
    cases = spark.createDataFrame([(i, f"Notice: {t}. " + "word " * 40)
                                   for i, (_, t) in enumerate(TEMPLATES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in rows_of(license_digest(cases))}
    assert got == {i: name for i, (name, _) in enumerate(TEMPLATES)}
    assert len({name for name, _ in TEMPLATES}) >= 10


def test_templates_that_block_borders_may_cut_are_refused(spark, docs):
    with pytest.raises(ValueError):
        scan_licenses(docs, templates=(("long", "w " * (BLOCK - STRIDE + 1)),))
