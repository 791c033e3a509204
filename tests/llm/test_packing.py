import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorekit.llm.packing import STEP_TOKENS, Encoder, Packer, pack_documents

from .conftest import rows_of

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(source, pieces):
    tok = Tokenizer.from_file(JSON)
    ids = defaultdict(list)
    for r in source:
        ids[r["doc_id"]].append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == sum(map(len, ids[doc]))
        if len(ids[doc]) == 1:
            own = ids[doc][0]
            at = 0
            for p in sorted(ps, key=lambda p: p["start"]):
                part = own[at:at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(own)
                assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += p["length"]
            assert at == len(own)
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding == 0
    return total


def test_round_trip(docs, edge):
    for df in (docs, edge):
        check(rows_of(df), rows_of(pack_documents(df, JSON, RANKS, public_tokenizers.PATTERN)))


def test_plain_and_exact_encoders_agree():
    texts = ["", " a", "a ", "a  b", "it's we'll  x\n\n y", "<|endoftext|> and <|endoftext|>", "a b c",
             "1 23 456 é\tñ\r\n 😀 ", "tabs\t\tand   spaces   "]
    fast, exact = Encoder(JSON, RANKS, public_tokenizers.PATTERN), Encoder(JSON, None, None)
    for t in texts:
        want = Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids
        for e in (fast, exact):
            assert list(struct.unpack(f"<{len(e(t)) // 4}I", e(t))) == want


@pytest.mark.parametrize("sizes", [[1], [1023, 1024, 1025], [5] * 500, list(range(1, 900, 7)),
                                   [64, 128, 65, 63, 512, 513, 3000]])
def test_packer_fills_windows(sizes):
    p = Packer(3, 1024, (64, 128, 256, 512, 1024), 16)
    for d, n in enumerate(sizes):
        p.add(d, b"\x01\0\0\0" * n)
    p.finish()
    seq = defaultdict(int)
    for r in p.rows:
        seq[r[5]] += r[2]
    assert sum(seq.values()) == sum(sizes)
    assert all(n & (n - 1) == 0 for n in seq.values())


def test_step_groups_hold_equal_numbers_of_ids():
    p = Packer(0, 1024, (64, 128, 256, 512, 1024), 64)
    for d in range(3000):
        p.add(d, b"\0\0\0\0" * (d * 37 % 1500 + 1))
    p.finish()
    load, tier = defaultdict(int), {}
    for r in p.rows:
        load[r[8]] += r[2]
        tier.setdefault(r[8], set()).add(r[7])
    assert all(len(t) == 1 for t in tier.values())
    last = {max(g for g, t in tier.items() if t == {x}) for x in (64, 128, 256, 512, 1024)
            if {x} in tier.values()}
    assert all(n == STEP_TOKENS for g, n in load.items() if g not in last)


def test_empty_table(empty):
    assert pack_documents(empty, JSON, RANKS, public_tokenizers.PATTERN).count() == 0
