"""Hierarchical multi-length packing of tokenised documents.

A document of ``n`` ids (its text's ids, then id 0) gives ``n // top`` whole
windows of the top tier.  The rest is routed to the smallest context-size tier
that holds it whole.  Each tier packs its rests best-fit into windows of its
own size; the gaps of long windows are filled from shorter tiers, cutting the
last filler so that it ends with the window.  Every full window is a power of
two long; what is left at the end of a partition is cut into windows of binary
length, so no sequence needs padding.  Sequences of one tier fill step groups of
``STEP_TOKENS`` ids, so every step but a tier's last one costs the same.

Tokenising and packing happen in one pass per partition: texts never shuffle, a
worker holds one pool of rests (``POOL`` documents of fewer than ``top`` ids),
and a lost task is simply run again with the same result.  Sequence numbers
hold the partition number in their high bits.

Edge cases: a null or empty text is the single id 0; null ids and repeated rows
are ordinary rows; a very long text fills whole windows and leaves one rest like any other;
rests of equal length are taken as they came; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

TOP = 1024
TIERS = (64, 128, 256, 512, 1024)
#: Rests held per tier before the tier is packed; bounds a worker's memory.
POOL = 2048
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000
STEP_TOKENS = 64 * TOP
_IRREGULAR = re.compile(r"\s\s")
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, tier int, step_group long")


class WordIds(dict):
    """Little-endian uint32 ids of `` word``, encoded on a miss.  In this
    vocabulary a space between two non-space characters always starts a new
    piece, so a text's ids are the concatenation over its space-separated words."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.encode(" " + word)
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    ``tokenizer_json`` defines the ids.  ``ranks`` is the same vocabulary as
    plain ranks, which encodes ordinary text about five times faster; texts
    that hold an added token's string go to the tokenizer itself."""

    def __init__(self, tokenizer_json: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._exact
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table,
                                           special_tokens={}).encode_ordinary
        self.words = WordIds(self.plain)

    def _exact(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self._exact(text), dtype="<u4").tobytes()
        if _IRREGULAR.search(text):
            return np.array(self.plain(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.plain(first), dtype="<u4").tobytes() if first else b""
        return head + b"".join(map(self.words.__getitem__, rest))


class Packer:
    """Packs the rests of one partition; ``rows`` collects finished pieces."""

    def __init__(self, partition: int, top: int, tiers: tuple[int, ...], pool: int):
        self.base = partition << 33
        self.top, self.tiers, self.pool = top, tiers, pool
        self.rests: dict[int, deque] = {t: deque() for t in tiers}
        self.rows: list[tuple] = []
        self.made = 0
        self.room: dict[int, int] = {}  # ids that the tier's open step group still takes
        self.group: dict[int, int] = {}
        self.opened = 0

    def _sequence(self, pieces: list[tuple], tier: int) -> None:
        """pieces: (doc_id, start, ids bytes, doc_tokens)."""
        if self.room.get(tier, 0) < tier:  # the tier's step group is full: open the next
            self.room[tier], self.group[tier] = STEP_TOKENS, self.opened
            self.opened += 1
        self.room[tier] -= tier
        group = self.group[tier]
        at = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc, start, length, zlib.crc32(ids), total,
                              self.base + self.made, at, tier, self.base + group))
            at += length
        self.made += 1

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total // self.top
        for i in range(whole):
            self._sequence([(doc, i * self.top, ids[i * self.top * 4:(i + 1) * self.top * 4],
                             total)], self.top)
        if total % self.top:
            tail = ids[whole * self.top * 4:]
            tier = self.tiers[bisect.bisect_left(self.tiers, total % self.top)]
            self.rests[tier].append((doc, whole * self.top, tail, total))
            if len(self.rests[tier]) >= self.pool:
                self.pack(tier)

    def pack(self, tier: int) -> None:
        """Best fit in decreasing length, then fill each window's gap."""
        items = sorted(self.rests[tier], key=lambda p: -len(p[2]))
        self.rests[tier].clear()
        gaps: list[tuple[int, int]] = []  # (free ids, window), ascending
        windows: list[list] = []
        for p in items:
            n = len(p[2]) // 4
            i = bisect.bisect_left(gaps, (n, -1))
            if i < len(gaps):
                free, w = gaps.pop(i)
            else:
                free, w = tier, len(windows)
                windows.append([])
            windows[w].append(p)
            if free > n:
                bisect.insort(gaps, (free - n, w))
        left = {w: free for free, w in gaps}
        for w, pieces in enumerate(windows):
            if w not in left:
                self._sequence(pieces, tier)
        pending = deque((windows[w], free) for free, w in gaps)
        spare: deque = deque()  # pieces of windows taken apart when shorter tiers are empty
        while pending:
            window, free = pending.popleft()
            while free:
                p = self._filler(tier)
                if p is None:
                    if not spare and pending:
                        spare.extend(pending.pop()[0])
                    if not spare:
                        break
                    p = spare.popleft()
                doc, start, ids, total = p
                n = min(free, len(ids) // 4)
                window.append((doc, start, ids[:n * 4], total))
                if n * 4 < len(ids):
                    self._route((doc, start + n, ids[n * 4:], total))
                free -= n
            if free:  # kept for the tier's next pool
                spare.extend(window)
            else:
                self._sequence(window, tier)
        for p in spare:
            self._route(p)

    def _filler(self, tier: int):
        """A rest of the longest shorter tier that has one."""
        for t in reversed(self.tiers[:self.tiers.index(tier)]):
            if self.rests[t]:
                return self.rests[t].popleft()
        return None

    def _route(self, p: tuple) -> None:
        n = len(p[2]) // 4
        self.rests[self.tiers[bisect.bisect_left(self.tiers, n)]].append(p)

    def finish(self) -> None:
        """What is left: one stream of rests, cut into binary window lengths."""
        for t in reversed(self.tiers):
            if self.rests[t]:
                self.pack(t)
        stream = [p for t in reversed(self.tiers) for p in self.rests[t]]
        for t in self.tiers:
            self.rests[t].clear()
        left = sum(len(p[2]) // 4 for p in stream)
        stream = deque(stream)
        while left:
            size = min(self.top, 1 << (left.bit_length() - 1))
            window, free = [], size
            while free:
                doc, start, ids, total = stream.popleft()
                n = min(free, len(ids) // 4)
                window.append((doc, start, ids[:n * 4], total))
                if n * 4 < len(ids):
                    stream.appendleft((doc, start + n, ids[n * 4:], total))
                free -= n
            self._sequence(window, self.tiers[bisect.bisect_left(self.tiers, size)])
            left -= size


def pack_documents(docs: DataFrame, tokenizer_json: str, ranks: str | None = None,
                   pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   top: int = TOP, tiers: tuple[int, ...] = TIERS, pool: int = POOL,
                   end_id: int = 0) -> DataFrame:
    """One row per piece (``SCHEMA``).  ``tiers`` are powers of two ending in ``top``."""
    ship_package(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                       ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                       ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
                       ("step_group", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encode = Encoder(tokenizer_json, ranks, pattern)
        packer = Packer(TaskContext.get().partitionId(), top, tuple(tiers), pool)

        def flush():
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, (encode(text.as_py()) if text.is_valid else b"") + end)
                if len(packer.rows) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
