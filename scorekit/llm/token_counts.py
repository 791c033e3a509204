"""Token counts without ids: pieces are counted once per distinct pre-token.

A byte-pair tokenizer never merges across pre-tokens, so a text's token count is the
sum over its pre-tokens of their pieces.

1. One pass splits the texts.  It numbers the distinct pre-tokens of a *block* of documents
   as they come and writes each document's frequencies (number, count), and the block's
   dictionary (number, pre-token) behind them.
2. The dictionaries are shuffled by pre-token.  A pre-token is split into pieces once,
   wherever it occurs, and only the number of pieces goes back to its blocks.
3. Frequencies meet the piece counts of their block, and products are summed per document.

No list of ids is ever built, kept or moved.  What shuffles by pre-token is a row per
*distinct* pre-token of a block, some percent of the tokens.  A pre-token that every
document uses has one row a block, so no key is hot; and a block ends at ``BLOCK_TOKENS``
distinct pre-tokens or ``BLOCK_PAIRS`` frequencies, so a group of the last step is of
bounded size, however long a document is.  Nothing is broadcast or collected.

Pre-tokens are found with ``pattern``, the tokenizer's own split rule, by the
``regex`` module.  Its Unicode tables and the tokenizer's may differ in young characters, so
texts that hold one which Python's own (older) table does not know go to the tokenizer's
own splitter.  The strings of added tokens are cut out first, as the library does.
Without a pattern the tokenizer's own normalizer and splitter do it all.

Edge cases: null and empty texts have 0 tokens and 0 bytes; null ids and repeated rows
are ordinary rows (rows are told apart by their place in the written frequencies); a very
long text is split ``PART`` characters at a time, at a space between two other
characters, where a pre-token always starts, and its frequencies are written in rows of
``CHUNK`` distinct pre-tokens, which may lie in several blocks; ties do not arise; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: Distinct pre-tokens, and frequencies, at which a block ends.
BLOCK_TOKENS, BLOCK_PAIRS = 1 << 19, 1 << 22
#: Characters of a text that are split at a time, and frequencies a written row.
PART, CHUNK = 1 << 20, 1 << 16
#: Documents a written row at most.
ROW_DOCS = 256
#: Bits of a number within its block: a block ends soon after BLOCK_TOKENS.
NUMBER_BITS = 20
#: Dictionary entries that are split into pieces and sorted at a time.
ENCODE = 1 << 14
_CUT = re.compile(r"(?<=\S) (?=\S)")


class PreTokens:
    """Pre-token frequencies of whole texts."""

    def __init__(self, tokenizer_json: str, pattern: str | None = None, part: int = PART):
        import regex
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_json)
        self.split, self.normalize = tok.pre_tokenizer, tok.normalizer
        tokens = tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that take in their surroundings are not supported")
        added = sorted((t.content for t in tokens), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.find = regex.compile(pattern).findall if pattern else None
        self.old = set(map(chr, range(128)))  # characters found to be in the older table
        self.part = part if pattern and not any(" " in a for a in added) else None

    def young(self, text: str) -> bool:
        """Does the text hold a character that Python's Unicode table has no entry for?"""
        if text.isascii():
            return False
        new = set(text) - self.old
        self.old.update(c for c in new if unicodedata.category(c) != "Cn")
        return not new <= self.old

    def parts(self, text: str) -> Iterator[str]:
        """The text in pieces of about ``part`` characters."""
        at = 0
        while self.part and len(text) - at > self.part:
            cut = _CUT.search(text, at + self.part)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def plain(self, text: str) -> list[str]:
        if self.find and not self.young(text):
            return self.find(text)
        if self.find:
            return [text[i:j] for _, (i, j) in self.split.pre_tokenize_str(text)]
        text = self.normalize.normalize_str(text) if self.normalize else text
        return [w for w, _ in self.split.pre_tokenize_str(text)]

    def __call__(self, text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        for part in self.parts(text):
            if self.added and self.added.search(part):
                for i, s in enumerate(self.added.split(part)):
                    out.update([s] if i % 2 else self.plain(s))
            else:
                out.update(self.plain(part))
        return out


def packed(sizes: list[int], numbers: list[int], counts: list[int]) -> bytes:
    """Frequencies of several documents, of ``sizes`` pairs each, in a byte or two a pair:
    numbers sorted within a document, their steps and the counts by byte planes, zipped."""
    number = np.array(numbers, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((number, doc))
    number = number[order]
    step = np.diff(number, prepend=0)
    starts = np.cumsum([0, *sizes[:-1]])[np.array(sizes) > 0]
    step[starts] = number[starts]
    both = np.concatenate([step, np.array(counts, np.int64)[order]]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(sizes: np.ndarray, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts that :func:`packed` took."""
    planes = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(4, -1)
    step, counts = np.split(planes.T.copy().view("<u4").ravel().astype(np.int64), 2)
    number = np.cumsum(step)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return number - np.repeat(number[starts] - step[starts], sizes[sizes > 0]), counts


class Block:
    """Frequencies and dictionary of some documents, as rows to write: rows of several
    documents' frequencies, then rows of the dictionary."""

    SCHEMA = ("block long, row array<long>, doc_id array<{id}>, n_bytes array<long>, "
              "pieces array<int>, sizes array<int>, payload binary, "
              "first int, tokens array<string>")

    def __init__(self, block: int, id_type: pa.DataType):
        self.block, self.id_type = block, id_type
        self.number: dict[str, int] = {}
        self.pairs = 0
        self._start()

    def _start(self) -> None:
        self.docs: list[tuple] = []  # row, id, bytes, rows of the document, pairs
        self.numbers: list[int] = []
        self.counts: list[int] = []

    def add(self, row: int, doc_id, n_bytes: int, pieces: int, words: list[str],
            counts: list[int]) -> None:
        number = self.number
        self.docs.append((row, doc_id, n_bytes, pieces, len(words)))
        self.numbers += [number.setdefault(w, len(number)) for w in words]
        self.counts += counts
        self.pairs += len(words)

    def full(self, tokens: int, pairs: int) -> bool:
        return len(self.number) >= tokens or self.pairs >= pairs

    def _batch(self, columns: list) -> pa.RecordBatch:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [longs, pa.list_(self.id_type), longs, ints, ints, pa.binary(), pa.int32(),
                 pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.block], pa.int64()),
             *[pa.array([c], k) for c, k in zip(columns, kinds)]],
            names=["block", "row", "doc_id", "n_bytes", "pieces", "sizes", "payload", "first",
                   "tokens"])

    def frequencies(self) -> Iterator[pa.RecordBatch]:
        """One row of the documents since the last, which are then let go."""
        if self.docs:
            columns = [list(c) for c in zip(*self.docs)]
            payload = packed(columns[-1], self.numbers, self.counts)
            yield self._batch([*columns, payload, None, None])
            self._start()

    def dictionary(self) -> Iterator[pa.RecordBatch]:
        words = list(self.number)
        for at in range(0, len(words), CHUNK):
            yield self._batch([None] * 6 + [at, words[at:at + CHUNK]])


def pre_token_counts(docs: DataFrame, tokenizer_json: str, pattern: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text", part: int = PART,
                     chunk: int = CHUNK, block_tokens: int = BLOCK_TOKENS,
                     block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Frequencies and dictionaries, written once.

    A row with ``tokens`` is a part of its block's dictionary: pre-tokens of the numbers from
    ``first`` on.  Any other row has the frequencies of several documents ``row`` as a
    ``payload``; a document is in as many such rows as its entry of ``pieces`` says."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PreTokens(tokenizer_json, pattern, part)
        partition = TaskContext.get().partitionId()
        row, block = partition << 33, None
        for b in batches:
            block = block or Block(partition << 16, b.schema.field(0).type)
            for doc_id, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                found = count(text)
                words, counts = list(found), list(found.values())
                starts = range(0, max(len(words), 1), chunk)
                for k in starts:
                    block.add(row, doc_id.as_py(), len(text.encode()), len(starts),
                              words[k:k + chunk], counts[k:k + chunk])
                    if block.full(block_tokens, block_pairs):
                        yield from block.frequencies()
                        yield from block.dictionary()
                        block = Block(block.block + 1, block.id_type)
                    elif len(block.numbers) >= chunk or len(block.docs) >= ROW_DOCS:
                        yield from block.frequencies()
                row += 1
        if block:
            yield from block.frequencies()
            yield from block.dictionary()

    ship_package(docs.sparkSession)
    return materialize(texts.mapInArrow(run, Block.SCHEMA.format(id=id_type)), "pre-tokens",
                       compression="zstd")


def piece_counts(written: DataFrame, tokenizer_json: str, pattern: str | None = None) -> DataFrame:
    """``entry, pieces`` of every dictionary entry (``block << NUMBER_BITS | number``); a
    pre-token's entries lie side by side, and it is split into pieces once."""
    entry = F.shiftleft("block", NUMBER_BITS) + F.col("first") + F.col("at")
    entries = (written.where("tokens is not null")
               .select("block", "first", F.posexplode("tokens").alias("at", "token"))
               .select(entry.alias("entry"), "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task is one thread: others would hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_json)
        added = {t.content for t in tok.get_added_tokens_decoder().values()}
        last, last_n = None, 0

        def pieces_of(words: list[str]) -> list[int]:
            if pattern:
                return [len(e) for e in tok.encode_batch(words, add_special_tokens=False)]
            # split already, in the model's own alphabet
            return [1 if w in added else len(tok.model.tokenize(w)) for w in words]

        for b in batches:
            for at in range(0, b.num_rows, ENCODE):
                some = b.slice(at, ENCODE)
                runs = [(w, len(list(same))) for w, same in groupby(some.column(1).to_pylist())]
                known = runs[0][0] == last  # the run goes on from the rows before
                new = [w for w, _ in runs[known:]]
                n = [last_n] * known + (pieces_of(new) if new else [])
                last, last_n = runs[-1][0], n[-1]
                entry = some.column(0).to_numpy()
                order = np.argsort(entry)  # neighbours of a block shuffle in fewer bytes
                pieces = np.repeat(np.array(n, np.int32), [k for _, k in runs])
                yield pa.RecordBatch.from_arrays([pa.array(entry[order]), pa.array(pieces[order])],
                                                 names=["entry", "pieces"])

    ship_package(written.sparkSession)
    return (entries.repartition("token").sortWithinPartitions("token")
                   .mapInArrow(run, "entry long, pieces int"))


def _sums(frequencies: pa.Table, pieces: pa.Table) -> pa.Table:
    """Token counts of one block's documents, or parts of documents."""
    of = np.zeros(pieces.num_rows, np.int64)
    numbers = pieces.column("entry").to_numpy() & ((1 << NUMBER_BITS) - 1)
    of[numbers] = pieces.column("pieces").to_numpy()
    names = ["row", "doc_id", "n_bytes", "pieces"]
    columns: list[list] = [[] for _ in names]
    n_tokens = [np.empty(0, np.int64)]
    for i in range(frequencies.num_rows):
        for c, name in zip(columns, names):
            c.append(frequencies.column(name)[i].values)
        sizes = np.array(frequencies.column("sizes")[i].as_py(), np.int64)
        number, counts = unpacked(sizes, frequencies.column("payload")[i].as_py())
        ends = np.cumsum(sizes)
        totals = np.concatenate([[0], np.cumsum(of[number] * counts)])
        n_tokens.append(totals[ends] - totals[ends - sizes])
    kinds = [frequencies.schema.field(name).type.value_type for name in names]
    return pa.table([*[pa.chunked_array(c, k) for c, k in zip(columns, kinds)],
                     pa.array(np.concatenate(n_tokens))], names=[*names, "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` per row of ``docs``; ``sizes`` are those of
    :func:`pre_token_counts`."""
    written = pre_token_counts(docs, tokenizer_json, pattern, id_col, text_col, **sizes)
    pieces = piece_counts(written, tokenizer_json, pattern)
    id_type = written.schema["doc_id"].dataType.elementType.simpleString()
    frequencies = written.where("tokens is null").drop("first", "tokens")
    of_block = pieces.groupBy(F.shiftright("entry", NUMBER_BITS).alias("block"))
    summed = frequencies.groupBy("block").cogroup(of_block).applyInArrow(
        _sums, f"row long, doc_id {id_type}, n_bytes long, pieces int, n_tokens long")
    summed = materialize(summed, "token-sums")
    # only documents whose frequencies fill several rows are added up
    long = (summed.where("pieces > 1").groupBy("row")
                  .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                       F.sum("n_tokens").alias("n_tokens")))
    columns = ["doc_id", "n_bytes", "n_tokens"]
    return summed.where("pieces = 1").select(columns).unionByName(long.select(columns))
