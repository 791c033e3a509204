"""MinHash near-duplicates with sequential Bayesian verification.

1. One Arrow pass turns each whole text into its set of word shingles (64-bit
   hashes), the set's own 64-bit hash (its *node*: equal sets are one node, so
   copies never multiply) and a MinHash signature of ``N_HASHES`` values.
2. Bands of the signature bucket the nodes.  In every bucket with two nodes or
   more, each node is paired with the bucket's smallest node (its pivot): rows
   grow with the nodes, not with the square of a bucket.
3. A pair's signatures are compared batch by batch.  Under a uniform prior the
   posterior chance that the similarity reaches the threshold falls with every
   mismatch; a pair is dropped once it is below ``miss``.  The lengths of the
   sets give an exact bound besides.
4. Survivors are verified on their full sets.  Links form components.
5. Buckets that still hold three nodes or more of different components have
   pairs that no pivot covered.  All of those pairs are compared, the same way:
   a bucket is dealt by hash into blocks of about ``BLOCK`` nodes, pairs of
   blocks meet in a task, and only survivors of step 3 leave it.  So no
   candidate is dropped, and no task holds a whole bucket.  Shingles that one of
   these nodes alone has are counted first: they bound each pair exactly.
   Pairs already in one component are skipped, as their link changes nothing.

Chances: at the threshold a pair shares no band with probability
``(1 - t^ROWS)^BANDS`` (3e-6 at 0.8, 7e-9 at 0.85); ``miss`` is per batch.

Edge cases: null or empty texts, and texts without words, have the empty set,
no node and no link; fewer words than a shingle give one shingle of all words;
null ids count as larger than any id; repeated rows are one node; a very long text is a
large set, confirmed in full; a pair at the threshold is linked; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .common import bitmap_bits, bitmap_of, content_key, remove_losers, slot_of, with_bit
from .components import components

BANDS, ROWS = 32, 5
BATCH = 32
N_HASHES = 192
MISS = 1e-6
BLOCK = 256
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint32) | np.uint32(1)
_WORD_MUL = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text.

    ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts at ASCII white space."""
    import xxhash
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i:i + n] * _WORD_MUL[i % 64]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The MinHash signature; a long set is taken in chunks that fit the cache."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), chunk):
        block = (x[i:i + chunk][None, :] ^ _XOR[:, None])
        block *= _MUL[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch end, the fewest matches at which the posterior chance of a
    similarity of ``percent`` or more is still ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        chance = p[:, grid >= percent / 100].sum(axis=1) / p.sum(axis=1)
        out.append(int(np.argmax(chance >= miss)))
    return out


def survivors(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int,
              least: list[int]) -> np.ndarray:
    """Indices of the pairs that no batch rules out.  The hashes that no band
    uses come first, as the bands' own already matched in part."""
    alive = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    seen = np.zeros(len(alive), np.int64)
    for i, need in enumerate(least):
        lo = N_HASHES - (i + 1) * BATCH
        seen = seen + (a[alive, lo:lo + BATCH] == b[alive, lo:lo + BATCH]).sum(axis=1)
        keep = seen >= need
        alive, seen = alive[keep], seen[keep]
    return alive


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which two signatures agree, for each row."""
    same = (a[:, :BANDS * ROWS] == b[:, :BANDS * ROWS]).reshape(-1, BANDS, ROWS)
    return same.all(axis=2).argmax(axis=1)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, N_HASHES)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(doc_id, row, key, n, node, sig)`` per row, written once; no text is kept."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", docs_type(docs, id_col)), ("key", pa.int64()),
                        ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, node, sig = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, k)
                    n.append(len(s))
                    node.append(None if not len(s) else
                                xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()),
                     pa.array(node, pa.int64()), pa.array(sig, pa.binary())], schema=schema)

    d = docs.select(F.col(id_col).alias("doc_id"), _row_key(id_col, text_col).alias("key"),
                    F.col(text_col).cast("binary").alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    return materialize(
        d.mapInArrow(run, f"doc_id {id_type}, key long, n long, node long, sig binary")
         .withColumn("row", F.monotonically_increasing_id()), "sketches")


def docs_type(docs: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema[col].dataType)


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _verify(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures survive the sequential test."""
    least = least_matches(percent, miss)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            na, nb = (x.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ok = pa.array(survivors(_sigs(x.column(4)), _sigs(x.column(5)), na, nb, percent,
                                    least)) if x.num_rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0).take(ok), x.column(1).take(ok)],
                                             schema=schema)

    left, right = (sigs.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"),
                               F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return (pairs.join(left, "a").join(right, "b")
                 .select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long"))


def _full_sets(docs: DataFrame, id_col: str, text_col: str, k: int, sketch: DataFrame,
               nodes: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the given nodes, one row each, recomputed from one
    text per node.  A bitmap of the wanted rows keeps all other texts in place."""
    wanted = materialize(sketch.join(nodes, "node").groupBy("node").agg(F.min("key").alias("key"))
                               .select("key").distinct(), "wanted")
    n_bits = bitmap_bits(wanted.count())
    bitmap = materialize(bitmap_of(wanted.select(slot_of(F.col("key"), 3, n_bits).alias("slot"))),
                         "wanted-slots")
    d = docs.select(_row_key(id_col, text_col).alias("key"),
                    F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())
    d = with_bit(d, slot_of(F.col("key"), 3, n_bits), bitmap, "hit").where("hit")
    d = d.drop("hit").dropDuplicates(["key"]).join(wanted, "key", "left_semi")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        import xxhash
        for x in batches:
            for at in range(0, x.num_rows, 256):
                sets = [shingles(t, k).tobytes() for t in x.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in sets],
                              pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return materialize(d.select("key", "text").mapInArrow(run, "node long, shingles binary")
                        .dropDuplicates(["node"]), "sets")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, compared in whole numbers."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            ok = []
            for i, (sa, sb) in enumerate(zip(x.column(2), x.column(3))):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (sa, sb))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    ok.append(i)
            ok = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0).take(ok), x.column(1).take(ok)],
                                             schema=schema)

    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
                   for c in "ab")
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b")
                 .mapInArrow(run, "a long, b long"))


def _common_sizes(sets: DataFrame) -> DataFrame:
    """``(node, common)``: how many of a node's shingles any other given node has."""
    schema = pa.schema([("node", pa.int64()), ("shingle", pa.int64())])

    def run(batches):
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                flat = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), [len(f) for f in flat])),
                     pa.array(np.concatenate(flat))], schema=schema)

    counted = (sets.select("node", "shingles").mapInArrow(run, "node long, shingle long")
                   .groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"),
                                           F.min("node").alias("node")))
    own = counted.where("nodes = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    return materialize(size.join(own, "node", "left").select(
        "node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")), "common")


def _against_pivot(left: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, pivot, inside, extra)`` for every node of ``left`` and its buckets' pivots:
    a bit for each of the pivot's shingles that the node has, and how many of its
    other shingles any other node has."""
    schema = pa.schema([("node", pa.int64()), ("pivot", pa.int64()), ("inside", pa.binary()),
                        ("extra", pa.int64())])

    def run(batches):
        for x in batches:
            inside, extra = [], []
            for s, t, c in zip(x.column(2), x.column(3), x.column(4).to_pylist()):
                bits = np.isin(np.frombuffer(t.as_buffer(), np.uint64),
                               np.frombuffer(s.as_buffer(), np.uint64), assume_unique=True)
                inside.append(np.packbits(bits).tobytes())
                extra.append(c - int(bits.sum()))
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), pa.array(inside, pa.binary()),
                 pa.array(extra, pa.int64())], schema=schema)

    pairs = left.where("node != pivot").select("node", "pivot").distinct()
    own = sets.join(_common_sizes(sets), "node")
    pivots = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot"))
    return materialize(pairs.join(own, "node").join(pivots, "pivot").select(
        "node", "pivot", "shingles", "of_pivot", "common").mapInArrow(
        run, "node long, pivot long, inside binary, extra long"), "against-pivot")


def _rest_pairs(buckets: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Surviving pairs of different components in one bucket, the pivot's apart.

    ``buckets``: ``(bucket, band, node, root, pivot, size, inside, extra)``.  A pair leaves
    from the bucket of its first common band alone: if that one compared it with a pivot
    or held no other node, the pair was compared before.  Two sets share the
    pivot's shingles that both have, and at most the smaller of their extra parts.  That
    bounds their similarity exactly, and closely for variants of one text, which would
    otherwise leave in pairs just below the threshold."""
    least = least_matches(percent, miss)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            out_a, out_b = [], []
            for blocks, same, band in zip(x.column(0), *(x.column(i).to_pylist()
                                                         for i in (1, 2))):
                sides = [b["members"] for b in blocks.as_py()]
                if same:
                    sides = [sides[0], sides[0]]
                if len(sides) < 2:
                    continue  # the other block of the bucket got no node
                node, root, n, extra = ([np.array([m[f] for m in s]) for s in sides]
                                        for f in ("node", "root", "n", "extra"))
                inside = [np.unpackbits(np.frombuffer(b"".join(m["inside"] for m in s), np.uint8)
                                        .reshape(len(s), -1), axis=1).astype(np.float32)
                          for s in sides]
                sig = [np.frombuffer(b"".join(m["sig"] for m in s), np.uint32)
                       .reshape(-1, N_HASHES) for s in sides]
                differ = root[0][:, None] != root[1][None, :]
                most = np.rint(inside[0] @ inside[1].T) + np.minimum(extra[0][:, None],
                                                                     extra[1][None, :])
                differ &= 100 * most >= percent * (n[0][:, None] + n[1][None, :] - most)
                if same:
                    differ = np.triu(differ, 1)
                i, j = np.nonzero(differ)
                for at in range(0, len(i), 20_000):
                    p, q = i[at:at + 20_000], j[at:at + 20_000]
                    ok = survivors(sig[0][p], sig[1][q], n[0][p], n[1][q], percent, least)
                    p, q = p[ok], q[ok]
                    first = _first_band(sig[0][p], sig[1][q]) == band
                    out_a.append(node[0][p[first]])
                    out_b.append(node[1][q[first]])
            a, b = (np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_a, out_b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    d = buckets.join(sigs, "node")
    d = d.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    d = d.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    d = (d.groupBy("bucket", "band", "blocks", "block")
          .agg(F.collect_list(F.struct("node", "root", "n", "inside",
                                                     "extra", "sig")).alias("members")))
    d = d.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    d = d.groupBy("bucket", "band", F.least("block", "other").alias("lo"),
                  F.greatest("block", "other").alias("hi")).agg(
        F.collect_list(F.struct("block", "members")).alias("sides"))
    return (d.select("sides", F.expr("lo = hi").alias("same"), "band")
             .mapInArrow(run, "a long, b long").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per document: ``doc_id, row, key, n`` (set size), ``component_id`` (the
    smallest id that links reach, its own included) and ``keep_row``, the row that stands
    for the component.  Links: ``100 * intersection >= percent * union``."""
    sketch = sketches(docs, id_col, text_col, k)
    spark = docs.sparkSession
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> "
                   f"xxhash64(b, substring(sig, b * {ROWS * 4} + 1, {ROWS * 4})))")
    banded = sketch.where("n > 0").select("node", F.posexplode(bands).alias("band", "bucket"))
    shared = materialize(banded.groupBy("bucket").agg(F.min("node").alias("pivot"),
                                                      F.max("node").alias("last"))
                               .where("pivot < last").select("bucket", "pivot"), "shared")
    n_bits = bitmap_bits(shared.count())
    bitmap = materialize(bitmap_of(shared.select(slot_of(F.col("bucket"), 9, n_bits)
                                                 .alias("slot"))), "shared-slots")
    members = with_bit(banded, slot_of(F.col("bucket"), 9, n_bits), bitmap, "hit").where("hit")
    members = materialize(members.select("bucket", "band", "node").distinct()
                                 .join(shared, "bucket"), "members")
    pairs = members.where("node != pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        roots = spark.createDataFrame([], "node long, root long")
    else:
        nodes = materialize(members.select("node").distinct(), "candidates")
        sigs = materialize(sketch.select("node", "n", "sig").join(nodes, "node")
                                 .dropDuplicates(["node"]), "signatures")
        first = materialize(_verify(pairs, sigs, percent, miss), "survivors")
        ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = _full_sets(docs, id_col, text_col, k, sketch, ends(first))
        links = materialize(_exact(first, sets, percent), "links")
        roots = components(links)
        # what no pivot covered: buckets of three nodes or more in different components
        placed = members.join(roots, "node", "left").withColumn(
            "root", F.coalesce("root", "node"))
        split = materialize(placed.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("size"), F.min("root").alias("low"),
            F.max("root").alias("high")).where("size > 2 and low < high")
            .select("bucket", "size"), "split")
        left = materialize(placed.join(split, "bucket"), "left")
        if not left.isEmpty():
            more = _full_sets(docs, id_col, text_col, k, sketch, left.select("node").distinct())
            left = left.join(_against_pivot(left, more), ["node", "pivot"])
            rest = materialize(_rest_pairs(left, sigs, percent, miss), "rest")
            roots = components(links.unionByName(_exact(rest, more, percent)))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    # equal sets first, map-side; then the nodes of a component
    own = materialize(sketch.where("n > 0").groupBy("node").agg(first_row.alias("first")), "own")
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialize(own.groupBy("root").agg(F.min("first").alias("lead")), "leads")
    leads = materialize(own.join(least, "root").select(
        "node", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("keep_row")),
        "by-node")
    rows = sketch.select("doc_id", "row", "key", "n", "node")
    linked = rows.where("n > 0").join(leads, "node")
    alone = rows.where("n = 0").withColumns({"component_id": F.col("doc_id"),
                                             "keep_row": F.col("row")})
    return linked.unionByName(alone).drop("node")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all columns."""
    groups = near_groups(docs, id_col, text_col, k, percent)
    losing = (groups.groupBy(content_key("doc_id", F.col("key").cast("string")).alias("key"))
              .agg(F.max((F.col("row") == F.col("keep_row")).cast("int")).alias("keeps"),
                   F.count(F.lit(1)).alias("n")).where("keeps < n"))
    own = content_key(id_col, _row_key(id_col, text_col).cast("string"))
    return remove_losers(docs, own, losing)
