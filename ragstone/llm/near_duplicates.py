"""Near-duplicate records by multi-index hashing.

A record's fingerprint holds one bit of each of many minwise hashes of its bag
of words, so bits of two records differ with probability (1 - similarity) / 2
whatever the order of the words. The fingerprint is cut into segments. Two
records become candidates if some segment differs in at most one bit: the small
Hamming ball of every segment is enumerated against the table of that segment.
Candidates are verified by the complete distance of an independent 128-bit
fingerprint, then by the exact similarity of the texts.

Scale: segment width and number follow from the number of records and the wanted
recall at the threshold, so the matches by chance per record stay few at any
size. A segment with at most one bit differing agrees in its left or its right
half, so each segment travels twice, keyed by one half; the ball is enumerated
inside the task and never shuffled. Keys that hold more than ``block_rows``
records are split into blocks, and pairs of blocks go to different tasks. Exact
copies (equal bags) are folded first. Texts are read again for candidates only.

Defined results
---------------
* Null texts and texts with fewer than ``min_words`` words belong to no pair.
* Records with equal bags of words have similarity 1, whatever their order.
* Ids are unique; a null id is left out. Other columns are ignored.
* Empty input gives empty output.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.llm import sketch
from ragstone.session import connected_components, materialize, spread

CHECK_BITS = 128
BLOCK_ROWS = 16_384


def layout(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a segment, number of segments).

    Width grows with log2(rows) so that chance matches stay bounded; the number
    is the least with 1 - (1 - p)^m >= recall, p the chance that a segment of two
    records at the threshold differs in at most one bit.
    """
    width = int(min(48, max(16, 2 * round(0.65 * math.log2(max(2, rows))))))
    d = (1 - similarity) / 2
    p = (1 - d) ** width + width * d * (1 - d) ** (width - 1)
    return width, max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def bag_similarity(a: str, b: str) -> float:
    """Words in common, counted with repetition, by words in either."""
    x, y = Counter(sketch.words(a)), Counter(sketch.words(b))
    common = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - common
    return common / total if total else 0.0


def _fingerprints(rows: DataFrame, width: int, segments: int, min_words: int) -> DataFrame:
    """``(id, n, k1, k2, fp, c1, c2)``: bag size and key, segment bits, and the 128-bit check fingerprint."""

    def run(batches):
        hasher = sketch.MinHash(width * segments + CHECK_BITS)
        for t in batches:
            ids, bags, key1, key2 = [], [], [], []
            for i, text in zip(t.column("id").to_pylist(), t.column("text").to_pylist()):
                w = sketch.words(text)
                if len(w) < min_words:
                    continue
                canon = " ".join(sorted(w))
                ids.append(i)
                bags.append(sketch.bag_hashes(w))
                key1.append(xxhash.xxh64_intdigest(canon, 1) - (1 << 63))
                key2.append(xxhash.xxh64_intdigest(canon, 2) - (1 << 63))
            if not ids:
                continue
            bits = sketch.one_bit(hasher.minima(bags))
            seg = np.packbits(bits[:, : width * segments], axis=1)
            chk = np.packbits(bits[:, width * segments :], axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(b) for b in bags], pa.int32()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()),
                 pa.array([r.tobytes() for r in seg], pa.binary()), pa.array(chk[:, 0]), pa.array(chk[:, 1])],
                names=["id", "n", "k1", "k2", "fp", "c1", "c2"],
            )

    return spread(rows).mapInArrow(run, "id bigint, n int, k1 bigint, k2 bigint, fp binary, c1 bigint, c2 bigint")


def _keyed(classes: DataFrame, width: int, segments: int) -> DataFrame:
    """Each class 2 x segments times: key = (segment, half, bits of the half), ``other`` = bits of the other half."""
    half = width // 2

    def run(batches):
        weights = (1 << np.arange(half, dtype=np.int64))
        for t in batches:
            if t.num_rows == 0:
                continue
            n = t.num_rows
            raw = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(n, -1)
            bits = np.unpackbits(raw, axis=1)[:, : width * segments].reshape(n, segments, 2, half).astype(np.int64)
            value = bits @ weights  # n x segments x 2
            number = np.arange(segments, dtype=np.int64)[None, :, None] * 2 + np.arange(2)[None, None, :]
            key = (number << 32) | value
            other = value[:, :, ::-1]
            times = 2 * segments
            rep = lambda c, kind: pa.array(np.repeat(t.column(c).to_numpy(), times), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1)), pa.array(other.reshape(-1).astype(np.int32)), rep("id", pa.int64()), rep("n", pa.int32()), rep("c1", pa.int64()), rep("c2", pa.int64())],
                names=["key", "other", "id", "n", "c1", "c2"],
            )

    return classes.mapInArrow(run, "key bigint, other int, id bigint, n int, c1 bigint, c2 bigint")


def _ball_pairs(width: int, similarity: float):
    """The in-task step: per key, look up every row's Hamming ball (radius 1) among the rows of the key."""
    half = width // 2
    d = (1 - similarity) / 2
    far = int(min(CHECK_BITS, CHECK_BITS * d + 5 * math.sqrt(CHECK_BITS * d * (1 - d))))
    flips = np.r_[0, 1 << np.arange(half)].astype(np.int64)

    def pairs_of(block, side):
        """block: columns other, id, n, c1, c2 sorted by other. side: blocks a and b of a split key, else all one."""
        other, ids, n, c1, c2 = block
        for lo in range(0, len(ids), 4096):
            hi = min(len(ids), lo + 4096)
            probes = (other[lo:hi, None] ^ flips[None, :]).reshape(-1)
            first, last = np.searchsorted(other, probes, "left"), np.searchsorted(other, probes, "right")
            reach = last - first
            start = 0
            ends = np.cumsum(reach)
            while start < len(probes):  # matches in slices of bounded size
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, "right")))
                r = reach[start:stop]
                total = int(r.sum())
                if total:
                    a = np.repeat(lo + np.arange(start, stop) // len(flips), r)
                    b = np.arange(total) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first[start:stop], r)
                    ok = ids[a] < ids[b]
                    if side is not None:
                        ok &= side[a] != side[b]
                    a, b = a[ok], b[ok]
                    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    ok = small >= similarity * large - 1e-9
                    a, b = a[ok], b[ok]
                    dist = np.bitwise_count(c1[a] ^ c1[b]).astype(np.int32) + np.bitwise_count(c2[a] ^ c2[b])
                    ok = dist <= far
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]])], names=["a", "b"])
                start = stop

    def run(batches):
        held, at = [], None

        def done():
            cols = [np.concatenate([h[c] for h in held]) for c in range(6)]
            if len(cols[0]) > 1:
                o = np.argsort(cols[0], kind="stable")
                cols = [c[o] for c in cols]
                side = cols[5] if (cols[5] != cols[5][0]).any() else None
                yield from pairs_of(cols[:5], side)

        for t in batches:
            if t.num_rows == 0:
                continue
            key, part = t.column("key").to_numpy(), t.column("pair").to_numpy()
            cols = [t.column("other").to_numpy().astype(np.int64), t.column("id").to_numpy(), t.column("n").to_numpy(),
                    t.column("c1").to_numpy().view(np.uint64), t.column("c2").to_numpy().view(np.uint64), t.column("side").to_numpy()]
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
                mark = (key[lo], part[lo])
                if mark != at:
                    if held:
                        yield from done()
                    held, at = [], mark
                held.append([c[lo:hi] for c in cols])
        if held:
            yield from done()

    return run


def _candidates(classes: DataFrame, width: int, segments: int, similarity: float, block_rows: int) -> DataFrame:
    keyed = _keyed(classes, width, segments)
    hot = keyed.groupBy("key").count().where(F.col("count") > block_rows)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "mih")
    if hot.isEmpty():
        parts = keyed.withColumns({"pair": F.lit(0).cast("bigint"), "side": F.lit(0)})
    else:  # split keys: a row goes to every pair of blocks that its block is part of
        joined = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        joined = joined.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        joined = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        parts = joined.withColumn("pair", F.least("side", "o").cast("bigint") * 1_000_003 + F.greatest("side", "o"))
        # block pair (x, x) compares all its rows; (x, y) only rows of different blocks
        parts = parts.drop("o", "blocks")
    parts = parts.select("key", "pair", "other", "id", "n", "c1", "c2", "side")
    parts = parts.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return parts.mapInArrow(_ball_pairs(width, similarity), "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, similarity)`` of the candidates whose texts reach the threshold exactly."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(ids, "id", "left_semi")
    wide = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    )

    def run(batches):
        for t in batches:
            s = [bag_similarity(x, y) for x, y in zip(t.column("ta").to_pylist(), t.column("tb").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return wide.mapInArrow(run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similarity - 1e-12)


def near_duplicates(
    df: DataFrame, id_col: str = "id", text_col: str = "text", min_similarity: float = 0.8, min_words: int = 20,
    recall: float = 0.98, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``links (a, b, similarity)`` between classes of equal bags, ``members (id, class_id)`` of every compared record.

    A class is named by its smallest id. ``recall`` is the share of pairs exactly
    at the threshold that the candidate search must find; closer pairs are found
    more often (0.9: > 0.9999 at the default).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    width, segments = layout(rows.count(), min_similarity, recall)
    prints = materialize(_fingerprints(rows, width, segments, min_words), "mih")
    first = F.min(F.struct("id", "n", "fp", "c1", "c2"))
    classes = materialize(prints.groupBy("k1", "k2").agg(first.alias("r")).select("k1", "k2", "r.*"), "mih")
    pairs = materialize(_candidates(classes, width, segments, min_similarity, block_rows), "mih")
    links = materialize(_verified(pairs, rows, min_similarity), "mih")
    members = prints.select("id", "k1", "k2").join(classes.select("k1", "k2", F.col("id").alias("class_id")), ["k1", "k2"]).select("id", "class_id")
    return links, members


def near_duplicate_pairs(df: DataFrame, **kw) -> DataFrame:
    """``(id_a, id_b)``: every pair of records at or above the threshold, copies included, smaller id first."""
    links, members = near_duplicates(df, **kw)
    left, right = members.select(F.col("class_id").alias("a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    between = links.join(left, "a").join(right, "b").select("x", "y")
    several = members.groupBy("class_id").count().where("count > 1").select("class_id")
    twins = members.join(several, "class_id", "left_semi")
    within = (
        twins.select(F.col("class_id").alias("c"), F.col("id").alias("x"))
        .join(twins.select(F.col("class_id").alias("c"), F.col("id").alias("y")), "c").where("x < y").select("x", "y")
    )
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, **kw) -> DataFrame:
    """``(id, class_id, group_id, links)``: one row per compared record.

    ``class_id``: its exact-copy class; ``group_id``: its connected group of near
    duplicates (smallest id); ``links``: other classes its class is linked to.
    """
    links, members = near_duplicates(df, **kw)
    groups = connected_components(links, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return (
        members.join(groups, "class_id", "left").join(degree, "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
