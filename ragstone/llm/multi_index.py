"""Most similar vectors for every vector: an inverted multi-index.

The two halves of every (unit) vector are quantised with separate codebooks,
fitted per group; a cell is a pair of centroids. A query walks the cells in order
of the summed distance of the two centroids until the cells hold enough rows, and
the rows of these cells are reranked by their cosine similarity.

Spark plan: one narrow Arrow pass quantises the rows; exact copies are folded by
a window whose group limit runs before the shuffle; the cells, in centroid
order, are packed into bins of bounded size. A bin is searched by as many tasks
as its queries ask for (reckoned from a sample of queries): its rows go to each of
them, a query to one of them for each bin it visits. The rerank streams the
queries past the bin's rows and emits one row of its best ``k`` per query and bin;
these lists meet in one shuffle. Vectors travel as 16-bit integers (similarity
error < 2e-5). Codebooks and cell counts of a group are broadcast; groups are
handled in rounds, so that what a round broadcasts stays under ``ROUND_BYTES``.

Defined results
---------------
* Rows with a null group, a null vector, a wrong length, a non-finite number or
  only zeros are not valid: neither queries nor neighbours.
* A row is never its own neighbour; copies are neighbours with similarity 1.
* Equal similarity (to 6 decimals) is ordered by the smaller id.
* Fewer than ``k`` other rows in a group: as many as there are. Empty input:
  empty output. Other columns of the input are ignored.
* Accuracy: recall against brute force depends on ``candidates``; measured
  figures are in the README.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.session import materialize, spread

SCALE = 32767.0
BIN_ROWS = 32_768
TASK_QUERIES = 32_768
MAX_CENTROIDS = 1024
SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 2_000
ROUND_BYTES = 256 << 20


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, group_col: str, dim: int) -> DataFrame:
    """``(id, grp, vec)`` of the rows that can be compared; checks stay in the JVM."""
    v = F.col("vec")
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vec_col).alias("vec"))
        .where(F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size(v) == dim))
        .where(
            F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0)
        )
    )


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample, started from distinct points far apart."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x.astype(np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = d.argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = counts > 0
        c[full] = sums[full] / counts[full, None]
        if not full.all():  # an empty centroid restarts at a badly served point
            worst = np.argsort(d.min(1))[-(~full).sum():]
            c[~full] = x[worst]
    return c


def _chained(c: np.ndarray) -> np.ndarray:
    """The centroids reordered so that neighbours in the order are near each other (greedy nearest chain).

    Cells are packed into bins in centroid order, so the cells of one query fall into fewer bins.
    """
    left, order = list(range(1, len(c))), [0]
    while left:
        d = ((c[left] - c[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return c[order]


def centroids(rows: int) -> int:
    """Centroids per half of a group: a cell holds about 32 rows until the limit of ``MAX_CENTROIDS``."""
    return int(min(MAX_CENTROIDS, max(4, 2 ** round(math.log2(math.sqrt(rows / 32) + 1)))))


def fit_codebooks(valid: DataFrame, sizes: dict[str, int], dim: int, sample_rows: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The two codebooks of every group of ``sizes``, fitted on at most about ``sample_rows`` of its rows drawn by a hash of the id.

    A task fits a group; only codebooks reach the driver.
    """
    spark = valid.sparkSession
    shares = spark.createDataFrame([(g, min(1.0, max(sample_rows, 64) / n)) for g, n in sizes.items()], "grp string, share double")
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)) < F.col("share") * float(1 << 31)
    sample = valid.join(F.broadcast(shares), "grp").where(drawn).select("grp", "vec")

    def fit(t: pa.Table) -> pa.Table:
        g = t.column("grp")[0].as_py()
        x, k = _unit(t.column("vec"), dim), centroids(sizes[g])
        c1, c2 = _chained(_kmeans(x[:, : dim // 2], k, seed)), _chained(_kmeans(x[:, dim // 2 :], k, seed + 1))
        return pa.table({"grp": pa.array([g]), "c1": pa.array([c1.tobytes()]), "c2": pa.array([c2.tobytes()])})

    got = sample.groupBy("grp").applyInArrow(fit, "grp string, c1 binary, c2 binary").collect()
    back = lambda b, n: np.frombuffer(bytes(b), np.float32).reshape(-1, n)
    books = {r["grp"]: (back(r["c1"], dim // 2), back(r["c2"], dim - dim // 2)) for r in got}
    for g in sizes:  # a tiny group of which no row was drawn: one cell
        books.setdefault(g, (np.zeros((1, dim // 2), np.float32), np.zeros((1, dim - dim // 2), np.float32)))
    return books


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


def walk_cells(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells of one query in order of summed centroid distance, until they hold ``want`` rows.

    The multi-sequence traversal: a heap holds the frontier of the grid spanned
    by the two sorted distance lists; popping (a, b) opens (a+1, b) and (a, b+1).
    ``counts`` is the row number of each cell (flat, first half major).
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    k2 = len(o2)
    heap, seen, out, have = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and have < want:
        _, a, b = heapq.heappop(heap)
        cell = int(o1[a]) * k2 + int(o2[b])
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(o1) and y < k2 and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(d1[o1[x]] + d2[o2[y]]), x, y))
    return out


def _stairs(k1: int, k2: int, pops: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places (a, b) that a heap can reach in its first ``pops`` pops: (a+1)(b+1) <= pops."""
    a, b = [], []
    for x in range(min(k1, pops)):
        n = min(k2, pops // (x + 1))
        a.append(np.full(n, x))
        b.append(np.arange(n))
    return np.concatenate(a), np.concatenate(b)


def _walk_many(d1, d2, counts, want, stairs, pops):
    """``walk_cells`` for a block of queries, as flat arrays ``(query, cell)``.

    The first ``pops`` pops are the ``pops`` smallest sums of the stairs, so one
    partial sort replaces the heap; a query not served by them walks with the heap.
    """
    a, b = stairs
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    sums = s1[:, a] + s2[:, b]
    if pops < sums.shape[1]:
        part = np.argpartition(sums, pops - 1, axis=1)[:, :pops]
        order = np.take_along_axis(part, np.argsort(np.take_along_axis(sums, part, 1), axis=1), 1)
    else:
        order = np.argsort(sums, axis=1)
    cells = np.take_along_axis(o1, a[order], 1) * d2.shape[1] + np.take_along_axis(o2, b[order], 1)
    pop = counts[cells]
    upto = np.cumsum(pop, axis=1)
    use = (upto - pop < want) & (pop > 0)
    short = np.flatnonzero(upto[:, -1] < want) if pops < d1.shape[1] * d2.shape[1] else []
    use[short] = False
    query, place = np.nonzero(use)
    flat = cells[query, place]
    for q in short:
        walked = np.array(walk_cells(d1[q], d2[q], counts, want), np.int64)
        query, flat = np.r_[query, np.full(len(walked), q)], np.r_[flat, walked]
    return query, flat


class _Cells:
    """Non-empty cells of a group in centroid order: rows, first bin and number of bins of each, looked up by cell."""

    def __init__(self, cells: np.ndarray, rows: np.ndarray, first: np.ndarray, parts: np.ndarray, total: int):
        at = np.full(total, -1, np.int32)
        at[cells] = np.arange(len(cells), dtype=np.int32)
        self.at, self.first, self.parts = at, first, parts
        self.counts = np.zeros(total, np.int32)
        self.counts[cells] = rows


def pack_cells(rows: np.ndarray, bin_rows: int, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(first bin, bins)`` of cells in order, filled up to ``bin_rows``; a larger cell takes several bins of its own. Returns the next free bin, too."""
    first, parts, at, fill = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32), start - 1, bin_rows
    for i, m in enumerate(rows.tolist()):
        if m > bin_rows:
            parts[i] = -(-m // bin_rows)
            first[i], at, fill = at + 1, at + int(parts[i]), bin_rows
        else:
            if fill + m > bin_rows:
                at, fill = at + 1, 0
            first[i], fill = at, fill + m
    return first, parts, at + 1


def similar_vectors(
    df: DataFrame, id_col: str = "id", vec_col: str = "embedding", group_col: str = "model", k: int = 10, dim: int = 64,
    candidates: int | None = None, min_similarity: float | None = None, query: str | None = None,
    sample_rows: int = SAMPLE_ROWS, bin_rows: int = BIN_ROWS, task_queries: int = TASK_QUERIES, seed: int = 7,
) -> DataFrame:
    """``(id, neighbour_id, rank, similarity)``: of every valid row the ``k`` most similar rows of its group.

    ``candidates``: rows that a query reranks, at least; the default 18 x sqrt(rows of its group), no less than 1,000.
    ``min_similarity``: neighbours below it are left out (pairs from it on keep their rank).
    ``query``: an SQL predicate on ``id``: rows that ask; all rows are always searched.
    """
    spark = df.sparkSession
    valid = valid_vectors(df, id_col, vec_col, group_col, dim)
    sizes = {r["grp"]: r["count"] for r in valid.groupBy("grp").count().collect()}  # a row per group
    rounds, held = [{}], 0
    for g, n in sorted(sizes.items()):
        need = centroids(n) * dim * 4 + min(n, centroids(n) ** 2) * 16
        if rounds[-1] and held + need > ROUND_BYTES:
            rounds.append({})
            held = 0
        rounds[-1][g] = n
        held += need
    out = None
    for part in rounds:
        rows = valid if len(rounds) == 1 else valid.where(F.col("grp").isin(list(part)))
        got = _search(rows, part, k, dim, candidates, min_similarity, query, sample_rows, bin_rows, task_queries, seed)
        out = got if out is None else out.unionByName(got)
    return out


def _search(valid, sizes, k, dim, candidates, min_similarity, query, sample_rows, bin_rows, task_queries, seed) -> DataFrame:
    """``similar_vectors`` for the groups of ``sizes``."""
    spark = valid.sparkSession
    if not sizes:
        return spark.createDataFrame([], "id bigint, neighbour_id bigint, rank int, similarity double")
    books = fit_codebooks(valid, sizes, dim, sample_rows, seed)
    half = dim // 2
    wanted = {g: int(candidates or max(1000, 18 * math.sqrt(n))) for g, n in sizes.items()}
    sent_books = spark.sparkContext.broadcast(books)

    def encode(batches):
        for t in batches:
            if t.num_rows == 0:
                continue
            x = _unit(t.column("vec"), dim)
            q = np.rint(x * SCALE).astype("<i2")
            groups = np.array(t.column("grp").to_pylist(), dtype=object)
            cell = np.zeros(len(x), np.int64)
            for g in set(groups):
                m = groups == g
                c1, c2 = sent_books.value[g]
                cell[m] = _nearest(x[m, :half], c1).argmin(1) * len(c2) + _nearest(x[m, half:], c2).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [t.column("id"), t.column("grp"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(cell, pa.int32())],
                names=["id", "grp", "q", "cell"],
            )

    coded = spread(valid).mapInArrow(encode, "id bigint, grp string, q binary, cell int")
    # copies: the k+1 smallest ids of each distinct vector stand for all of them
    by_copy = Window.partitionBy("grp", "q")
    ranked = coded.withColumn("rn", F.row_number().over(by_copy.orderBy("id"))).where(F.col("rn") <= k + 1)
    asks = F.lit(True)
    if query:  # a vector asks if one of its copies does, or may (copies beyond the kept ones)
        asks = F.max(F.coalesce(F.expr(query), F.lit(False)).cast("int") + F.when(F.col("rn") > k, 1).otherwise(0)).over(by_copy) > 0
    ranked = ranked.withColumns({"rep": F.min("id").over(by_copy), "asks": asks})
    heads = materialize(ranked, "imi")
    reps = heads.where("rn = 1")

    # cells that hold rows: statistics, at most groups x k1 x k2 rows
    table = reps.groupBy("grp", "cell").agg(F.count("*").cast("int").alias("n")).toArrow().to_pandas().sort_values(["grp", "cell"])
    packed, bins = {}, 0
    for g, part in table.groupby("grp"):
        cells, rows = part["cell"].to_numpy(np.int32), part["n"].to_numpy(np.int32)
        first, parts, bins = pack_cells(rows, bin_rows, bins)
        packed[g] = (cells, rows, first, parts)
    tables = spark.sparkContext.broadcast(packed)

    def visits(t, lookups):
        """Of the asking rows of a batch: flat arrays (row, bin, cells held there) in blocks."""
        ids = t.column("id").to_numpy()
        asking = np.array(t.column("asks").to_pylist(), dtype=bool)
        groups = np.array(t.column("grp").to_pylist(), dtype=object)
        raw = np.frombuffer(b"".join(t.column("q").to_pylist()), "<i2").reshape(-1, dim).astype(np.float32) / SCALE
        for g in set(groups):
            c1, c2 = sent_books.value[g]
            if g not in lookups:
                total = len(c1) * len(c2)
                found = _Cells(*tables.value[g], total)
                # a small group takes more pops for as many rows
                pops = int(min(total, max(64, 2 * wanted[g] * total / found.counts.sum())))
                lookups[g] = (found, _stairs(len(c1), len(c2), pops), pops)
            look, stairs, pops = lookups[g]
            rows_g = np.flatnonzero(groups == g)
            yield "rows", g, look, rows_g, ids
            ask = rows_g[asking[rows_g]]
            for lo in range(0, len(ask), 256):
                block = ask[lo : lo + 256]
                d1, d2 = _nearest(raw[block, :half], c1), _nearest(raw[block, half:], c2)
                who, cell = _walk_many(d1, d2, look.counts, wanted[g], stairs, pops)
                at = look.at[cell]
                split = look.parts[at]
                to = look.first[at].astype(np.int64)
                if (split > 1).any():  # all bins of a split cell
                    inner = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
                    who, cell, to = np.repeat(who, split), np.repeat(cell, split), np.repeat(to, split) + inner
                key = np.sort((who << 48) | (to << 20) | cell)  # 256 queries, 2^28 bins, 2^20 cells
                who, to, cell = key >> 48, (key >> 20) & 0xFFFFFFF, key & 0xFFFFF
                start = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(to) != 0)]) if len(key) else np.zeros(0, int)
                yield "asks", g, look, (block[who[start]], to[start], np.diff(np.r_[start, len(key)]), cell), ids

    # tasks of a bin: its visits, reckoned from a sample of queries
    share = min(1.0, SAMPLE_QUERIES * len(sizes) / max(1, sum(sizes.values())))

    def sampled(batches):
        lookups: dict = {}
        for t in batches:
            for kind, _, _, got, _ in visits(t, lookups) if t.num_rows else ():
                if kind == "asks" and len(got[1]):
                    to, n = np.unique(got[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

    few = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < int(share * (1 << 30))
    counted = reps.where(few).select("id", "grp", "q", "asks").mapInArrow(sampled, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    shares = np.ones(bins, np.int64)  # tasks of each bin
    for r in counted:
        shares[r["bin"]] = max(1, math.ceil(r["n"] / share / task_queries))
    first_task = np.r_[0, np.cumsum(shares)]
    tasks = spark.sparkContext.broadcast((shares, first_task))

    def place(batches):
        """Rows to every task of their bin (kind 0), queries to one task of every bin they visit (kind 1, with the cells there)."""
        lookups: dict = {}
        n_tasks, at_task = tasks.value
        for t in batches:
            if t.num_rows == 0:
                continue
            own = t.column("cell").to_numpy()
            take, task, kinds, lens, flats = [], [], [], [], []
            for kind, _, look, got, ids in visits(t, lookups):
                if kind == "rows":
                    at = look.at[own[got]]
                    to = look.first[at] + ids[got] % look.parts[at]
                    times = n_tasks[to]
                    rows = np.repeat(got, times)
                    take.append(rows)
                    task.append(np.repeat(at_task[to], times) + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times))
                    kinds.append(np.zeros(len(rows), np.int8))
                    lens.append(np.ones(len(rows), np.int64))
                    flats.append(own[rows].astype(np.int64))
                else:
                    rows, to, n, cell = got
                    take.append(rows)
                    task.append(at_task[to] + (ids[rows] // 7919) % n_tasks[to])
                    kinds.append(np.ones(len(rows), np.int8))
                    lens.append(n)
                    flats.append(cell)
            at = pa.array(np.concatenate(take), pa.int64())
            offsets = np.r_[0, np.cumsum(np.concatenate(lens))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flats), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(task), pa.int32()), pa.array(np.concatenate(kinds), pa.int8()), t.column("id").take(at), t.column("q").take(at), lists],
                names=["task", "kind", "id", "q", "cells"],
            )

    floor = -2.0 if min_similarity is None else float(min_similarity) - 1e-4
    placed = (
        reps.select("id", "grp", "q", "cell", "asks").mapInArrow(place, "task int, kind tinyint, id bigint, q binary, cells array<int>")
        .repartitionById(int(first_task[-1]), "task").sortWithinPartitions("task", "kind")
    )
    scored = placed.mapInArrow(_reranker(dim, k, floor), "qrep bigint, near array<bigint>, similarity array<double>")
    # one row per query and bin is shuffled; the lists are opened behind it
    lists = scored.repartition("qrep").select("qrep", F.explode(F.arrays_zip("near", "similarity")).alias("z")).select("qrep", F.col("z.near").alias("nrep"), "z.similarity")
    best = Window.partitionBy("qrep").orderBy(F.desc("similarity"), "nrep")
    near = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    if min_similarity is not None:
        near = near.where(F.col("similarity") >= min_similarity)
    near = materialize(near, "imi")  # read twice below

    # distinct vectors -> rows: each vector stands for its copies, at most k+1 of them as neighbours
    member = heads.select("rep", "id", "rn")
    full = heads.where(F.col("rn") == k + 1).select("grp", "q", "rep")
    rest = coded.join(full, ["grp", "q"]).select("rep", "id").join(member.select("rep", "id"), ["rep", "id"], "left_anti")  # copies beyond the k+1 kept ones
    folded = member.where("rn > 1").select("rep").distinct()
    members = member.select("rep", "id").unionByName(rest)
    if query:
        members = members.where(F.expr(query))
    # pairs of vectors without copies are pairs of rows; only the others meet the member table
    alone = F.col("a").isNull() & F.col("b").isNull()
    marked = near.join(folded.select(F.col("rep").alias("nrep"), F.lit(1).alias("b")), "nrep", "left").join(folded.select(F.col("rep").alias("qrep"), F.lit(1).alias("a")), "qrep", "left")
    single = marked.where(alone).select(F.col("qrep").alias("id"), F.col("nrep").alias("neighbour_id"), "similarity")
    if query:
        single = single.where(F.expr(query))
    self_pairs = folded.select(F.col("rep").alias("qrep"), F.col("rep").alias("nrep"), F.lit(1.0).alias("similarity"))
    wide = (
        marked.where(~alone).select("qrep", "nrep", "similarity").unionByName(self_pairs)
        .join(member.select(F.col("rep").alias("nrep"), F.col("id").alias("neighbour_id")), "nrep")
        .join(members.select(F.col("rep").alias("qrep"), "id"), "qrep")
        .where("id <> neighbour_id").select("id", "neighbour_id", "similarity")
    )
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return (
        single.unionByName(wide).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("id", "neighbour_id", "rank", "similarity")
    )


def _reranker(dim: int, k: int, floor: float):
    """The in-task step: streams rows sorted by task and kind, a bin's rows first (bounded), then its queries in blocks."""
    block = 2048 if floor < -1 else 8192

    def flush(held):
        ids, x, cell = (np.concatenate([h[i] for h in held]) for i in range(3))
        o = np.argsort(cell, kind="stable")
        return ids[o], x[o], cell[o]

    def best_of(q, r, s, n):
        """The pairs among the best ``k`` of their query, ties with the k-th included, and the k-th similarity of every query."""
        o = np.argsort(q * 8.0 - s)  # similarity lies in [-1, 1]
        q, r, s = q[o], r[o], s[o]
        first = np.searchsorted(q, np.arange(n + 1))
        kth = np.full(n, -2.0)
        many = np.flatnonzero(np.diff(first) > k)  # one more than k: a query may meet itself
        kth[many] = s[first[many] + k]
        ok = s >= kth[q]
        return q[ok], r[ok], s[ok], kth

    def score(rid, rx, rcell, qid, qx, off, flat):
        owner = np.repeat(np.arange(len(qid)), np.diff(off))
        cells = flat[off[0] : off[-1]]
        o = np.argsort(cells, kind="stable")
        owner, cells = owner[o], cells[o]
        starts = np.flatnonzero(np.r_[True, np.diff(cells) != 0]) if len(cells) else np.zeros(0, int)
        least = np.full(len(qid), floor)
        q_out, r_out, s_out, pending = [], [], [], 0
        lows, highs = np.searchsorted(rcell, cells[starts], "left"), np.searchsorted(rcell, cells[starts], "right")
        for s, e, lo, hi in zip(starts, np.r_[starts[1:], len(cells)], lows, highs):
            who = owner[s:e]
            step = max(1, 2_000_000 // max(1, hi - lo))
            for b in range(0, len(who), step):
                w = who[b : b + step]
                sim = np.minimum(1.0, (qx[w] @ rx[lo:hi].T).astype(np.float64)).round(6)
                a, r = np.nonzero(sim >= least[w][:, None])
                q_out.append(w[a])
                r_out.append(lo + r)
                s_out.append(sim[a, r])
                pending += len(a)
                if pending > 40 * block:  # only what may still be among the best is kept
                    q, r, v, kth = best_of(np.concatenate(q_out), np.concatenate(r_out), np.concatenate(s_out), len(qid))
                    q_out, r_out, s_out, pending = [q], [r], [v], 0
                    least = np.maximum(least, kth)
        if not q_out:
            return
        q, r, s = np.concatenate(q_out), np.concatenate(r_out), np.concatenate(s_out)
        other = qid[q] != rid[r]
        q, r, s = q[other], r[other], s[other]
        o = np.lexsort((rid[r], -s, q))
        q, r, s = q[o], r[o], s[o]
        first = np.flatnonzero(np.r_[True, np.diff(q) != 0]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        best = place < k
        q, r, s = q[best], r[best], s[best]
        if not len(q):
            return
        first = np.flatnonzero(np.r_[True, np.diff(q) != 0])
        offsets = pa.array(np.r_[first, len(q)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(qid[q[first]], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(rid[r], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(s, pa.float64()))],
            names=["qrep", "near", "similarity"],
        )

    def run(batches):
        at, held, ready = None, [], None
        for t in batches:
            task, kinds, ids = t.column("task").to_numpy(), t.column("kind").to_numpy(), t.column("id").to_numpy()
            if not len(ids):
                continue
            x = np.frombuffer(b"".join(t.column("q").to_pylist()), "<i2").reshape(-1, dim).astype(np.float32) / SCALE
            lists = t.column("cells")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            edges = np.flatnonzero((np.diff(task) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(task)]):
                if kinds[lo] == 0:
                    if at != task[lo]:
                        at, held = task[lo], []
                    held.append((ids[lo:hi], x[lo:hi], flat[off[lo:hi]]))
                    ready = None
                elif at == task[lo]:
                    if ready is None:
                        ready = flush(held)
                    for b in range(lo, hi, block):
                        e = min(hi, b + block)
                        yield from score(*ready, ids[b:e], x[b:e], off[b : e + 1], flat)

    return run


def exact_similar_vectors(
    df: DataFrame, query: str, id_col: str = "id", vec_col: str = "embedding", group_col: str = "model", k: int = 10, dim: int = 64,
) -> DataFrame:
    """Brute force for a stated query set (``query``: SQL predicate on ``id``) against all rows, in blocks.

    The yardstick for recall. The queries are blocked by 2,048 and every block is
    sent to every partition of rows through a keyed repartition, not broadcast.
    """
    valid = valid_vectors(df, id_col, vec_col, group_col, dim)
    spark = df.sparkSession
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    rows = valid.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")).withColumn("kind", F.lit(1))
    asks = valid.where(F.expr(query)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("kind", F.lit(0))
    both = asks.unionByName(rows).repartition(slots, "slot").sortWithinPartitions("slot", "kind")

    def run(batches):
        qs: dict = {}
        slot_at = None
        for t in batches:
            if t.num_rows == 0:
                continue
            x, ids = _unit(t.column("vec"), dim), t.column("id").to_numpy()
            groups = np.array(t.column("grp").to_pylist(), dtype=object)
            kinds, slot_of = t.column("kind").to_numpy(), t.column("slot").to_numpy()
            for s in np.unique(slot_of):
                if s != slot_at:
                    qs, slot_at = {}, s
                for g in set(groups[slot_of == s]):
                    m = (groups == g) & (slot_of == s)
                    a, b = m & (kinds == 0), m & (kinds == 1)
                    if a.any():
                        qs.setdefault(g, []).append((ids[a], x[a]))
                    if b.any() and g in qs:
                        for qi, qx in qs[g]:
                            for lo in range(0, len(qi), 256):
                                yield from best(qi[lo : lo + 256], qx[lo : lo + 256], ids[b], x[b])

    def best(qi, qx, rid, rx):
        sim = np.minimum(1.0, qx @ rx.T).round(6)
        sim[qi[:, None] == rid[None, :]] = -9
        n = min(k, len(rid))
        cut = np.partition(sim, len(rid) - n, axis=1)[:, len(rid) - n]
        q_at, r_at = np.nonzero((sim >= cut[:, None]) & (sim > -9))  # ties with the n-th included
        v = sim[q_at, r_at]
        o = np.lexsort((rid[r_at], -v, q_at))
        q_at, r_at, v = q_at[o], r_at[o], v[o]
        first = np.flatnonzero(np.r_[True, np.diff(q_at) != 0]) if len(q_at) else np.zeros(0, int)
        place = np.arange(len(q_at)) - np.repeat(first, np.diff(np.r_[first, len(q_at)]))
        m = place < k
        yield pa.RecordBatch.from_arrays([pa.array(qi[q_at[m]], pa.int64()), pa.array(rid[r_at[m]], pa.int64()), pa.array(v[m], pa.float64())], names=["id", "neighbour_id", "similarity"])

    got = both.mapInArrow(run, "id bigint, neighbour_id bigint, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbour_id", "rank", "similarity")


def similar_pairs(df: DataFrame, min_similarity: float = 0.85, **kw) -> DataFrame:
    """``(id_a, id_b)``: pairs at or above ``min_similarity`` of which one row is in the other's top k."""
    near = similar_vectors(df, min_similarity=min_similarity, **kw)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def recall_report(df: DataFrame, query: str = "id % 100 = 0", k: int = 10, group_col: str = "model", **kw) -> DataFrame:
    """Per group and (group null) over all: recall of ``similar_vectors`` against brute force over the stated query set."""
    got = similar_vectors(df, k=k, query=query, group_col=group_col, **kw).select("id", "neighbour_id", F.lit(1).alias("hit"))
    exact = exact_similar_vectors(df, query, k=k, group_col=group_col)
    group = df.where(F.expr(query)).select("id", F.col(group_col).cast("string").alias("grp"))
    return exact.join(got, ["id", "neighbour_id"], "left").join(group, "id").rollup("grp").agg(
        F.countDistinct("id").alias("queries"), F.count("*").alias("exact_pairs"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("found_pairs"),
        F.round(F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")), 4).alias("recall"),
    )
