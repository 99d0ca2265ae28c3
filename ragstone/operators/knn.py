"""Nearest neighbours of a query set: exact, with a filter, and by a stored inverted file (IVF) with measured recall.

Exact search on a cluster: items are dealt into slots once, the query set goes
to every slot once, each slot multiplies blocks of the two with numpy and emits
its best k per query, and a window keeps the best of the slots. Memory per task
is the query set plus one Arrow batch; nothing is broadcast or collected.

Ties are ordered by the smaller item id. Null vectors, zero vectors and vectors
of another length than the query's have no distance and never match.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions import vector
from ragstone.session import materialize

DIGITS = 9
MAX_COLUMN_QUERIES = 10_000
QUERY_BLOCK = 256  # queries multiplied at a time: bounds the matrix of distances


def _usable(df: DataFrame, id_col: str, vec_col: str, out: str) -> DataFrame:
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias(out), v.cast("array<double>").alias("vec")).where(F.col(out).isNotNull() & v.isNotNull() & ok)


def knn(
    items: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "id", item_vec: str = "embedding",
    query_id: str = "qid", query_vec: str = "embedding", where: Column | None = None, exclude_self: bool = False, slots: int | None = None,
) -> DataFrame:
    """``(qid, id, rank, distance)``: the ``k`` items nearest by cosine distance of every query.

    ``where`` filters the items before the ranking (it reaches the scan). ``exclude_self`` leaves out the item with the query's own id.
    """
    if where is not None:
        items = items.where(where)
    spark = items.sparkSession
    n = slots or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = _usable(items, item_id, item_vec, "key").withColumns({"slot": F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"), "kind": F.lit(1)})
    asks = _usable(queries, query_id, query_vec, "key").withColumns({"slot": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "kind": F.lit(0)})
    return ranked(_nearest_in_slots(asks.unionByName(rows).repartition(n, "slot"), k, exclude_self), k)


def _nearest_in_slots(both: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """``(qid, id, distance)``: in every slot of ``both (key, vec, slot, kind)`` the ``k`` items (kind 1) nearest to each of its queries (kind 0)."""

    def run(batches):
        at, held = None, {}
        for t in batches:
            slot, kind, key = t.column("slot").to_numpy(), t.column("kind").to_numpy(), t.column("key").to_numpy()
            vecs = t.column("vec")
            size = np.diff(vecs.offsets.to_numpy())
            for s in np.unique(slot):
                if s != at:
                    at, held = s, {}
                for d in np.unique(size[slot == s]):
                    mine = (slot == s) & (size == d)
                    for is_item in (0, 1):
                        m = np.flatnonzero(mine & (kind == is_item))
                        if not len(m):
                            continue
                        x = np.asarray(vecs.take(pa.array(m)).flatten()).reshape(-1, d)
                        x = x / np.abs(x).max(axis=1, keepdims=True)
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                        if not is_item:
                            held.setdefault(int(d), []).append((key[m], x))
                            continue
                        for qid, q in held.get(int(d), []):
                            for lo in range(0, len(qid), QUERY_BLOCK):
                                yield from best(qid[lo : lo + QUERY_BLOCK], q[lo : lo + QUERY_BLOCK], key[m], x)

    def best(qid, q, ids, x):
        dist = np.round(1.0 - q @ x.T, DIGITS)
        if exclude_self:
            dist[qid[:, None] == ids[None, :]] = np.inf
        top = min(k, len(ids))
        if top < len(ids):  # everything up to the k-th distance, so that ties are settled by id
            cut = np.partition(dist, top - 1, axis=1)[:, top - 1]
            q_at, i_at = np.nonzero(dist <= cut[:, None])
        else:
            q_at, i_at = np.nonzero(np.isfinite(dist))
        d = dist[q_at, i_at]
        keep = np.isfinite(d)
        q_at, i_at, d = q_at[keep], i_at[keep], d[keep]
        o = np.lexsort((ids[i_at], d, q_at))
        q_at, i_at, d = q_at[o], i_at[o], d[o]
        first = np.flatnonzero(np.r_[True, np.diff(q_at) != 0]) if len(q_at) else np.zeros(0, int)
        place = np.arange(len(q_at)) - np.repeat(first, np.diff(np.r_[first, len(q_at)]))
        m = place < k
        yield pa.RecordBatch.from_arrays([pa.array(qid[q_at[m]], pa.int64()), pa.array(ids[i_at[m]], pa.int64()), pa.array(np.abs(d[m]), pa.float64())], names=["qid", "id", "distance"])

    return both.sortWithinPartitions("slot", "kind").mapInArrow(run, "qid bigint, id bigint, distance double")


def ranked(scored: DataFrame, k: int | None = None, by: str = "qid", score: str = "distance", descending: bool = False) -> DataFrame:
    """``rank`` from 1 within each query; ties by the smaller id. The limit runs before the shuffle too."""
    order = F.desc(score) if descending else F.asc(score)
    w = Window.partitionBy(by).orderBy(order, "id")
    out = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    out = out.where(F.col("rank") <= k) if k else out
    return out.select(by, "id", "rank", score)


def knn_columns(items: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "id", item_vec: str = "embedding", query_id: str = "qid", query_vec: str = "embedding") -> DataFrame:
    """The same as ``knn`` in column expressions only: the checkable form, for at most ``MAX_COLUMN_QUERIES`` queries."""
    if queries.limit(MAX_COLUMN_QUERIES + 1).count() > MAX_COLUMN_QUERIES:
        raise ValueError(f"more than {MAX_COLUMN_QUERIES} queries; use knn")
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vec).alias("_q"))
    x = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_vec).alias("_x"))
    scored = x.crossJoin(q).select("qid", "id", vector.cosine_distance(F.col("_q"), F.col("_x")).alias("distance")).where(F.col("distance").isNotNull())
    return ranked(scored.withColumn("distance", F.round(F.greatest(F.lit(0.0), "distance"), DIGITS)), k)


# ------------------------------------------------------------------------------ approximate search


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        full = size > 0
        c[full] = sums[full] / size[full, None]
    return c


class IVFIndex:
    """A stored inverted file: cells around centres, probes of the nearest cells, exact distances inside them.

    ``nprobe`` is the knob between accuracy and work, as the search width of a graph
    index is. Centres are fitted on at most about ``SAMPLE_ROWS`` items; every item is
    indexed. The index is a folder: ``rows`` (id, vec, split) partitioned by cell, so a
    search reads the probed cells only, and ``cells`` (cell, n, centre). Cells of more
    than ``SPLIT_ROWS`` items are searched in splits by several tasks.
    """

    SAMPLE_ROWS, SPLIT_ROWS, MAX_CELLS = 50_000, 32_768, 4096

    def __init__(self, spark, path: str):
        """Opens a stored index. Its centres (at most ``MAX_CELLS``) are held by the driver."""
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        self.centres = np.array([r["centre"] for r in cells]).reshape(len(cells), -1)
        self.sizes = np.array([r["n"] for r in cells], np.int64)

    @classmethod
    def build(cls, items: DataFrame, path: str, item_id: str = "id", item_vec: str = "embedding", cells: int | None = None, seed: int = 0) -> "IVFIndex":
        """Fits, writes and opens an index; ``cells`` defaults to the square root of the number of items. All vectors have one length."""
        spark, path = items.sparkSession, path.rstrip("/")
        rows = _usable(items, item_id, item_vec, "id").withColumn("vec", vector.l2_normalise(F.col("vec")).cast("array<double>"))
        n = rows.count()
        cut = int(min(1.0, cls.SAMPLE_ROWS / max(1, n)) * (1 << 30))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < cut).select("vec").toArrow().column("vec").combine_chunks()
        x = np.asarray(sample.flatten()).reshape(len(sample), -1) if len(sample) else np.zeros((0, 1))
        centres = _lloyd(x, cells or max(4, min(cls.MAX_CELLS, math.isqrt(n))), seed)
        split = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")
        placed = _probes(rows, "id", centres, 1).withColumn("split", split)
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        sizes = {r["cell"]: r["n"] for r in cls._rows(spark, path).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        table = [(i, sizes.get(i, 0), [float(v) for v in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(table, "cell int, n bigint, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    @staticmethod
    def _rows(spark, path):
        return spark.read.schema("id bigint, vec array<double>, split int, cell int").parquet(f"{path}/rows")

    def _probed(self, queries: DataFrame, nprobe: int, query_id: str, query_vec: str) -> DataFrame:
        q = _usable(queries, query_id, query_vec, "qid").withColumn("vec", vector.l2_normalise(F.col("vec")).cast("array<double>"))
        return _probes(q, "qid", self.centres, min(nprobe, len(self.centres)))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 4, query_id: str = "qid", query_vec: str = "embedding") -> DataFrame:
        """``(qid, id, rank, distance)``."""
        splits = -(-np.maximum(self.sizes, 1) // self.SPLIT_ROWS)
        first = np.r_[0, np.cumsum(splits)][:-1]
        array = lambda v: F.array(*[F.lit(int(i)) for i in v])
        cell = (F.col("cell") + 1).cast("int")
        probes = materialize(self._probed(queries, nprobe, query_id, query_vec), "probe")
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most all cells
        rows = self._rows(self.spark, self.path).where(F.col("cell").isin(wanted or [-1]))  # prunes the folders
        at = F.element_at(array(first), cell)
        items = rows.select(F.col("id").alias("key"), "vec", (at + F.pmod("split", F.element_at(array(splits), cell))).alias("slot"), F.lit(1).alias("kind"))
        asks = probes.select(F.col("qid").alias("key"), "vec", F.explode(F.sequence(at, at + F.element_at(array(splits), cell) - 1)).alias("slot"), F.lit(0).alias("kind"))
        return ranked(_nearest_in_slots(asks.unionByName(items).repartition("slot"), k), k)

    def scanned(self, queries: DataFrame, nprobe: int, query_id: str = "qid", query_vec: str = "embedding") -> DataFrame:
        """``(fraction_scanned)``: items in the probed cells by all items, mean over the queries."""
        n = F.element_at(F.array(*[F.lit(int(i)) for i in self.sizes]), (F.col("cell") + 1).cast("int"))
        per = self._probed(queries, nprobe, query_id, query_vec).groupBy("qid").agg(F.sum(n).alias("n"))
        return per.agg((F.avg("n") / F.lit(float(max(1, self.sizes.sum())))).alias("fraction_scanned"))


def _probes(rows: DataFrame, id_col: str, centres: np.ndarray, nprobe: int) -> DataFrame:
    """``(id, vec, cell)`` of the ``nprobe`` cells nearest to every row."""

    def run(batches):
        for t in batches:
            if t.num_rows == 0:
                continue
            x = np.asarray(t.column("vec").flatten()).reshape(t.num_rows, -1)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            at = pa.array(np.repeat(np.arange(t.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([t.column(id_col).take(at), t.column("vec").take(at), pa.array(near.ravel())], names=[id_col, "vec", "cell"])

    return rows.select(id_col, "vec").mapInArrow(run, f"{id_col} bigint, vec array<double>, cell int")


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int = 10) -> DataFrame:
    """``(recall)``: mean over the queries of the exact neighbours found, by ``k`` (also if a query has fewer)."""
    hit = exact.select("qid", "id").join(approx.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    per = hit.groupBy("qid").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return per.agg(F.avg(F.col("hits") / F.lit(float(k))).alias("recall"))


def recall_sweep(index: IVFIndex, items: DataFrame, queries: DataFrame, k: int = 10, nprobes=(1, 2, 4, 8, 16), **cols) -> DataFrame:
    """``(method, nprobe, recall, fraction_scanned, ms_per_query, total_ms)``: the exact row (null nprobe) and one row per setting.

    Times are wall-clock times of this session, the writing of the result included.
    """
    spark = items.sparkSession
    qcols = {c: cols[c] for c in ("query_id", "query_vec") if c in cols}

    def timed(df: DataFrame) -> tuple[DataFrame, float]:
        began = time.perf_counter()
        return materialize(df, "sweep"), (time.perf_counter() - began) * 1000

    exact, flat_ms = timed(knn(items, queries, k, **cols))
    n = max(1, exact.select("qid").distinct().count())
    out = [("flat", None, recall_at_k(exact, exact, k).first()["recall"], 1.0, flat_ms / n, flat_ms)]
    for p in nprobes:
        got, ms = timed(index.search(queries, k, p, **qcols))
        out.append(("ivf", p, recall_at_k(exact, got, k).first()["recall"], index.scanned(queries, p, **qcols).first()["fraction_scanned"], ms / n, ms))
    return spark.createDataFrame(out, "method string, nprobe int, recall double, fraction_scanned double, ms_per_query double, total_ms double")
