"""Second-stage ranking of candidates: a pluggable scorer over the first places of a ranking, and late interaction (MaxSim)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.text import bound, tokens

Scorer = Callable[[Column, Column], Column]


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the different tokens of the query that the text holds; null without tokens."""
    return bound(F.array_distinct(tokens(query)), lambda q: F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)))


def rerank(ranking: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Scorer = overlap_score, depth: int = 50, k: int = 5) -> DataFrame:
    """``(qid, id, rank, score, first_rank)``: the first ``depth`` candidates of each query, scored on (query, text), the best ``k``.

    ``ranking (qid, id, rank)``, ``texts (id, text)``, ``queries (qid, query)``. The
    scorer is a column function; a Python model is a pandas UDF. Candidates are
    bounded by ``depth`` per query, texts join them by id. A null score ranks last;
    ties keep the first stage's order.
    """
    pairs = ranking.where(F.col("rank") <= depth).select("qid", "id", F.col("rank").alias("first_rank"))
    wide = pairs.join(texts.select("id", "text"), "id").join(queries.select("qid", "query"), "qid")
    scored = wide.select("qid", "id", "first_rank", F.round(scorer(F.col("query"), F.col("text")), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "first_rank", "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "id", "rank", "score", "first_rank")


def maxsim(query_vectors: np.ndarray, text_vectors: np.ndarray) -> float | None:
    """Late interaction: for each query vector the best dot product with a text vector, summed. None if either side has none."""
    if not len(query_vectors) or not len(text_vectors):
        return None
    return float((query_vectors @ text_vectors.T).max(axis=1).sum())


def late_interaction(ranking: DataFrame, texts: DataFrame, queries: DataFrame, encode: Callable[[str], np.ndarray], depth: int = 50, k: int = 5) -> DataFrame:
    """``rerank`` by MaxSim: ``encode`` turns a text into the matrix of its token vectors, in Arrow batches on the workers."""
    pairs = ranking.where(F.col("rank") <= depth).select("qid", "id", F.col("rank").alias("first_rank"))
    wide = pairs.join(texts.select("id", "text"), "id").join(queries.select("qid", "query"), "qid").select("qid", "id", "first_rank", "query", "text")
    kinds = {c: wide.schema[c].dataType.simpleString() for c in ("qid", "id")}

    def run(batches):
        for t in batches:
            known: dict[str, np.ndarray] = {}  # a batch holds few queries

            def of(query: str) -> np.ndarray:
                if query not in known:
                    known[query] = encode(query)
                return known[query]

            score = [maxsim(of(q or ""), encode(x or "")) for q, x in zip(t.column("query").to_pylist(), t.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("qid"), t.column("id"), t.column("first_rank"), pa.array(score, pa.float64())], names=["qid", "id", "first_rank", "score"])

    scored = wide.mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, first_rank bigint, score double").withColumn("score", F.round("score", 9))
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "first_rank", "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "id", "rank", "score", "first_rank")
