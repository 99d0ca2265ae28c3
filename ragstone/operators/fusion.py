"""Fusing rankings ``(qid, id, rank)`` and reshaping them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.session import sound_unions


def rrf(rankings: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of any number of lists: sum of 1 / (k + rank), equal weights.

    Ties: the place in the first list, then in the second, and so on, then the id.
    One union and one aggregation, whatever the number of lists.
    """
    sound_unions(rankings[0].sparkSession)
    tagged = [r.select("qid", "id", F.col("rank").alias("rank"), F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, tagged)
    places = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(rankings))]
    got = both.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), *places)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *[F.asc_nulls_last(f"_r{i}") for i in range(len(rankings))], "id")
    out = got.withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "id", "rank", "score")
    return out.where(F.col("rank") <= top) if top else out


def weighted_fusion(scored: list[tuple[DataFrame, float]], top: int | None = None) -> DataFrame:
    """Weighted sum of min-max scaled scores of lists ``(qid, id, score)``; a constant list scales to 0."""
    sound_unions(scored[0][0].sparkSession)
    parts = []
    for df, weight in scored:
        w = Window.partitionBy("qid")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        parts.append(df.select("qid", "id", (F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.0)) * weight).alias("score")))
    got = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.round(F.sum("score"), 12).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = got.withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "id", "rank", "score")
    return out.where(F.col("rank") <= top) if top else out


def collapse(ranking: DataFrame, owner: str, depth: int | None = None) -> DataFrame:
    """Chunk ranking to owners (documents, papers): the best place of each, ranked anew. ``ranking`` holds the column ``owner``."""
    rows = ranking.where(F.col("rank") <= depth) if depth else ranking
    best = rows.groupBy("qid", F.col(owner).alias("id")).agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy("qid").orderBy("first_rank", "id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "id", "rank", "first_rank")
