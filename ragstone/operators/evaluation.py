"""Scoring rankings against gold answers. A gold answer that is not ranked scores 0 everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import has_article


def gold_ranks(queries: DataFrame, ranking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, qid, grp?, rank)``: the first place of a query's gold id; null if it is not ranked.

    ``queries (qid, gold[, grp])`` may hold several gold rows of a query: the best place counts.
    ``by`` names columns of the ranking (a retriever, a model) that split it.
    """
    keep = [c for c in ("grp",) if c in queries.columns]
    base = queries.select("qid", "gold", *keep)
    if by:
        kinds = ranking.select(*by).distinct()
        base = base.join(kinds, F.lit(True))
    hits = base.join(ranking.select(*by, "qid", F.col("id").alias("gold"), "rank"), [*by, "qid", "gold"], "left")
    return hits.groupBy(*by, "qid", *keep).agg(F.min("rank").alias("rank"))


def hit_at(k: int) -> Column:
    return F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)))


def mrr(depth: int | None = None) -> Column:
    r = F.col("rank") if depth is None else F.when(F.col("rank") <= depth, F.col("rank"))
    return F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0)))


def ndcg_at(k: int) -> Column:
    return F.avg(F.when(F.col("rank") <= k, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0))


def scorecard(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Per ``by``: recall@k for every k, MRR and nDCG at the largest k, and the number of queries. No queries: no row per group."""
    aggs = {f"recall_at_{k}": hit_at(k) for k in ks} | {"mrr": mrr(), f"ndcg_at_{max(ks)}": ndcg_at(max(ks))}
    cols = [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in aggs.items()]
    return ranks.groupBy(*by).agg(F.count("*").alias("n_queries"), *cols)


def hit_scorecard(ranks: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Per ``by``: hit@k and MRR, the short card of the retriever comparison."""
    return ranks.groupBy(*by).agg(*[F.round(hit_at(k), 6).alias(f"hit_at_{k}") for k in ks], F.round(mrr(), 6).alias("mrr"))


def article_hits(retrieved: DataFrame, questions: DataFrame, by: Sequence[str] = (), ordinal_aware: bool = False, depth: int = 5) -> DataFrame:
    """art_hit@1/3/5 and MRR over the first ``depth`` chunks: a hit is a chunk whose text names the question's article.

    ``retrieved (qid, rank, text, *by)``, ``questions (qid, article)``.
    """
    base = questions.select("qid", "article")
    if by:
        base = base.join(retrieved.select(*by).distinct(), F.lit(True))
    rows = retrieved.where(F.col("rank") <= depth).join(questions, "qid").where(has_article(F.col("text"), F.col("article"), ordinal_aware))
    first = rows.groupBy(*by, "qid").agg(F.min("rank").alias("rank"))
    ranks = base.join(first, [*by, "qid"], "left")
    return ranks.groupBy(*by).agg(*[F.round(hit_at(k), 6).alias(f"art_hit_at_{k}") for k in (1, 3, 5)], F.round(mrr(depth), 6).alias("mrr"))


def document_hits(retrieved: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """Share of questions whose expected document is among the sources of the first ``k`` chunks: ``(questions, hits, hit_rate)``.

    Only questions with ``in_corpus`` true and a document count.
    """
    asked = questions.where("in_corpus and doc is not null").select("qid", "doc")
    got = retrieved.where(F.col("rank") <= k).select("qid", F.col("source").alias("doc")).distinct().withColumn("hit", F.lit(1))
    return asked.join(got, ["qid", "doc"], "left").agg(
        F.count("*").alias("questions"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        F.round(F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")), 6).alias("hit_rate"))


def top1_distance(ranking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(avg_top1_dist)``: the mean distance of the nearest chunk; comparable within one model only."""
    return ranking.where("rank = 1").groupBy(*by).agg(F.round(F.avg("distance"), 6).alias("avg_top1_dist"))


def reference_noise(retrieved: DataFrame, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(ref_noise)``: the share of retrieved chunks that are bibliography."""
    return retrieved.groupBy(*by).agg(F.round(F.avg(flag.cast("int")), 6).alias("ref_noise"))


def leaderboard(rows: DataFrame, score: str = "mrr") -> DataFrame:
    """Rows by score, best first; a missing score counts as 0."""
    return rows.orderBy(F.desc(F.coalesce(F.col(score), F.lit(0.0))), *[c for c in ("model",) if c in rows.columns])
