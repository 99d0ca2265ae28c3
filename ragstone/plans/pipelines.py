"""Whole pipelines: ingest, retrieve, fuse, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.embedders import hash_embedding
from ragstone.functions.text import cut_bibliography, is_reference_chunk
from ragstone.operators import evaluation as ev
from ragstone.operators.bm25 import BM25
from ragstone.operators.fusion import collapse, rrf
from ragstone.operators.knn import knn
from ragstone.session import materialize


def ingest(docs: DataFrame, chunker: Callable[[Column], Column], clean: bool = True, embedding: Callable[[Column], Column] = hash_embedding,
           text_col: str = "text") -> DataFrame:
    """``(..., chunk_index, text, embedding)``: bibliography cut and reference chunks dropped if ``clean``. Narrow: no shuffle."""
    text = cut_bibliography(F.col(text_col)) if clean else F.col(text_col)
    keep = [c for c in docs.columns if c != text_col]
    chunks = docs.select(*keep, F.posexplode(chunker(text)).alias("chunk_index", "text"))
    if clean:
        chunks = chunks.where(~is_reference_chunk(F.col("text")))
    return chunks.withColumn("embedding", embedding(F.col("text")))


def dense(chunks: DataFrame, queries: DataFrame, k: int, embedding: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """``(qid, id, rank, distance)`` for ``chunks (id, embedding)`` and ``queries (qid, query)``."""
    asked = materialize(queries.select("qid", embedding(F.col("query")).alias("embedding")), "asked")  # embedded once
    return knn(chunks, asked, k)


def retrieve(chunks: DataFrame, queries: DataFrame, k: int | None = 3, depth: int | None = None, rrf_k: int = 60) -> dict[str, DataFrame]:
    """The three rankings of the first ``k`` chunks (None: of all): lexical, dense, fused. ``chunks (id, text, embedding)``.

    Fusion sees every chunk in both lists, as the reference does, unless ``depth`` cuts them.
    """
    index = BM25(chunks)
    lexical = index.top_k(queries, depth) if depth else index.rank_all(queries)
    near = dense(chunks, queries, depth or max(1, chunks.count()))
    fused = rrf([near, lexical], rrf_k, k)
    cut = lambda df: (df.where(F.col("rank") <= k) if k else df).select("qid", "id", "rank")
    return {"bm25": cut(lexical), "dense": cut(near), "hybrid": fused.select("qid", "id", "rank")}


def evaluate(chunks: DataFrame, queries: DataFrame, owner: str = "source", depth: int | None = None, rrf_k: int = 60, by_group: bool = True) -> DataFrame:
    """``(retriever, grp, hit_at_1, hit_at_3, mrr)``: all retrievers in one relation, ranked by owner, scored in one aggregation."""
    rankings = retrieve(chunks, queries, depth, depth, rrf_k)
    owners = chunks.select("id", owner)
    both = None
    for name, r in rankings.items():
        papers = collapse(r.join(owners, "id"), owner).select(F.lit(name).alias("retriever"), "qid", "id", "rank")
        both = papers if both is None else both.unionByName(papers)
    ranks = ev.gold_ranks(queries, both, by=["retriever"])
    return ev.hit_scorecard(ranks, by=["retriever", "grp"] if by_group else ["retriever"])


def bake_off(chunks: DataFrame, queries: DataFrame, model: str, dim: int, owner: str = "source", depth: int = 30, embedding: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """One scorecard row of a model: dense chunks collapsed to their owners, recall@1/3/5, MRR, nDCG@5."""
    near = dense(chunks, queries, depth, embedding)
    papers = collapse(near.join(chunks.select("id", owner), "id"), owner)
    card = ev.scorecard(ev.gold_ranks(queries, papers))
    n = chunks.agg(F.count("*").alias("n_chunks"))
    return card.join(n, F.lit(True)).select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "n_chunks", "recall_at_1", "recall_at_3", "recall_at_5", "mrr", "ndcg_at_5")


def ablation(configs: dict[tuple[str, bool], DataFrame], queries: DataFrame, k: int = 3, embedding: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """``(model, clean, n_chunks, avg_top1_dist, ref_noise)`` of each (model, clean) configuration of chunks ``(id, text, embedding)``."""
    out = None
    for (model, clean), chunks in configs.items():
        got = dense(chunks, queries, k, embedding).join(chunks.select("id", "text"), "id")
        row = (
            ev.top1_distance(got).join(ev.reference_noise(got, is_reference_chunk(F.col("text"))), F.lit(True))
            .join(chunks.agg(F.count("*").alias("n_chunks")), F.lit(True))
            .select(F.lit(model).alias("model"), F.lit(clean).alias("clean"), "n_chunks", "avg_top1_dist", "ref_noise")
        )
        out = row if out is None else out.unionByName(row)
    return out
