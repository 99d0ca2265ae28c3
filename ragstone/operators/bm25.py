"""BM25 as relations: postings, document frequencies and an equi-join on terms.

Statistics are aggregations with map-side combine; scoring joins the terms of
the queries with the postings, so only documents sharing a term are touched.
Documents without any query term score 0 and still have a place in the ranking,
after all others in id order: a top-k is filled up from the smallest ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.text import tokens
from ragstone.session import materialize


SALTS = 16
MAX_RANKED_QUERIES = 10_000


class BM25:
    """Okapi BM25 over ``(id, text)``; a null text is an empty document. Ids are compared as they are (long or string)."""

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = 1.5, b: float = 0.75):
        self.k1, self.b = k1, b
        # tokenised once: statistics and postings read the same table
        self.docs = materialize(docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms")), "bm25")
        self.lengths = self.docs.select("id", F.size("terms").alias("dl"))

    def postings(self) -> DataFrame:
        """``(id, term, tf)``"""
        return self.docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    def frequencies(self) -> DataFrame:
        """``(term, df)``: documents with the term."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"))

    def corpus(self) -> DataFrame:
        """One row ``(n_docs, avgdl)``."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def idf(self) -> DataFrame:
        """``(term, df, idf)`` with idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
        total = self.corpus().first()
        n = F.lit(float(total["n_docs"]))
        return self.frequencies().withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def scores(self, queries: DataFrame, query_id: str = "qid", query_col: str = "query") -> DataFrame:
        """``(qid, id, score)`` of documents sharing a term; a term asked twice counts twice."""
        total = self.corpus().first()
        avgdl = F.lit(float(total["avgdl"] or 1.0) or 1.0)
        asked = queries.select(F.col(query_id).alias("qid"), F.explode(tokens(F.coalesce(F.col(query_col), F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("asked"))
        # only the postings of asked terms leave the scan
        wanted = asked.select("term").distinct()
        held = self.docs.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
        posts = held.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        n = F.lit(float(total["n_docs"]))
        df = posts.groupBy("term").agg(F.count("*").alias("df"))
        weight = F.col("asked") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        # the asked terms, few, carry the weights; a term is met in SALTS places, so a frequent one is not one task's work
        weighted = asked.join(df, "term").select("qid", "term", weight.alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = posts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        part = F.col("weight") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / avgdl))
        return salted.join(weighted, ["term", "salt"]).groupBy("qid", "id").agg(F.sum(part).alias("score"))

    def top_k(self, queries: DataFrame, k: int = 10, query_id: str = "qid", query_col: str = "query") -> DataFrame:
        """``(qid, id, rank, score)``, score rounded to 9 decimals for the order, ties by id, filled up with zero scores."""
        got = self.scores(queries, query_id, query_col).withColumn("score", F.round("score", 9))
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        best = materialize(got.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"), "bm25")  # read three times below
        short = queries.select(F.col(query_id).alias("qid")).join(best.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid")
        first = self.lengths.select("id").orderBy("id").limit(k)  # at most k ids can be missing
        fill = short.join(F.broadcast(first), F.lit(True)).join(best.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
        out = best.unionByName(fill.select("qid", "id", "score"))
        return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "id", "rank", "score")

    def rank_all(self, queries: DataFrame, query_id: str = "qid", query_col: str = "query") -> DataFrame:
        """Every document for every query of a stated query set (at most ``MAX_RANKED_QUERIES``), zero scores included."""
        if queries.limit(MAX_RANKED_QUERIES + 1).count() > MAX_RANKED_QUERIES:
            raise ValueError(f"more than {MAX_RANKED_QUERIES} queries; use top_k")
        base = queries.select(F.col(query_id).alias("qid")).join(self.lengths.select("id"), F.lit(True))
        got = base.join(self.scores(queries, query_id, query_col), ["qid", "id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return got.withColumn("rank", F.row_number().over(w).cast("long")).select("qid", "id", "rank", "score")
