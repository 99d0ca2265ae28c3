"""Corpus and chunk statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.functions.chunkers import article_spans
from ragstone.functions.text import single_blank_pieces, word_count


def chunk_stats(chunks: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``(n_chunks, avg_words)``: words are pieces between single blanks, an empty text has none."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.round(F.avg(single_blank_pieces(F.col(text_col))), 6).alias("avg_words"))


def percentiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(point, value)``: exact percentiles with linear interpolation. Nulls do not count; no values: null."""
    arr = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in points]))
    got = df.groupBy(*by).agg(arr.alias("_p"))
    return got.select(*by, F.posexplode("_p").alias("_i", "value")).select(
        *by, F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("_i") + 1).alias("point"), F.round("value", 6).alias("value"))


def fit_under_caps(df: DataFrame, value: str, caps: Sequence[int] = (150, 250, 400, 600, 800)) -> DataFrame:
    """``(cap, pct_fit, n_over)``: share of values up to each cap and how many are over it. One pass, however many caps."""
    made = F.array(*[F.struct(F.lit(c).alias("cap"), F.avg((F.col(value) <= c).cast("int")).alias("fit"), F.coalesce(F.sum((F.col(value) > c).cast("long")), F.lit(0)).alias("n_over")) for c in caps])
    return df.where(F.col(value).isNotNull()).agg(made.alias("m")).select(F.explode("m").alias("m")).select("m.cap", F.round(F.col("m.fit") * 100, 6).alias("pct_fit"), "m.n_over")


def histogram(df: DataFrame, value: str, bins: int = 30, low: float | None = None, high: float | None = None, clip: bool = False) -> DataFrame:
    """``(bin, low, high, n)``: equal bins, the last closed on both sides, empty bins included. ``clip`` moves values to the range, else they drop out."""
    v = F.col(value).cast("double")
    data = df.where(v.isNotNull()).select(v.alias("v"))
    if low is None or high is None:
        ends = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        low, high = float(ends["lo"] or 0.0), float(ends["hi"] or 0.0)
    if high <= low:
        high = low + 1.0
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col("v"))) if clip else F.col("v")
    width = (high - low) / bins
    held = data.select(x.alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    counts = held.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", F.round(low + F.col("bin") * width, 6).alias("low"), F.round(low + (F.col("bin") + 1) * width, 6).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def arg_max(df: DataFrame, value: str, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(id, value)`` of the largest value; ties: the smaller id; nulls never win."""
    best = F.min_by(F.struct(F.col(id_col).alias("id"), F.col(value).alias("value")), F.struct(-F.col(value).cast("double"), F.col(id_col)))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, "b.id", "b.value").where("id is not null")


def article_word_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, article_no, n_words)`` of every article span; no rows for documents without articles."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(article_spans(F.col(text_col))).alias("article_no", "span")).select("id", "article_no", word_count(F.col("span")).cast("long").alias("n_words"))
