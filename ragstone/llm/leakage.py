"""Evaluation texts leaking into training text: a prefix-filtered set join.

A leaked passage is a window of ``window`` consecutive words of an item that
stands in a document. As a set of five-word shingles, a window must be contained
whole, so its prefix under containment 1 is a single shingle: the rarest one in
the corpus. Only documents holding the rarest shingle of some window can leak;
each hit fixes the alignment of document and item, so positional bounds are
exact, and the words of the whole window are compared there.

Spark plan: the corpus is tokenised once (narrow, Arrow). Shingle counts of the
corpus are only needed for shingles of items: the corpus shingles meet the
items' shingles in an inner join, Spark broadcasts the items' side while it is
under the broadcast threshold and shuffles otherwise. The surviving positions
(a sliver of the corpus) are written once, counted, reduced to the prefixes, and
verified. No corpus text is gathered anywhere.

Defined results
---------------
* Words: longest runs of letters and digits after lower-casing and removing accents.
* Null and short texts (under ``window`` words) on either side leak nothing.
* A passage occurring several times counts once per document and item; copies of
  documents or items are rows of their own.
* Extra columns are ignored; empty input, empty output.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.session import materialize, spread

SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    if not text:
        return []
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return _WORD.findall(t)


def _hashed(df: DataFrame, keep: str) -> DataFrame:
    """``keep`` columns plus ``shingles``: the 64-bit hash of every five-word shingle in order, and ``words``: every word's hash."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches):
        known: dict[str, int] = {}
        for t in batches:
            shingles, hashes = [], []
            for text in t.column("text").to_pylist():
                w = plain_words(text)
                h = np.empty(len(w), np.int64)
                for i, x in enumerate(w):
                    v = known.get(x)
                    if v is None:
                        if len(known) > 500_000:
                            known.clear()
                        v = known[x] = xxhash.xxh64_intdigest(x) - (1 << 63)
                    h[i] = v
                hashes.append(h)
                n = max(0, len(w) - SHINGLE + 1)
                s = np.zeros(n, np.uint64)
                for k in range(SHINGLE):  # a polynomial of the word hashes
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n].view(np.uint64)
                    s ^= s >> np.uint64(29)
                shingles.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [t.column(c) for c in names] + [pa.array(shingles, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))],
                names=[*names, "shingles", "words"],
            )

    return df.select(*names, "text").mapInArrow(run, keep + ", shingles array<bigint>, words array<bigint>")


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    parts: tuple[str, ...] = ("question", "answer"), window: int = 12,
) -> DataFrame:
    """``(doc_id, item_id, part, matched_words)``: the longest leaked run of consecutive words of each part of an item in each document."""
    if window < SHINGLE:
        raise ValueError(f"a window has at least {SHINGLE} words")
    span = window - SHINGLE + 1  # shingles of a window
    long = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("text")) for p in parts])).alias("p"))
    asked = _hashed(long.select("item_id", "p.part", "p.text").where("text is not null and item_id is not null"), "item_id bigint, part string")
    asked = materialize(asked.where(F.size("shingles") >= span), "leak")
    places = asked.select("item_id", "part", F.posexplode("shingles").alias("item_pos", "shingle"))
    wanted = places.select("shingle").distinct()

    corpus = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kind = corpus.schema["doc_id"].dataType.simpleString()
    hashed = _hashed(spread(corpus), f"doc_id {kind}").where(F.size("shingles") >= span)
    found = materialize(hashed.select("doc_id", F.posexplode("shingles").alias("doc_pos", "shingle")).join(wanted, "shingle"), "leak")

    # rarity in the corpus; a shingle that no document holds rules out every window it is part of
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "shingle", "left")
    by_item = Window.partitionBy("item_id", "part").orderBy("item_pos").rowsBetween(0, span - 1)
    windows = ranked.withColumns({
        "held": F.count("n").over(by_item),
        "rarest": F.min(F.struct(F.coalesce("n", F.lit(0)), "shingle", "item_pos")).over(by_item),
    }).where(F.col("held") == span)
    prefix = windows.select("item_id", "part", F.col("item_pos").alias("window_pos"), F.col("rarest.shingle").alias("shingle"), F.col("rarest.item_pos").alias("item_pos"))

    # one prefix per window; positional bound: the window must fit into the document at this alignment
    hits = found.join(prefix, "shingle").withColumn("shift", F.col("doc_pos") - F.col("item_pos")).where(F.col("shift") + F.col("window_pos") >= 0)
    spots = materialize(hits.select("doc_id", "item_id", "part", "window_pos", "shift").distinct(), "leak")
    # verification of whole windows, word by word, for the documents that have a hit
    texts = _hashed(corpus.join(spots.select("doc_id").distinct(), "doc_id", "left_semi"), f"doc_id {kind}").select("doc_id", F.col("words").alias("dw"))
    joined = spots.join(texts, "doc_id").join(asked.select("item_id", "part", F.col("words").alias("iw")), ["item_id", "part"])
    here = F.slice("iw", F.col("window_pos") + 1, window)
    there = F.slice("dw", F.col("window_pos") + F.col("shift") + 1, window)
    sure = joined.where((F.size(there) == window) & (here == there)).select("doc_id", "item_id", "part", "window_pos", "shift")
    # neighbouring windows on one alignment are one longer passage (gaps and islands)
    line = Window.partitionBy("doc_id", "item_id", "part", "shift").orderBy("window_pos")
    runs = sure.withColumn("island", F.col("window_pos") - F.row_number().over(line)).groupBy("doc_id", "item_id", "part", "shift", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id", "item_id", "part").agg((F.max("n") + window - 1).cast("int").alias("matched_words"))


def leaked_pairs(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    return leaks(docs, items, **kw).select("doc_id", "item_id").distinct()


def leakage_by_item(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``(item_id, documents, longest)`` of every item that leaked."""
    return leaks(docs, items, **kw).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("matched_words").alias("longest"))
