"""Chunkers: a text column to an ``array<string>`` of chunks, as column expressions.

All follow the same contract: null gives null, a blank text gives no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions import vector
from ragstone.functions.text import bound, strip, words

# Fixed value: the start of an article at the start of a line, behind Markdown marks.
ARTICLE_START = "(?miuUd)^([\\s#*_>]*(?:<u>)?\\**Art[íi]culo\\s+\\d+\\s*[oº]?)"
_MARK = "\u0001"


def slide(items: Column, size: int, overlap: int) -> Column:
    """Windows over an array in closed form: one window if the items fit, then one per step until the end is reached."""
    step = max(1, size - overlap)

    def windows(it: Column) -> Column:
        n = F.size(it)
        last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(it, i * step + 1, size), " "))

    return bound(items, windows)


def fixed(text: Column, size: int = 150, overlap: int = 25) -> Column:
    """Word windows; a step below one counts as one."""
    return slide(words(text), size, overlap)


def sentences(text: Column) -> Column:
    """Cut after ``.!?`` and white space; trimmed, empty ones dropped."""
    return F.filter(F.split(strip(text), "(?<=[.!?])(?U:\\s)+"), lambda s: s != "")


def sentence_groups(text: Column, per_chunk: int = 2, overlap: int = 0) -> Column:
    return slide(sentences(text), per_chunk, overlap)


# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "vs", "etc", "e.g", "i.e", "cf", "al", "Fig", "No", "Art", "Sr", "Sra", "U.S", "approx", "pp", "vol")


def protected_sentences(text: Column) -> Column:
    """Sentences that do not break after abbreviations, initials and decimals (an approximation of a rule-based segmenter)."""
    known = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(strip(text), f"(?U)\\b({known}|\\p{{Lu}})\\.(?=\\s)", f"$1{_MARK}")
    return F.transform(F.filter(F.split(held, "(?<=[.!?])(?U:\\s)+"), lambda s: s != ""), lambda s: F.replace(s, F.lit(_MARK), F.lit(".")))


def protected_sentence_groups(text: Column, per_chunk: int = 2, overlap: int = 0) -> Column:
    return slide(protected_sentences(text), per_chunk, overlap)


def recursive(text: Column, size: int = 40) -> Column:
    """Whole sentences packed up to ``size`` words; a longer sentence closes the chunk and is cut into word windows."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def close(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])

    def add(acc: Column, s: Column) -> Column:
        n = F.size(words(s))
        none = F.array().cast("array<string>")
        return (
            F.when(n > size, F.struct(F.concat(close(acc), slide(words(s), size, 0)).alias("done"), none.alias("open"), F.lit(0).alias("n")))
            .when(acc["n"] + n > size, F.struct(close(acc).alias("done"), F.array(s).alias("open"), n.alias("n")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(s)).alias("open"), (acc["n"] + n).alias("n")))
        )

    return F.aggregate(sentences(text), empty, add, close)


def article_blocks(text: Column) -> Column:
    """The text cut before every article start; the first element is the preamble (may be empty)."""
    return F.split(F.regexp_replace(text, ARTICLE_START, _MARK + "$1"), _MARK, -1)


def article_spans(text: Column) -> Column:
    """From each article start to the next; no preamble, untrimmed, none without articles."""
    return F.when(F.regexp_like(text, F.lit(ARTICLE_START)), F.slice(article_blocks(text), 2, 1 << 30)).otherwise(F.array().cast("array<string>"))


def by_article(text: Column, max_words: int = 250, overlap: int = 25) -> Column:
    """One chunk per article, line breaks kept; longer ones in word windows; without articles word windows of the whole text."""
    blocks = F.filter(F.transform(article_blocks(text), strip), lambda b: b != "")
    cut = F.flatten(F.transform(blocks, lambda b: F.when(F.size(words(b)) <= max_words, F.array(b)).otherwise(slide(words(b), max_words, overlap))))
    return F.when(F.regexp_like(text, F.lit(ARTICLE_START)), cut).otherwise(fixed(text, max_words, overlap))


# Strategies by name, as compared in the chunking study.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "fixed-150/25": lambda c: fixed(c, 150, 25),
    "fixed-400/40": lambda c: fixed(c, 400, 40),
    "recursive-150": lambda c: recursive(c, 150),
    "by-article": lambda c: by_article(c, 250, 25),
}


def explode_chunks(docs: DataFrame, chunker: Callable[[Column], Column], text_col: str = "text", out: str = "chunk") -> DataFrame:
    """One row per chunk with ``chunk_index`` (from 0); the text column is replaced by ``out``."""
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(chunker(F.col(text_col))).alias("chunk_index", out))


def strategy_chunks(docs: DataFrame, strategies: dict[str, Callable[[Column], Column]] | None = None, text_col: str = "text") -> DataFrame:
    """Every strategy over every document in one pass over the input, tagged with ``strategy``."""
    made = F.array(*[F.struct(F.lit(n).alias("strategy"), f(F.col(text_col)).alias("chunks")) for n, f in (strategies or STRATEGIES).items()])
    keep = [c for c in docs.columns if c != text_col]
    wide = docs.select(*keep, F.explode(made).alias("s")).select(*keep, "s.strategy", F.posexplode("s.chunks").alias("chunk_index", "chunk"))
    return wide


def parent_child(docs: DataFrame, parent: Callable[[Column], Column], child: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """``(..., parent_index, parent, child_index, child)``: small chunks to search in, each with the larger chunk that is handed on. Narrow."""
    keep = [c for c in docs.columns if c != text_col]
    parents = docs.select(*keep, F.posexplode(parent(F.col(text_col))).alias("parent_index", "parent"))
    return parents.select(*keep, "parent_index", "parent", F.posexplode(child(F.col("parent"))).alias("child_index", "child"))


def semantic(sentence_rows: DataFrame, doc_col: str, order_col: str, text_col: str, vec_col: str, threshold: float = 0.5) -> DataFrame:
    """``(doc, chunk_index, chunk, n_sentences)``: a new chunk where neighbours' similarity is strictly below the threshold.

    Neighbour similarity is a lag, chunks are islands of a running sum, both in
    one window; the document is the unit of parallelism.
    """
    w = Window.partitionBy(doc_col).orderBy(order_col)
    sim = F.round(vector.dot(F.col(vec_col), F.lag(vec_col).over(w)), 9)  # equal on any engine
    flagged = sentence_rows.withColumn("_break", F.coalesce((sim < threshold).cast("int"), F.lit(0)))
    grouped = flagged.select(doc_col, F.col(order_col).alias("_o"), F.col(text_col).alias("_t"), F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_chunk"))
    got = grouped.groupBy(doc_col, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_r"))
    return got.select(doc_col, F.col("_chunk").cast("int").alias("chunk_index"), F.array_join(F.transform("_r", lambda r: r["_t"]), " ").alias("chunk"), F.size("_r").alias("n_sentences"))


def apply_chunker(docs: DataFrame, chunker: Callable[[str], list[str]], text_col: str = "text", out: str = "chunk") -> DataFrame:
    """Plug-in point for a Python chunker (text -> list of texts), in Arrow batches."""
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows, nos, parts = [], [], []
            for r, text in enumerate(t.column(text_col).to_pylist()):
                for i, part in enumerate(chunker(text) if text is not None else []):
                    rows.append(r)
                    nos.append(i)
                    parts.append(part)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(c).take(at) for c in keep] + [pa.array(nos, pa.int32()), pa.array(parts, pa.string())], names=[*keep, "chunk_index", out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return docs.select(*keep, text_col).mapInArrow(run, f"{fields}, chunk_index int, `{out}` string")
