"""Lines repeated across the documents of one source.

Every line is masked (numbers, dates, names), the masked lines of a source are
clustered by locality-sensitive hashing of their word shingles, and the clusters
found in too many documents are removed.

Spark plan: lines are exploded and masked in the JVM; one Arrow pass hashes the
masked lines; the distinct masks of a bucket (an aggregation with map-side
combine, so a line that stands in a third of all documents is folded before any
shuffle) are all compared, in blocks of about ``BLOCK`` masks. Pairs that are
linked already are skipped, which leaves the components as they are.

Defined results
---------------
* Source: equal after trimming and lower-casing. Null source or text: the row
  has no lines here and its text comes back unchanged.
* Line: the text split at ``\\n``. Normal form: trimmed, white space runs as one
  blank, lower-cased, digit runs as ``0``. Blank lines are never repeated lines.
* Two masked lines are joined if the similarity of their sets of five-word
  shingles is at least 0.8 (lines under five words: equal word sequences), or if
  they are masks of the same normal form.
* A cluster's document frequency counts distinct ids; the same id twice counts once.
* Two different lines share a 64-bit key with a chance of about n^2 / 2^65.
* Empty input: empty output. A text of which every line is removed becomes ``''``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.llm import sketch
from ragstone.session import connected_components, materialize, spread

# White space as in Python's str.isspace (Unicode, no-break spaces and separators U+001C..1F included).
WS = "(?U)[\\s\\x{1C}-\\x{1F}]+"
# Month names, English and Spanish.
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
)
BANDS, BAND_ROWS = 6, 3
BLOCK = 256
_DIGITS = re.compile("[0-9]+")
_MONTH = re.compile(rf"\b(?:{MONTHS})\b")
_NAME = re.compile(r"(?<=[^.!?] )[^\W\d_a-zà-öø-ÿ][\w'-]*(?: [^\W\d_a-zà-öø-ÿ][\w'-]*)*")


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, f"^{WS}|{WS}$", ""))


def normal_form(line: str) -> str:
    """Trimmed, white space runs as one blank, lower-cased, digit runs as 0."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def masked_form(line: str) -> str:
    """The normal form with dates and names masked: a capitalised word inside a line that has small letters is a name."""
    flat = " ".join(line.split())
    if flat != flat.upper():
        flat = _NAME.sub("Qname", flat)
    return _DIGITS.sub("0", _MONTH.sub("qmonth", flat.lower()))


def _shingles(mask: str) -> set[str]:
    w = mask.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _lines(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, line_no, line_key, mask_key, mask, keys)`` of every line that is not blank.

    The masked text and its band keys (source included) come once per batch of rows and mask.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("src"), F.col(text_col).alias("text"))
    base = base.where(F.col("src").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())

    def run(batches):
        hasher = sketch.MinHash(BANDS * BAND_ROWS, seed=3)
        for t in batches:
            ids, nos, lines, masks, texts, fresh, src_of = [], [], [], [], [], {}, []
            for i, s, text in zip(t.column("id").to_pylist(), t.column("src").to_pylist(), t.column("text").to_pylist()):
                for no, line in enumerate(text.split("\n"), 1):
                    norm = normal_form(line)
                    if not norm:
                        continue
                    mask = masked_form(line)
                    key = xxhash.xxh64_intdigest(f"{s}\n{mask}") - (1 << 63)
                    ids.append(i)
                    nos.append(no)
                    lines.append(xxhash.xxh64_intdigest(f"{s}\n{norm}") - (1 << 63))
                    masks.append(key)
                    if key in fresh:
                        texts.append(None)
                    else:
                        fresh[key] = len(texts)
                        texts.append(mask)
                        src_of.append(s.encode())
            if not ids:
                continue
            keys: list[list[int] | None] = [None] * len(ids)
            minima = hasher.minima([sketch.set_hashes(_shingles(texts[at])) for at in fresh.values()])
            for at, row, s in zip(fresh.values(), minima, src_of):
                keys[at] = [xxhash.xxh64_intdigest(row[b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes() + s, b) - (1 << 63) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(lines, pa.int64()), pa.array(masks, pa.int64()), pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "line_no", "line_key", "mask_key", "mask", "keys"],
            )

    return spread(base).mapInArrow(run, "id bigint, line_no bigint, line_key bigint, mask_key bigint, mask string, keys array<bigint>")


def _links(held: list[tuple[int, int, str]], within: bool, similarity: float) -> list[tuple[int, int]]:
    """Links ``(a, b)`` of ``(mask key, block, mask)`` that join what all pairs of enough similarity join.

    ``within``: all pairs are compared, else those of different blocks.
    """
    sets = [_shingles(text) for _, _, text in held]
    root, links = list(range(len(held))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, p in enumerate(sets):
        for j in range(i):
            q = sets[j]
            if not within and held[i][1] == held[j][1] or min(len(p), len(q)) < similarity * max(len(p), len(q)) or find(i) == find(j):
                continue
            both = len(p & q)
            if both >= similarity * (len(p) + len(q) - both):
                root[find(i)] = find(j)
                links.append((held[j][0], held[i][0]))
    return links


def _alike(bands: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of mask keys that share a bucket and whose shingle sets reach the similarity, of every bucket."""
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = bands.join(sizes, "bucket").select("bucket", "mask_key", blocks.alias("blocks"), F.pmod(F.xxhash64("mask_key"), blocks).alias("block"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("bucket", "mask_key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    need = bands.join(sizes, "bucket", "left_semi").select("mask_key").distinct()
    texts = lines.where("mask is not null").select("mask_key", "mask").join(need, "mask_key", "left_semi").groupBy("mask_key").agg(F.min("mask").alias("mask"))
    wide = members.join(texts, "mask_key").select("bucket", "lo", "hi", "mask_key", "block", "mask")
    names = ["bucket", "lo", "hi", "mask_key", "block", "mask"]

    def run(batches):
        at, held = None, []
        pack = lambda got: pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])
        for t in batches:
            got = []
            for bucket, lo, hi, key, block, mask in zip(*[t.column(c).to_pylist() for c in names]):
                if (bucket, lo, hi) != at:
                    if at is not None:
                        got += _links(held, at[1] == at[2], similarity)
                    at, held = (bucket, lo, hi), []
                held.append((key, block, mask))
            yield pack(got)
        if at is not None:
            yield pack(_links(held, at[1] == at[2], similarity))

    return wide.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "mask_key").mapInArrow(run, "a bigint, b bigint")


def repeated_lines(
    df: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "source", min_rows: int = 10, similarity: float = 0.8,
) -> DataFrame:
    """``(id, line_no, line_key, cluster, cluster_rows)`` of every line whose cluster stands in ``min_rows`` documents of its source."""
    keys = materialize(_lines(df, id_col, text_col, source_col), "lines")
    bands = materialize(keys.where("mask is not null").select("mask_key", F.explode("keys").alias("bucket")).distinct(), "lines")
    near = _alike(bands, keys, similarity)
    masks = keys.groupBy("line_key").agg(F.min("mask_key").alias("a"), F.max("mask_key").alias("z")).where("a < z").select("line_key", "a")
    same = keys.join(masks, "line_key").where("a <> mask_key").select("a", F.col("mask_key").alias("b")).distinct()
    parts = materialize(connected_components(near.unionByName(same)), "lines")
    placed = keys.join(parts, keys.mask_key == parts.node, "left").select("id", "line_no", "line_key", F.coalesce("component", "mask_key").alias("cluster"))
    # a cheap upper bound first (positions), then the exact number of documents for what is left
    often = placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("cluster")
    kept = materialize(placed.join(often, "cluster", "left_semi"), "lines")
    rows = kept.groupBy("cluster").agg(F.countDistinct("id").alias("cluster_rows")).where(F.col("cluster_rows") >= min_rows)
    return kept.join(rows, "cluster").select("id", "line_no", "line_key", "cluster", "cluster_rows")


def repeated_exact_lines(df: DataFrame, min_rows: int = 10, **kw) -> DataFrame:
    """``(id, line_no)``: of the repeated lines, those whose own normal form stands in ``min_rows`` documents."""
    found = materialize(repeated_lines(df, min_rows=min_rows, **kw).select("id", "line_no", "line_key"), "lines")
    rows = found.groupBy("line_key").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= min_rows).select("line_key")
    return found.join(rows, "line_key", "left_semi").select("id", "line_no")


def without_repeated_lines(df: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``(id, text, removed)`` of every row: the text without its repeated lines, and how many were removed."""
    found = repeated_lines(df, id_col, text_col, source_col, **kw)
    drop = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drop, "id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("long")))
    return rows.select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("removed"),
    )


def repeated_line_report(df: DataFrame, **kw) -> DataFrame:
    """``(cluster, positions, documents)``: the clusters that are removed."""
    return repeated_lines(df, **kw).groupBy("cluster").agg(F.count("*").alias("positions"), F.max("cluster_rows").alias("documents"))
