"""Mixing sources to target weights: weighted sampling within token budgets.

Each record gets an Efraimidis-Spirakis key, an exponential variate divided by
its quality weight (from a hash of its id, so reruns agree). A source whose
budget is ``e`` times its size and a rest is taken in ``e`` complete epochs; the
rest goes to the records first in key order, by prefix sums of their tokens.

The quality weight of a record is its share of running sentences (module
``quality``), from 0.05 for none to 1.

Spark plan: tokens and quality are measured in one narrow pass and written once,
with no texts. A source's order is never built in one task: the rows are dealt
into ranges of (source, key) of about ``BUCKET_ROWS`` rows each, whatever the
keys look like; sums per source and range (a row per range) are added up, and
prefix sums run inside the ranges.

Defined results
---------------
* Size: tokens of a public tokenizer; null and empty texts have 0 tokens and are
  part of complete epochs only.
* Sources not in the targets are left out; a target without records gets 0. Null
  sources match nothing. Duplicate targets of a source are added up (the least
  ``max_repeats`` holds).
* Budget of a source: its weight's part of the sum of weights, times the total
  (default: all tokens of the target sources). A source that would have to be
  repeated more than ``max_repeats`` times is used ``max_repeats`` times and is
  reported as unreachable: the drawn mix falls short of its budget.
* The last record taken may pass the budget by less than its own size.
* Ties of keys are ordered by id. Empty input: empty output.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.llm import quality
from ragstone.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Splitting pattern of byte-level BPE vocabularies of this family (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUCKET_ROWS = 50_000


def token_counter(path: str = TOKENIZER):
    """A function text -> number of tokens; the vocabulary is read where it runs (its folder is on every node)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def sized(rows: DataFrame, common: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens, quality)`` of ``rows (id, source, text)``, written once; quality in [0.05, 1]."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        count = token_counter(path)
        for t in batches:
            n = [count(x) if x else 0 for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("source"), t.column("text"), pa.array(n, pa.int64())], names=["id", "source", "text", "tokens"])

    counted = rows.mapInArrow(run, f"id {kind}, source string, text string, tokens bigint")
    share = F.coalesce("running_share", F.lit(0.0))
    return quality.judged(counted, common, keep=("tokens",)).select("id", "source", "tokens", (0.05 + 0.95 * share).alias("quality"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: size, budget, complete epochs and rest. A row per source, no more."""
    goal = targets.where("source is not null and weight is not null").groupBy("source").agg(
        F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("records"))
    got = goal.join(per_source, "source", "left").fillna(0, ["size", "records"])
    everything = Window.partitionBy(F.lit(1))  # over the targets' few rows
    total = F.lit(total_tokens) if total_tokens else F.sum("size").over(everything)
    got = got.withColumn("budget", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(everything)), F.lit(0.0)) * total)
    reach = F.col("size") * F.col("max_repeats")
    got = got.withColumn("use", F.least("budget", reach.cast("double")))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("use") / F.col("size"))).otherwise(0).cast("long")
    return got.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("use") - F.col("epochs") * F.col("size"))).drop("use")


def mixed(
    docs: DataFrame, targets: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """``(mix, plan)``: mix is ``(id, source, tokens, repeats)`` of every record used; plan the rows of ``budgets``."""
    goals = targets.where("source is not null").select("source").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = spread(rows).where("source is not null and id is not null").join(goals, "source", "left_semi").select("id", "source", "text")
    rows = materialize(sized(rows, common, tokenizer), "mix")
    plan = materialize(budgets(rows, targets, total_tokens), "mix")
    ranges = max(1, -(-int(plan.agg(F.sum("records")).first()[0] or 0) // BUCKET_ROWS))
    # u in (0, 1) from a hash; key = -ln(u) / quality, smaller first
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.withColumn("key", -F.log(u) / F.col("quality"))
    placed = materialize(keyed.repartitionByRange(ranges, "source", "key", "id").withColumn("part", F.spark_partition_id()).select("id", "source", "tokens", "key", "part"), "mix")
    sums = placed.groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    sums = sums.withColumn("before", F.sum("in_part").over(Window.partitionBy("source").orderBy("part")) - F.col("in_part")).drop("in_part")
    order = Window.partitionBy("source", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.join(sums, ["source", "part"]).withColumn("until", F.col("before") + F.sum("tokens").over(order))
    ordered = ordered.join(plan.select("source", "epochs", "rest"), "source")
    part = ((F.col("until") - F.col("tokens")) < F.col("rest")) & (F.col("tokens") > 0)
    mix = ordered.select("id", "source", "tokens", (F.col("epochs") + part.cast("long")).alias("repeats")).where("repeats > 0")
    return mix, plan


def mix_records(docs: DataFrame, targets: DataFrame, common: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``(doc_id, source, tokens, repeats)``: the records of the mix and how often each is used."""
    return mixed(docs, targets, common, id_col=id_col, **kw)[0].withColumnRenamed("id", id_col)


def mix_shares(docs: DataFrame, targets: DataFrame, common: DataFrame, **kw) -> DataFrame:
    """Per target source: weight, size, budget, tokens drawn, share of the mix, most repeats, and whether the mix reaches the budget."""
    mix, plan = mixed(docs, targets, common, **kw)
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    got = plan.join(used, "source", "left").fillna(0, ["used_tokens", "most_repeats"])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # over the targets' few rows
    return got.select(
        "source", "weight", "max_repeats", "size", F.round("budget", 3).alias("budget"), "epochs", "used_tokens",
        F.round(F.when(all_used > 0, F.col("used_tokens") / all_used), 6).alias("share"), "most_repeats",
        # the last record drawn passes the budget, so a mix below it has met the limit of repeats
        (F.col("used_tokens") >= F.col("budget") - 1e-6 * F.greatest(F.lit(1.0), F.col("budget"))).alias("reachable"),
    )


def unreachable_sources(docs: DataFrame, targets: DataFrame, common: DataFrame, **kw) -> DataFrame:
    """``(source)`` of the targets that ``max_repeats`` keeps from their weight: their part of the drawn mix stays below the budget."""
    return mix_shares(docs, targets, common, **kw).where("not reachable").select("source")
