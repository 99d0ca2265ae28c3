"""Synthetic inputs that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The slots of the sentence generator.
SUBJECTS = (
    "the biologist", "a young engineer", "the old sailor", "my neighbour", "the astronomer", "a curious student", "the chef", "an arctic fox",
    "the violinist", "a retired teacher", "the geologist", "a street vendor", "the archivist", "a marathon runner", "the beekeeper", "a night guard",
)
VERBS = ("studied", "repaired", "sketched", "measured", "photographed", "described", "collected", "compared", "restored", "counted")
OBJECTS = (
    "the coral reef", "an ancient manuscript", "the migrating birds", "a rusty steam engine", "the desert stars", "some volcanic rocks",
    "the harbour lights", "a colony of ants", "the glacier's edge", "a field of sunflowers", "the abandoned lighthouse", "the river delta",
)
PLACES = (
    "in early spring", "before the storm", "near the mountain pass", "during the festival", "at low tide", "under a full moon",
    "on the last day of summer", "far from the city", "after the harvest", "in the quiet morning",
)
CAPACITY = len(SUBJECTS) * len(VERBS) * len(OBJECTS) * len(PLACES)


def sentences(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``(id, text)``: ``n`` different sentences. The row number goes through a seeded affine permutation
    of all combinations and is read in mixed radix, so nothing is drawn twice and nothing is retried."""
    if n > CAPACITY:
        raise ValueError(f"only {CAPACITY} different sentences exist")
    step = next(a for a in range(7919 + 2 * (seed % 1000), 7919 + 2 * (seed % 1000) + CAPACITY) if math.gcd(a, CAPACITY) == 1)
    code = F.pmod(F.col("id") * step + (seed * 104_729) % CAPACITY, F.lit(CAPACITY))
    slots, parts = code, []
    for words in (SUBJECTS, VERBS, OBJECTS, PLACES):
        parts.append(F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(slots, F.lit(len(words))) + 1).cast("int")))
        slots = F.floor(slots / len(words))
    return spark.range(n).select("id", F.concat_ws(" ", *parts).alias("text"))


def held_out(queries: DataFrame, stored: DataFrame, on: str = "text") -> DataFrame:
    """Queries that are not stored rows."""
    return queries.join(stored.select(on).distinct(), on, "left_anti")


def unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``(id, embedding)``: Gaussian vectors of unit length, each number made from hashes of (id, place, seed) by Box-Muller."""
    u = lambda i, salt: (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2.0 * F.log(u(i, 1))) * F.cos(2 * math.pi * u(i, 2)))
    rows = spark.range(n).select("id", raw.alias("v")).withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("id", F.transform("v", lambda x: (x / F.col("s")).cast("float")).alias("embedding"))


def clustered_vectors(spark: SparkSession, n: int, dim: int, clusters: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """``(id, cluster, embedding)``: unit vectors around ``clusters`` seeded centres, for index tests with a meaningful curve."""
    u = lambda key, i, salt: (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    gauss = lambda key, i, salt: F.sqrt(-2.0 * F.log(u(key, i, salt))) * F.cos(2 * math.pi * u(key, i, salt + 1))
    c = F.pmod(F.col("id"), F.lit(clusters))
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: gauss(c, i, 11) + noise * gauss(F.col("id"), i, 21))
    rows = spark.range(n).select("id", c.cast("int").alias("cluster"), raw.alias("v")).withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("id", "cluster", F.transform("v", lambda x: (x / F.col("s")).cast("float")).alias("embedding"))
