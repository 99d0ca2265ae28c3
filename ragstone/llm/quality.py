"""Per-document text quality statistics, their distributions, and the rows that are not prose.

Statistics are column expressions (no Python rows): of every document, and of
each of its units (sentences, or lines that do not go on). Distributions are held
in mergeable quantile sketches (KLL, built with map-side partial aggregation) per
language, a few kilobytes of state whatever the number of documents.

A unit is a running sentence if it does not lie in the joint tail of its
language's distributions: word count (low), mean word length (both sides), symbol
ratio (high) and share of common words (low) become robust z-scores, and the root
of the summed squares of what each has beyond 1 must not pass ``tail``. The
distributions are those of units that end in sentence punctuation and have eight
words, two of them common; the spread is taken from the side that junk does not
widen (upper half of the common share, lower half of the symbol ratio), so the
cuts follow the language and not the share of junk in it. A document with less
than half of its signs in running sentences is not prose.

Defined results
---------------
* Null or blank text: counts are 0, ratios null, language ``und``, never flagged.
* Language: of the common words found, the language with more; a tie or none is
  ``und``, judged against all languages pooled, as is a language without any sentence.
* A table without a single sentence has no running sentences.
* A spread is at least half the sampling error of its statistic in a sentence of
  the median length, so a table of equal sentences keeps a finite scale.
* Sketches have a rank error of about 1 % (KLL, k = 200); exact for small input.
* Copies count as rows of their own. Other columns are ignored. Empty input:
  empty output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import bound
from ragstone.session import materialize, spread

WS = "(?U)[\\s\\x{1C}-\\x{1F}]+"
MAX_WORDS = 5_000
STATS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "running_share")
UNIT_STATS = ("n", "mean", "symbols", "common")
RANKS = 4096  # size of the sentence sketches: rank error under 0.1 %
TAIL = 3.0  # joint robust z-score from which a unit is no sentence of its language
ENDED = "(?U)[.!?…:;][\"'”’»)\\]]*[\\s\\x{1C}-\\x{1F}]*$"


def word_lists(common: DataFrame) -> dict[str, list[str]]:
    """Common words by language; a table of over ``MAX_WORDS`` words is refused, as the list becomes part of the plan."""
    rows = common.select("lang", F.lower("word").alias("word")).dropna().distinct().orderBy("lang", "word").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    lists: dict[str, list[str]] = {}
    for r in rows:
        lists.setdefault(r["lang"], []).append(r["word"])
    return lists


def _among(known: list[str]):
    return lambda w: w.isin(known)


def _units(text: Column, known: list[str]) -> Column:
    """Per sentence or line: signs, words, letters, common words, and whether it ends in punctuation."""
    joined = F.regexp_replace(text, "\\r?\\n[ \\t]*(?=\\p{Ll})", " ")  # wrapped lines
    parts = F.split(F.regexp_replace(joined, "(?<=[.!?…])(?U:\\s)+(?=[\\p{Lu}¡¿\"'“«(\\[])|\\n+", "\u0001"), "\u0001")

    def measured(unit: Column) -> Column:
        def of(words: Column) -> Column:
            return F.struct(
                F.length(F.regexp_replace(unit, WS, "")).alias("signs"), F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("letters"),
                (F.size(F.filter(words, _among(known))) if known else F.lit(0)).alias("common"), F.right(unit, F.lit(16)).rlike(ENDED).alias("ended"))

        return bound(F.regexp_extract_all(F.lower(unit), F.lit("(\\p{L}+)"), 1), of)

    return F.filter(F.transform(parts, measured), lambda u: u["signs"] > 0)


def with_statistics(df: DataFrame, lists: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The input's rows with the columns of ``STATS`` but the running share, ``text_lang`` and ``units``.

    Every intermediate value is a column of its own, so that it is computed once.
    """
    known = sorted({w for ws in lists.values() for w in ws})
    rows = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("_tokens", F.filter(F.split("_text", WS), lambda w: w != "")).withColumn("_solid", F.array_join("_tokens", ""))
    rows = rows.withColumn("_words", F.regexp_extract_all(F.lower("_text"), F.lit("(\\p{L}+)"), 1))
    rows = rows.withColumn("_common", F.filter("_words", _among(known)) if known else F.array().cast("array<string>"))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rtrim(x) != ""))
    langs = sorted(lists)
    rows = rows.withColumns({f"_n{i}": F.size(F.filter("_common", _among(lists[lang]))) for i, lang in enumerate(langs)})
    rows = rows.withColumn("_best", F.greatest(*[F.col(f"_n{i}") for i in range(len(langs))], F.lit(0), F.lit(0)))
    # a word of two languages counts for both; the language with strictly more wins
    first = reduce(lambda acc, il: F.when((F.col(f"_n{il[0]}") == F.col("_best")) & (F.col("_best") > 0), F.lit(il[1])).otherwise(acc), reversed(list(enumerate(langs))), F.lit("und"))
    ties = reduce(lambda acc, i: acc + (F.col(f"_n{i}") == F.col("_best")).cast("int"), range(len(langs)), F.lit(0))
    solid, none = F.length("_solid").cast("double"), F.lit(None).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(none)
    symbols = F.length(F.regexp_replace("_solid", "[\\p{L}\\p{N}]+", "")).cast("double")
    ended = F.size(F.filter("_lines", lambda x: F.right(x, F.lit(16)).rlike(ENDED)))
    rows = rows.withColumns({
        "n_words": F.size("_tokens").cast("long"),
        "mean_word_length": ratio(solid, F.size("_tokens")),
        "symbol_ratio": ratio(symbols, solid),
        "punctuated_lines": ratio(ended, F.size("_lines")),
        "common_share": ratio(F.size("_common"), F.size("_words")),
        "text_lang": F.when(ties > 1, F.lit("und")).otherwise(first),
        "units": _units(F.col("_text"), known),
    })
    return rows.drop("_text", "_tokens", "_solid", "_words", "_common", "_lines", "_best", *[f"_n{i}" for i in range(len(langs))])


# ---------------------------------------------------------------------------- running sentences


def _unit_values(u: Column) -> dict[str, Column]:
    n = F.greatest(u["n"], F.lit(1)).cast("double")
    return {"n": u["n"].cast("double"), "mean": u["letters"] / n, "symbols": 1 - u["letters"] / u["signs"], "common": u["common"] / n}


def sentence_points(stats: DataFrame) -> DataFrame:
    """By language (``und``: all pooled): medians ``mid_*`` and spreads ``spread_*`` of sentences, from KLL sketches; word counts as logarithms, symbol ratios as roots."""
    units = stats.select("text_lang", F.explode("units").alias("u")).where("u.ended and u.n >= 8 and u.common >= 2")
    sk = units.select("text_lang", *[c.alias(k) for k, c in _unit_values(F.col("u")).items()]).groupBy("text_lang").agg(*[F.kll_sketch_agg_double(k, F.lit(RANKS)).alias(k) for k in UNIT_STATS])
    pooled = sk.agg(*[F.kll_merge_agg_double(k).alias(k) for k in UNIT_STATS]).withColumn("text_lang", F.lit("und"))
    both = sk.where("text_lang <> 'und'").unionByName(pooled.select("text_lang", *UNIT_STATS)).where("n is not null")
    q = lambda k, p: F.when(F.kll_sketch_get_n_double(k) > 0, F.round(F.kll_sketch_get_quantile_double(k, F.lit(p)), 4))
    mid = both.select(F.col("text_lang").alias("ref_lang"), *[q(k, p).alias(f"{k}_{int(100 * p)}") for k in UNIT_STATS for p in (0.25, 0.5, 0.75)])
    n, mean, sigma = F.col("n_50"), F.col("mean_50"), 0.6745
    return mid.where("n_50 is not null").select(
        "ref_lang", n.alias("mid_words"), F.log("n_50").alias("mid_n"), F.greatest((F.log("n_75") - F.log("n_50")) / sigma, 0.5 / F.sqrt(n)).alias("spread_n"),
        mean.alias("mid_mean"), F.greatest((F.col("mean_75") - mean) / sigma, 0.25 * mean / F.sqrt(n)).alias("spread_mean"),
        F.sqrt("symbols_50").alias("mid_symbols"), F.greatest((F.sqrt("symbols_50") - F.sqrt("symbols_25")) / sigma, 0.25 / F.sqrt(n * mean)).alias("spread_symbols"),
        F.col("common_50").alias("mid_common"), F.greatest((F.col("common_75") - F.col("common_50")) / sigma, 0.5 * F.sqrt(F.col("common_50") * (1 - F.col("common_50")) / n)).alias("spread_common"),
    )


def tail_score(u: Column) -> Column:
    """Joint robust z-score of a unit, against the columns of ``sentence_points``: the root of the summed squares of what each statistic has beyond 1."""
    v = _unit_values(u)
    z = (
        (F.col("mid_n") - F.log(F.greatest(v["n"], F.lit(0.5)))) / F.col("spread_n"),
        F.abs(v["mean"] - F.col("mid_mean")) / F.col("spread_mean"),
        (F.sqrt(F.greatest(v["symbols"], F.lit(0.0))) - F.col("mid_symbols")) / F.col("spread_symbols"),
        # the share of a longer unit is known better
        (F.col("mid_common") - v["common"]) / F.col("spread_common") * F.sqrt(v["n"] / F.col("mid_words")),
    )
    return F.sqrt(reduce(lambda a, x: a + F.pow(F.greatest(x - 1, F.lit(0.0)), F.lit(2.0)), z, F.lit(0.0)))


def judged(
    df: DataFrame, common: DataFrame, id_col: str = "id", text_col: str = "text", source_col: str = "source", least: float = 0.5, tail: float = TAIL, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, source, *keep, text_lang, statistics, not_prose)`` of every row; ``keep`` names columns that come along."""
    lists = word_lists(common)
    base = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *keep, F.col(text_col).alias("text"))
    stats = materialize(with_statistics(spread(base), lists).drop("text"), "quality")
    points = sentence_points(stats)
    own = points.select(F.col("ref_lang").alias("judged_by"), *[c for c in points.columns if c != "ref_lang"])
    have = points.select(F.col("ref_lang").alias("judged_by"), F.col("ref_lang").alias("text_lang"))
    # a row per language and one for the rest: bounded by the languages of the word list
    rows = stats.join(F.broadcast(have), "text_lang", "left").withColumn("judged_by", F.coalesce("judged_by", F.lit("und"))).join(F.broadcast(own), "judged_by", "left")
    running = F.aggregate(F.filter("units", lambda u: tail_score(u) <= tail), F.lit(0).cast("long"), lambda a, u: a + u["signs"])
    signs = F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u["signs"])
    rows = rows.withColumn("running_share", F.when(F.col("n_words") > 0, F.coalesce(F.try_divide(running, signs), F.lit(0.0))))
    return rows.select("id", "source", *keep, "text_lang", *STATS, F.coalesce((F.col("n_words") > 0) & (F.col("running_share") < least), F.lit(False)).alias("not_prose"))


# ---------------------------------------------------------------------------- documents


def sketches(stats: DataFrame) -> DataFrame:
    """One row per language with a KLL sketch of each statistic: mergeable, so partial results of days or sites add up."""
    return stats.where("n_words > 0").groupBy("text_lang").agg(*[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATS])


def reference_points(sk: DataFrame) -> DataFrame:
    """Median and robust spread (interquartile range / 1.349; null if 0) by language; ``und`` is measured on all pooled."""
    pooled = sk.agg(*[F.kll_merge_agg_double(s).alias(s) for s in STATS]).withColumn("text_lang", F.lit("und"))
    both = sk.where("text_lang <> 'und'").select("text_lang", *STATS).unionByName(pooled.select("text_lang", *STATS))
    q = lambda s, p: F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, p if isinstance(p, Column) else F.lit(p)))
    cols = []
    for s in STATS:
        cols += [
            q(s, F.array(*[F.lit(i / 100) for i in range(1, 100)])).alias(f"grid_{s}"), q(s, 0.5).alias(f"mid_{s}"),
            F.nullif((q(s, 0.75) - q(s, 0.25)) / 1.349, F.lit(0.0)).alias(f"spread_{s}"),
        ]
    return both.where(" and ".join(f"{s} is not null" for s in STATS)).select(F.col("text_lang").alias("ref_lang"), *cols)


def _at_most(column: str):
    return lambda g: g <= F.col(column)


def quality(df: DataFrame, common: DataFrame, **kw) -> DataFrame:
    """``(id, source, text_lang, statistics, pct_<stat>, z_<stat>, not_prose)`` of every row: percentiles and robust z-scores within its language."""
    stats = materialize(judged(df, common, **kw), "quality")
    ref = reference_points(sketches(stats))
    joined = stats.join(F.broadcast(ref), stats.text_lang == ref.ref_lang, "left")
    z = {s: F.try_divide(F.col(s) - F.col(f"mid_{s}"), F.col(f"spread_{s}")) for s in STATS}
    pct = {s: F.when(F.col(s).isNotNull() & F.col(f"grid_{s}").isNotNull(), F.size(F.filter(f"grid_{s}", _at_most(s))) / 100) for s in STATS}
    return joined.select(
        "id", "source", "text_lang", *STATS,
        *[F.round(pct[s], 4).alias(f"pct_{s}") for s in STATS], *[F.round(z[s], 4).alias(f"z_{s}") for s in STATS], "not_prose")


def not_prose_rows(df: DataFrame, common: DataFrame, **kw) -> DataFrame:
    return judged(df, common, **kw).where("not_prose").select("id")


def quality_by_source(df: DataFrame, common: DataFrame, **kw) -> DataFrame:
    """Means of the statistics, rows and share of rows that are not prose, by source (null included)."""
    return judged(df, common, **kw).groupBy("source").agg(
        F.count("*").alias("rows"), *[F.round(F.avg(s), 6).alias(f"avg_{s}") for s in STATS],
        F.round(F.avg(F.col("not_prose").cast("double")), 6).alias("not_prose_share"),
    )
