"""Texts cut off by field limits or in transfer.

Per source, and for lengths in characters and in bytes, a lognormal length
distribution is fitted by maximum likelihood with the values at a candidate
limit treated as right-censored. A value at (or within a few bytes under) a
candidate limit gets the posterior that it is censored: the share of the count
there which the fitted density does not explain.

This posterior is combined, as log odds, with the likelihood of the ending, which
is learned from the data. An ending falls into a cell: how the last line or
sentence opens, how many words it has, whether running text stands before it in
its line, whether the same ending closes many different texts. How cut texts
fall into the cells is learned from the rows at limits, weighted by their
posterior, and from cuts at random places of all texts. How complete texts fall
into them is what the rows away from limits have beyond the cut ones among
them; the share of these is the largest that leaves no cell negative. This is
done for each kind of last sign (letter, digit, ellipsis, ...).

Spark plan: one narrow pass over the texts (column expressions) writes lengths
and cells, no texts. From that table: length histograms per source, counts of
cells, both aggregated before the shuffle; the fits see a row per distinct
length, the ending model a row per cell (bounded: cells times 20 steps of the
posterior). Limits come back in one join on the source.

Defined results
---------------
* Null and blank texts are not cut. Null source: a source of its own for the fits.
* A text is judged by its last line that is not blank; blanks at its end are ignored.
* A text ending with a full sentence is not cut, even at a limit.
* Exact copies count once for the ending model and are judged alike; extra columns
  are ignored; empty input gives empty output.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.session import materialize

# Signs that count as blank, and those that end a line.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FULL = "[.!?。！？]['\"”’»)\\]]*$"
OMITTED = "\\s*(…|\\.{3}|[\\[(](…|\\.{3})[\\])])$"
DAMAGED = "(\\x{FFFD}|&#?\\w{0,8})$"
LAST = ("B", "D", "L", "M", "P", "X")  # closing bracket or quote, digit, letter, omission mark, other sign, damaged sign
OPENS = ("N", "C", "T", "W", "b", "q", "U", "d", "l")  # number mark, label, table row, other sign, bracket, quote, capital, digit, small letter
PROSE = ("U", "d", "l")
SIZES, PLACES, RARITY = ("0", "1", "2", "3", "4"), ("i", "o"), ("f", "r")
CELLS = tuple("".join(c) for c in itertools.product(OPENS, SIZES, PLACES, RARITY))
FORMULA = 0.2  # an ending that closes this share of the texts of its kind and size (at least 3 texts) is a formula
STEPS = 20


def last_line(bare: Column) -> Column:
    """The last line of a text without blanks at its end."""
    for sign in BREAKS:
        bare = F.substring_index(bare, sign, -1)
    return F.trim(bare, F.lit(BLANKS))


def _cells(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``last``, ``cell`` (without the rarity) and ``unit`` (a hash) of the text in column ``at``."""
    # steps of their own, so that each is computed once
    rows = rows.withColumn("_line", last_line(F.col(at))).withColumn("_tail", F.right("_line", F.lit(64)))
    tail, line = F.col("_tail"), F.col("_line")
    rows = rows.withColumn("last", (
        F.when(tail == "", "S").when(tail.rlike("[.!?]$") & ~tail.rlike("[.][.]$"), "S").when(tail.rlike("\\p{L}$"), F.when(tail.rlike(DAMAGED), "X").otherwise("L"))
        .when(tail.rlike(OMITTED), "M").when(tail.rlike(FULL), "S").when(tail.rlike(DAMAGED), "X")
        .when(tail.rlike("\\p{N}$"), "D").when(tail.rlike("[)\\]}»”’\"']$"), "B").otherwise("P")
    ))
    body = F.when(F.col("last") == "M", F.regexp_replace("_line", OMITTED, "")).when(F.col("last") == "X", F.regexp_replace("_line", DAMAGED, "")).otherwise(line)
    rows = rows.withColumn("_body", F.when(F.col("last") != "S", F.trim(body, F.lit(BLANKS))))
    rows = rows.withColumn("_unit", F.element_at(F.split("_body", "(?<=[.!?…])['\"”’»)\\]]*\\s+"), -1))
    u = F.col("_unit")
    opens = (
        F.when(u.rlike("[|\\t]"), "T").when(u.rlike("(?U)^\\(?\\w{1,3}[.)](\\s|$)"), "N").when(u.rlike("^\\p{L}\\S*( \\p{L}\\S*){0,2}:"), "C")
        .when(u.rlike("^[(\\[{]"), "b").when(u.rlike("^[¿¡\"'“«]"), "q").when(u.rlike("^\\p{Lu}"), "U").when(u.rlike("^\\p{N}"), "d")
        .when((u == "") | u.rlike("^\\p{L}"), "l").otherwise("W")
    )
    n = F.size(F.split(u, "(?U)\\s+"))
    sizes = F.when(n <= 1, "0").when(n <= 2, "1").when(n <= 4, "2").when(n <= 8, "3").otherwise("4")
    inner = F.when(F.length(u) < F.length("_body"), "i").otherwise("o")
    unit = F.xxhash64("last", sizes, F.regexp_replace(F.lower(u), "[0-9]+", "0"))
    rows = rows.withColumns({"cell": F.when(F.col("last") != "S", F.concat(opens, sizes, inner)), "unit": F.when(F.col("last") != "S", unit)})
    return rows.drop("_line", "_tail", "_body", "_unit")


# ---------------------------------------------------------------------------- censored fits


def _normal_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in np.atleast_1d(z)])


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: float) -> tuple[float, float]:
    """Maximum likelihood (mu, sigma) of log length; values at or over ``limit`` are censored there (EM)."""
    x, w = np.log(np.maximum(lengths, 1.0)), counts.astype(float)
    free = lengths < limit
    if w[free].sum() < 2:
        return float(np.average(x, weights=w)), 1.0
    c = math.log(limit)
    mu, sd = float(np.average(x, weights=w)), float(max(0.05, math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))))
    n_free, n_cens = w[free].sum(), w[~free].sum()
    for _ in range(60):
        z = (c - mu) / sd
        tail = max(1e-12, float(_normal_sf(z)[0]))
        hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * hazard
        e2 = mu * mu + sd * sd + sd * (c + mu) * hazard
        m1 = (np.dot(w[free], x[free]) + n_cens * e1) / (n_free + n_cens)
        m2 = (np.dot(w[free], x[free] ** 2) + n_cens * e2) / (n_free + n_cens)
        new_sd = math.sqrt(max(0.0025, m2 - m1 * m1))
        if abs(m1 - mu) + abs(new_sd - sd) < 1e-7:
            break
        mu, sd = m1, new_sd
    return float(mu), float(sd)


def candidate_limits(lengths: np.ndarray, counts: np.ndarray, slack: int) -> list[tuple[int, float]]:
    """``(limit, posterior)``: lengths at which the windows [limit - slack, limit] hold more values than the fit explains.

    The posterior is 1 - expected / observed, the expected count from the
    lognormal fitted with the values from the limit on as censored.
    """
    o = np.argsort(lengths)
    lengths, counts = lengths[o], counts[o]
    total = counts.sum()
    cum = np.r_[0, np.cumsum(counts)]
    lo = np.searchsorted(lengths, lengths - slack, "left")
    here = cum[1:] - cum[lo]
    before_lo = np.searchsorted(lengths, lengths - slack * 1.0 - np.maximum(8, lengths * 0.05), "left")
    nearby = (cum[lo] - cum[before_lo]) / np.maximum(8, lengths * 0.05) * (slack + 1)
    # beyond a limit there is nothing but blanks put after the cut: at most a twentieth of the values at it
    beyond = total - cum[np.searchsorted(lengths, lengths + 4, "right")]
    found = []
    for i in np.flatnonzero((here >= 2) & (here > 3 * nearby + 1) & (beyond <= 0.05 * here)):
        limit = int(lengths[i])
        mu, sd = fit_censored(lengths.astype(float), counts, float(max(1, limit - slack)))
        a, b = (math.log(max(1, limit - slack) - 0.5) - mu) / sd, (math.log(limit + 0.5) - mu) / sd
        expected = total * max(0.0, float(_normal_sf(a)[0] - _normal_sf(b)[0]))
        posterior = 1 - min(1.0, (expected + 0.5) / here[i])
        if posterior > 0.5:
            found.append((limit, round(float(posterior), 4)))
    # one limit per window: the upper end with the most values
    best: list[tuple[int, float]] = []
    for limit, p in found:
        if best and limit - best[-1][0] <= slack:
            best[-1] = max(best[-1], (limit, p), key=lambda t: (here[np.searchsorted(lengths, t[0])], t[0]))
        else:
            best.append((limit, p))
    return best


def field_limits(sizes: DataFrame, slack: int = 4) -> DataFrame:
    """``(src, unit, limit_at, slack, posterior)`` per source of ``sizes (src, chars, bytes)``, from its histograms of exact lengths."""
    sized = sizes.select("src", F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")),
    )).alias("s")).select("src", "s.unit", "s.n").where("n > 0")
    hist = sized.groupBy("src", "unit", "n").agg(F.count("*").alias("c"))

    def fit(t: pa.Table) -> pa.Table:
        src, unit = t.column("src")[0].as_py(), t.column("unit")[0].as_py()
        width = slack if unit == "bytes" else 0
        got = candidate_limits(t.column("n").to_numpy(), t.column("c").to_numpy(), width)
        n = len(got)
        return pa.table({
            "src": pa.array([src] * n, pa.string()), "unit": pa.array([unit] * n, pa.string()), "limit_at": pa.array([g[0] for g in got], pa.int64()),
            "slack": pa.array([width] * n, pa.int32()), "posterior": pa.array([g[1] for g in got], pa.float64()),
        })

    return hist.groupBy("src", "unit").applyInArrow(fit, "src string, unit string, limit_at bigint, slack int, posterior double")


# ---------------------------------------------------------------------------- endings


def ending_model(counts: list[tuple[str, str, int, float, int]]) -> dict[tuple[str, str], tuple[float, float]]:
    """``(last, cell) -> (share cut, log likelihood ratio)`` from ``(last, cell, kind, posterior, texts)``.

    Kind 0 are texts (posterior 0: away from limits), kind 1 are random cuts, whose
    last sign says nothing of the sign that a cut leaves. Random cuts weigh as much
    as 50 texts at limits.
    """
    at = {c: i for i, c in enumerate(CELLS)}
    made, held = np.full(len(CELLS), 0.02), np.zeros(len(CELLS))
    away = {e: np.zeros(len(CELLS)) for e in LAST}
    for last, cell, kind, posterior, n in counts:
        if kind == 1:
            made[at[cell]] += n
        elif posterior > 0:
            held[at[cell]] += posterior * n
        else:
            away[last][at[cell]] += n
    cut = (held + 50 * made / made.sum()) / (held.sum() + 50)
    # coarse cells: place, rarity, prose or not
    coarse = np.array([PLACES.index(c[2]) * 4 + RARITY.index(c[3]) * 2 + (c[0] in PROSE) for c in CELLS])
    total = lambda v: np.bincount(coarse, v, 8)
    cut_c = total(cut)
    usual = cut_c >= min(0.2, cut_c.max())
    model = {}
    for last, u in away.items():
        n, uc = max(1.0, u.sum()), total(u)
        share = min(1.0, float(((uc[usual] + 0.5) / n / cut_c[usual]).min()))
        # complete texts: what a coarse cell has beyond its cut ones, on the cells where it is; a little mass like the cut ones, which says nothing
        fine = np.maximum(u - share * cut * n, 0)
        met = share * cut_c * n
        beyond = np.maximum(uc - met - np.sqrt(met) - 0.5, 0)  # more than chance
        whole = (beyond / np.maximum(total(fine), 1e-9))[coarse] * fine + 0.05 * cut / cut_c[coarse]
        whole /= whole.sum()
        for c, i in at.items():
            model[last, c] = (min(0.999, max(1e-4, share)), float(math.log(cut[i] / whole[i])))
    return model


def _judged(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The written table of lengths and cells: ``kind`` 0 are the rows, 1 a random cut of each text that is not blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("bare", F.rtrim(text, F.lit(BLANKS)))
    at = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("bare"), F.lit(1))) + 1).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("kind"), F.col("bare").alias("at")), F.struct(F.lit(1).alias("kind"), F.rtrim(F.substring("bare", F.lit(1), at), F.lit(BLANKS)).alias("at")))
    rows = rows.select(
        "doc_id", "source", (F.col("bare") == "").alias("blank"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"),
        F.length(F.rtrim("text", F.lit(" \t "))).cast("long").alias("bare_chars"), F.xxhash64("text").alias("copy"), F.explode(ends).alias("e"),
    ).select("*", "e.kind", "e.at").drop("e")
    return _cells(rows, "at").drop("at")


def truncation(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, posterior, evidence, score, truncated)`` of every row.

    ``posterior``: that the length was cut at a limit of the source (0 away from
    limits). ``evidence``: log likelihood ratio of the ending. ``score``: log odds
    of the posterior (at least the share of cut texts among endings of this kind)
    plus the evidence; null for blank texts and full sentences.
    """
    spark = df.sparkSession
    seen = materialize(_judged(df, id_col, text_col, source_col).withColumn("src", F.coalesce("source", F.lit(""))), "cut")
    limits = field_limits(seen.where("kind = 0 and not blank").select("src", "chars", "bytes"))
    by_source = limits.groupBy("src").agg(F.collect_list(F.struct("unit", "limit_at", "slack", "posterior")).alias("limits"))  # a few per source
    within = lambda n, x: (n <= x["limit_at"]) & (n >= x["limit_at"] - x["slack"])

    def hit(x: Column) -> Column:
        chars = (x["unit"] == "chars") & (within(F.col("chars"), x) | within(F.col("bare_chars"), x))
        return F.when(chars | ((x["unit"] == "bytes") & within(F.col("bytes"), x)), x["posterior"]).otherwise(0.0)

    posterior = F.coalesce(F.array_max(F.transform("limits", hit)), F.lit(0.0))
    placed = materialize(seen.join(by_source, "src", "left").withColumn("posterior", F.when(F.col("kind") == 0, posterior).otherwise(0.0)).drop("limits", "chars", "bytes", "bare_chars", "src"), "cut")

    # formulas: at most 1 / FORMULA endings of each of 6 x 5 kinds and sizes, so the table is bounded
    size = F.substring("cell", 2, 1)
    closing = placed.where("kind = 0 and not blank and last <> 'S'").select("last", size.alias("size"), "unit", "copy").distinct()
    of_kind = closing.groupBy("last", "size", "unit").agg(F.count("*").alias("n"))
    totals = of_kind.groupBy("last", "size").agg(F.sum("n").alias("all"))
    formulas = of_kind.join(F.broadcast(totals), ["last", "size"]).where((F.col("n") >= 3) & (F.col("n") >= FORMULA * F.col("all"))).select("unit").withColumn("formula", F.lit("f"))
    cells = placed.join(F.broadcast(formulas), "unit", "left").withColumn("cell", F.concat("cell", F.coalesce("formula", F.lit("r"))))
    step = F.round(F.col("posterior") * STEPS) / STEPS
    counts = (
        cells.where("not blank and last <> 'S'").select("last", "cell", "kind", step.alias("posterior"), "copy").distinct()
        .groupBy("last", "cell", "kind", "posterior").agg(F.count("*").alias("n")).collect()
    )
    model = ending_model([tuple(r) for r in counts])
    table = spark.createDataFrame([(*k, *v) for k, v in model.items()], "last string, cell string, share double, evidence double")
    p = F.least(F.greatest("posterior", "share"), F.lit(0.9995))
    scored = cells.where("kind = 0").join(F.broadcast(table), ["last", "cell"], "left")  # 6 x 180 rows
    score = F.when(~F.col("blank") & (F.col("last") != "S"), F.round(F.log(p / (1 - p)) + F.col("evidence"), 4))
    return scored.select("doc_id", "source", "posterior", F.round("evidence", 4).alias("evidence"), score.alias("score")).withColumn("truncated", F.coalesce(F.col("score") > 0, F.lit(False)))


def truncated_rows(df: DataFrame, **kw) -> DataFrame:
    return truncation(df, **kw).where("truncated").select("doc_id")


def truncation_by_source(df: DataFrame, **kw) -> DataFrame:
    """``(source, rows, truncated_rows, share)`` per source, null included."""
    return truncation(df, **kw).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum(F.col("truncated").cast("long")).alias("truncated_rows"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"),
    )
