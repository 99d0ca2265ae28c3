"""Splitting oversized items at natural boundaries, by recursive bisection.

An item above its limits is cut at the strongest boundary near its midpoint; a
half that still exceeds the limit, the overlap it will carry included, is cut
again; last, every piece but the first gets the end of its predecessor as
overlap. Works on character offsets, so the pieces without their overlaps put
together are the item again.

Spark plan: narrow. The strategies' limits are joined by Spark's own choice of
join (a table of a few rows), the pieces of an item come from one Arrow step
row by row, nothing is shuffled.

Defined results
---------------
* Strategy: equal after trimming and lower-casing. Unknown or null strategy,
  null or empty text, or a text within its limits: one piece, the text as it is
  (null stays null).
* Limits are words (runs of anything but white space) and characters; a null
  limit does not bind.
* A run of characters longer than the limit, without a boundary, is cut hard.
* Overlap: the last ``overlap_words`` words before the piece, fewer if the limits
  leave no room for them beside one word of the piece.
* Copies are split alike; other columns are ignored; empty input, empty output.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragstone.session import spread

WS = "(?U)[\\s\\x{1C}-\\x{1F}]+"
_WORD = re.compile(r"\S+")
# Headings that open an article or section, at the start of a line.
_HEADING = re.compile(r"\s*(?:[#*_>]+\s*)?(?:art[íi]culo|art\.|article|section|secci[óo]n|cap[íi]tulo|chapter|t[íi]tulo|title|#{1,6})\b", re.IGNORECASE)


class _Item:
    """Word spans of a text and the strength of the boundary before each word."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.start = np.array([s for s, _ in spans], np.int64)
        self.end = np.array([e for _, e in spans], np.int64)
        n = len(spans)
        self.strength = np.zeros(n, np.int8)
        for i in range(1, n):
            gap, before = text[spans[i - 1][1] : spans[i][0]], text[spans[i - 1][1] - 1]
            breaks = gap.count("\n") + gap.count(" ") * 2
            if breaks and _HEADING.match(text, spans[i][0], min(len(text), spans[i][0] + 40)):
                s = 6
            elif breaks >= 2:
                s = 5
            elif before in ".!?…" or before in "\"”»)’" and text[max(0, spans[i - 1][1] - 2)] in ".!?…":
                s = 4
            elif breaks:
                s = 3
            elif before in ";:,—–":
                s = 2
            else:
                s = 1
            self.strength[i] = s

    def words_in(self, a: int, b: int) -> int:
        """Words that text[a:b] shows (a cut word counts)."""
        return int(np.searchsorted(self.start, b, "left") - np.searchsorted(self.end, a, "right")) if b > a else 0

    def overlap_start(self, at: int, words: int) -> int:
        """Offset of the ``words``-th word start before offset ``at``."""
        if words <= 0 or at == 0:
            return at
        i = int(np.searchsorted(self.start, at, "left")) - words
        return int(self.start[max(0, i)]) if np.searchsorted(self.start, at, "left") > 0 else at


def cut_near_middle(item: _Item, a: int, b: int) -> int:
    """The cut of text[a:b]: the strongest boundary in the middle half (ties: nearest to the middle), else anywhere, else hard in the middle."""
    middle = (a + b) / 2
    for lo, hi in ((a + (b - a) * 0.25, a + (b - a) * 0.75), (a + 1, b - 1)):
        i, j = np.searchsorted(item.start, [lo, hi])
        i = max(i, int(np.searchsorted(item.start, a, "right")))
        if i < j:
            s = item.strength[i:j]
            best = np.flatnonzero(s == s.max()) + i
            return int(item.start[best[np.abs(item.start[best] - middle).argmin()]])
    at = int(middle)
    while at > a + 1 and "\udc00" <= item.text[at] <= "\udfff":
        at -= 1
    return at


def split_text(text: str, max_words: int | None, overlap_words: int, max_chars: int | None) -> list[tuple[int, int, int]]:
    """Pieces ``(overlap_start, start, end)`` of a text: text[overlap_start:end] is the piece, text[start:end] its own part."""
    max_words = max_words if max_words and max_words > 0 else 1 << 60
    max_chars = max_chars if max_chars and max_chars > 0 else 1 << 60
    item = _Item(text)
    if item.words_in(0, len(text)) <= max_words and len(text) <= max_chars:
        return [(0, 0, len(text))]
    overlap_words = max(0, min(overlap_words or 0, max_words - 1))
    done: list[tuple[int, int, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        # blanks at the end of a part count neither as words nor against the limit of characters
        stop = a + len(text[a:b].rstrip()) if b < len(text) else b
        o = item.overlap_start(a, overlap_words)
        fits = lambda o: item.words_in(o, stop) <= max_words and stop - o <= max_chars
        if fits(o):
            done.append((o, a, b))
            continue
        if item.words_in(a, b) <= 1 and item.words_in(a, stop) <= max_words and stop - a <= max_chars:
            while o < a and not fits(o):  # a single word leaves no room for all of the overlap
                nxt = int(np.searchsorted(item.start, o, "right"))
                o = min(a, int(item.start[nxt])) if nxt < len(item.start) else a
            done.append((o, a, b))
            continue
        if b - a <= 1:
            done.append((a, a, b))
            continue
        cut = cut_near_middle(item, a, b)
        todo.append((cut, b))
        todo.append((a, cut))
    return done


def split_items(
    df: DataFrame, limits: DataFrame, id_col: str = "id", text_col: str = "text", strategy_col: str = "strategy",
) -> DataFrame:
    """``(id, strategy, piece_no, n_pieces, piece, overlap_chars, start, end, oversized)``, ``start``/``end`` being offsets without the overlap."""
    key = lambda c: F.lower(F.regexp_replace(c, f"^{WS}|{WS}$", ""))
    rules = limits.select(key(F.col("strategy")).alias("strategy"), "max_words", "overlap_words", "max_chars").where("strategy is not null")
    rules = rules.groupBy("strategy").agg(F.min("max_words").alias("max_words"), F.min("overlap_words").alias("overlap_words"), F.min("max_chars").alias("max_chars"))
    rows = df.select(F.col(id_col).alias("id"), key(F.col(strategy_col)).alias("strategy"), F.col(text_col).alias("text"))
    joined = spread(rows).join(rules, "strategy", "left").select("id", "strategy", "text", "max_words", "overlap_words", "max_chars")

    def run(batches):
        for t in batches:
            out: dict[str, list] = {k: [] for k in ("row", "no", "n", "piece", "lap", "start", "end", "big")}
            cols = [t.column(c).to_pylist() for c in ("text", "max_words", "overlap_words", "max_chars")]
            for r, (text, words, lap, chars) in enumerate(zip(*cols)):
                parts = [(0, 0, len(text or ""))]
                if text and (chars and len(text) > chars or words and len(text.split()) > words):
                    parts = split_text(text, words, lap, chars)
                for no, (o, a, b) in enumerate(parts):
                    whole = len(parts) == 1
                    out["row"].append(r)
                    out["no"].append(no)
                    out["n"].append(len(parts))
                    out["piece"].append(text if whole else text[o:b].rstrip() if b < len(text) else text[o:b])
                    out["lap"].append(a - o)
                    out["start"].append(a)
                    out["end"].append(b)
                    out["big"].append(not whole)
            at = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t.column("id").take(at), t.column("strategy").take(at), pa.array(out["no"], pa.int32()), pa.array(out["n"], pa.int32()),
                 pa.array(out["piece"], pa.string()), pa.array(out["lap"], pa.int32()), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32()), pa.array(out["big"], pa.bool_())],
                names=["id", "strategy", "piece_no", "n_pieces", "piece", "overlap_chars", "start", "end", "oversized"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, strategy string, piece_no int, n_pieces int, piece string, overlap_chars int, start int, end int, oversized boolean")


def oversized_rows(df: DataFrame, limits: DataFrame, **kw) -> DataFrame:
    """``(id)`` of the rows that had to be split."""
    return split_items(df, limits, **kw).where("oversized and piece_no = 0").select("id")


def split_report(df: DataFrame, limits: DataFrame, **kw) -> DataFrame:
    """Per strategy: rows, rows split, pieces, and the longest piece in words and characters."""
    words = F.size(F.filter(F.split("piece", WS), lambda w: w != ""))
    return split_items(df, limits, **kw).groupBy("strategy").agg(
        F.countDistinct("id").alias("rows"), F.sum(F.expr("case when oversized and piece_no = 0 then 1 else 0 end")).alias("rows_split"),
        F.count("*").alias("pieces"), F.max(words).alias("longest_words"), F.max(F.length("piece")).alias("longest_chars"),
    )
