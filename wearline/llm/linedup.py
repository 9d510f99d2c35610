"""Line deduplication by overlapping three-line windows (DataFrame functions only).

Lines are split at ``\\n``, compared after trimming; blank lines take no part.
Every run of three consecutive lines is a window, known by a 128-bit hash.  A
window that occurs twice or more keeps its first occurrence, in the order
(id, text, position), and every later occurrence covers its three lines.  The
covered positions of a document are merged and its covered lines removed;
lines that no later occurrence covers stay, blank ones included.

Defined cases: a null or empty text, or one of fewer than three lines, is
unchanged; a null id comes last in the order; rows repeated with the same id
and text are one document, each repeated row gets its result; an empty table
gives an empty table; other columns are passed through, whatever their names,
but columns called ``n_lines`` or ``n_removed_lines`` give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import by_place, row_key, store

WINDOW = 3


def line_windows(lines: Column) -> Column:
    """Array of (pos, w1, w2): hashed windows over the non-blank lines, by first line number."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    kept = F.filter(numbered, lambda x: x["line"] != "")
    hashed = F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))
    return hashed


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per window: document key, its id, the position of its first line and its hash."""
    rows = docs.select(
        F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)),
        line_windows(F.split(F.col(text_col), "\n")).alias("_h"),
    )
    at = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    part = lambda i, j, f: F.element_at("_h", (i + (j + 1)).cast("int"))[f]
    built = F.transform(at, lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(part(i, 0, "a"), part(i, 1, "a"), part(i, 2, "a")).alias("w1"),
        F.xxhash64(part(i, 0, "b"), part(i, 1, "b"), part(i, 2, "b")).alias("w2"),
    ))
    return rows.where(F.size("_h") >= WINDOW).select("_id", "_k1", "_k2", F.explode(built).alias("_w")).select(
        "_id", "_k1", "_k2", F.col("_w.pos").alias("_pos"), F.col("_w.w1").alias("_w1"), F.col("_w.w2").alias("_w2"),
    )


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with later occurrences: its key and the starts of the windows to cover.

    The first occurrence per window is an aggregate with map-side combine.
    Only windows with two different places come back; both sides of that join
    are plain exchanges, so adaptive execution splits a window that a third of
    all documents hold.
    """
    windows = store(_windows(docs, id_col, text_col), "line-windows")
    place = F.struct(F.col("_id").isNull().alias("z"), "_id", "_k1", "_k2", "_pos")
    repeated = (
        windows.groupBy("_w1", "_w2")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(F.col("_first") != F.col("_last"))
        .select("_w1", "_w2", "_first")
    )
    repeated = store(repeated, "line-repeated")
    later = windows.join(repeated, ["_w1", "_w2"]).where(~place.eqNullSafe(F.col("_first")))
    return later.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_starts"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rid of later occurrences, plus ``n_lines`` and ``n_removed_lines``.

    A document's starts and lines are bounded by its own size.
    """
    placed, (own_id, own_text) = by_place(docs, id_col, text_col)
    names = dict(zip(placed.columns, docs.columns, strict=True))
    covered = covered_windows(placed, own_id, own_text)
    # lines and places are made below the join, so that no expression is evaluated again per line
    lines = F.split(F.col(own_text), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    places = F.transform(F.filter(numbered, lambda x: x["line"] != ""), lambda x: x["pos"])
    others = [F.col(c) for c in names if c != own_text] or [F.lit(0).alias("_none")]
    keyed = placed.select(F.struct(*others).alias("_row"), lines.alias("_lines"), places.alias("_places"), *row_key(F.col(own_id), F.col(own_text)))
    joined = keyed.join(covered, ["_k1", "_k2"], "left")
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.slice("_places", s + 1, WINDOW))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.element_at("_lines", i + 1)), "\n")
    new = F.when(F.col("_starts").isNull(), F.array_join("_lines", "\n")).otherwise(kept)
    left_out = ("n_lines", "n_removed_lines")
    passed = {c: n for c, n in names.items() if n not in left_out}
    return joined.select(
        *[new.alias(c) if c == own_text else F.col("_row")[c].alias(c) for c in passed],
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed_lines"),
    ).toDF(*passed.values(), *left_out)
