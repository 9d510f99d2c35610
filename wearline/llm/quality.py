"""Quality rules: per-text statistics and cross-document line frequency.

Base statistics of every whole text come from numpy over Arrow buffers.  The
verdict then follows the lines: lines are normalised (white space collapsed,
trimmed, lower case), hashed to 128 bits and counted in distinct documents
per host.  A line is boilerplate where it is in at least ``min_documents`` of
a host's documents, and in ``min_share`` of them or, on a large host, in
``most_documents``.  It must also be in ``min_texts`` different texts, so that
a page copied often is not its own boilerplate (copies are the deduplication
stages' business).  Boilerplate lines are removed; a document that loses more
than ``most_lost`` of its words is depleted and rejected.

Defined cases: rows repeated with the same id and text are one document, also
with a null id; equal texts of a host share one verdict; a null text has no
words (base failed); a null host is a host of its own; empty lines never
count; an empty table gives no row; other columns are passed through by
``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm import text as tx
from wearline.llm.common import by_place, row_key, store

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS_SCHEMA = pa.schema([
    *((c, pa.int64()) for c in ("_k1", "_k2", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_()),
])
STATS_DDL = "_k1 long, _k2 long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _repeat_words(words: tx.Words, h: np.ndarray) -> np.ndarray:
    """Per document: words inside windows of 8 words that are in the text twice or more."""
    n = len(h) - REPEAT_WINDOW + 1
    docs = len(words.count)
    if n <= 0:
        return np.zeros(docs, np.int64)
    inside = words.doc[:n] == words.doc[REPEAT_WINDOW - 1 :]
    window = tx.grams(h, REPEAT_WINDOW) ^ tx.mix(words.doc[:n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(inside)
    order = np.argsort(window[at], kind="stable")
    ordered = window[at][order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    repeated = at[order[same[1:] | same[:-1]]]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + REPEAT_WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=docs)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    out = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(out)):
        lines = raw[offsets[i] : offsets[i + 1]].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            worded = [x for x in lines if x.split()]
            out[i] = len(worded) - len(set(worded))
    return out


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = tx.Words(data, offsets, tx.NOT_SPACE)
    h = words.hashes(lower=False)
    repeat = _repeat_words(words, h)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _per_doc(((data & 0xC0) != 0x80) & tx.NOT_SPACE[data], offsets),
        "n_symbols": _per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets),
        "n_repeat_words": repeat.astype(np.int64),
    }


def _stats(batches):
    for batch in batches:
        data, offsets = tx.texts(batch.column("_text"))
        for i, j in tx.pieces(offsets):
            own = offsets[i : j + 1] - offsets[i]
            s = base_statistics(data[offsets[i] : offsets[j]], own)
            s["base_failed"] = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
            keys = [batch.column(c).slice(i, j - i) for c in ("_k1", "_k2", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(s[f.name]) for f in list(STATS_SCHEMA)[3:])], schema=STATS_SCHEMA)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _keys(text_col: str, host_col: str) -> list[Column]:
    return row_key(F.col(host_col), F.col(text_col))


def _texts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Written table of the different texts of each host: lines that are not empty, all their words, and documents.

    A line is its position, its hash and its words.  Copies of a text fold
    before the shuffle, however many they are.
    """
    parts = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("pos"), normalised(x).alias("line")))
    packed = F.transform(F.filter(parts, lambda x: x["line"] != ""), lambda x: F.struct(
        x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b"),
        F.size(F.split(x["line"], " ")).alias("words"),
    ))
    h1, h2 = row_key(F.col(host_col))
    rows = docs.select(*_keys(text_col, host_col), h1.alias("_h1"), h2.alias("_h2"), packed.alias("_lines"))
    texts = rows.groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in ("_h1", "_h2", "_lines")])
    own = docs.select(*_keys(text_col, host_col), F.col(id_col).alias("_id")).distinct()
    copies = own.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_copies"))
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return store(texts.join(copies, ["_k1", "_k2"]).withColumn("_total", total), "quality-texts")


def boilerplate(texts: DataFrame, min_documents: int, min_share: float, most_documents: int, min_texts: int) -> DataFrame:
    """Written table of the boilerplate lines: hashes with their host and their distinct documents.

    Lines are counted with map-side combine, so neither a hot host nor a hot
    line gathers in one task.
    """
    distinct = F.array_distinct(F.transform("_lines", lambda x: F.struct(x["a"].alias("_a"), x["b"].alias("_b"))))
    once = texts.select("_h1", "_h2", "_copies", F.explode(distinct).alias("_l")).select("_h1", "_h2", "_copies", "_l.*")
    counted = once.groupBy("_h1", "_h2", "_a", "_b").agg(F.sum("_copies").alias("_docs"), F.count(F.lit(1)).alias("_different"))
    counted = counted.where((F.col("_docs") >= min_documents) & (F.col("_different") >= min_texts))
    hosts = texts.groupBy("_h1", "_h2").agg(F.sum("_copies").alias("_all"))
    needed = F.least(F.lit(min_share) * F.col("_all"), F.lit(float(most_documents)))
    frequent = counted.join(hosts, ["_h1", "_h2"]).where(F.col("_docs") >= needed)
    return store(frequent.select("_h1", "_h2", "_a", "_b", "_docs"), "quality-frequent")


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_documents: int = 10,
                  min_share: float = 0.1, most_documents: int = 1000, min_texts: int = 10, most_lost: float = 0.5) -> DataFrame:
    """Per text of a host with boilerplate: its key, lost words, positions of its boilerplate lines, ``_depleted``."""
    texts = _texts(docs, id_col, text_col, host_col)
    frequent = boilerplate(texts, min_documents, min_share, most_documents, min_texts)
    lines = texts.select("_k1", "_k2", "_h1", "_h2", "_total", F.explode("_lines").alias("_l")).select(
        "_k1", "_k2", "_h1", "_h2", "_total",
        F.col("_l.pos").alias("_pos"), F.col("_l.a").alias("_a"), F.col("_l.b").alias("_b"), F.col("_l.words").alias("_words"),
    )
    hit = lines.join(frequent, ["_h1", "_h2", "_a", "_b"]).groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct("_pos", "_words")).alias("_lines"), F.first("_total").alias("_total"),
    )
    lost = F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["_words"])
    return hit.select(
        "_k1", "_k2", F.col("_lines._pos").alias("_gone"), lost.alias("_lost"), (lost > F.lit(most_lost) * F.col("_total")).alias("_depleted"),
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Base statistics and verdict of every row: doc_id, statistics, base_failed, n_lost_words, kept."""
    keyed = docs.select(*_keys(text_col, host_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    stats = keyed.mapInArrow(_stats, STATS_DDL)
    verdicts = line_verdicts(docs, id_col, text_col, host_col, **limits).select("_k1", "_k2", "_lost", "_depleted")
    depleted = F.coalesce(F.col("_depleted"), F.lit(False))
    return stats.join(verdicts, ["_k1", "_k2"], "left").withColumns({
        "n_lost_words": F.coalesce(F.col("_lost"), F.lit(0)).cast("long"),
        "kept": ~F.col("base_failed") & ~depleted,
    }).drop("_lost", "_depleted")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs`` without their boilerplate lines; other columns are passed through, whatever their names."""
    placed, (own_id, own_text, own_host) = by_place(docs, id_col, text_col, host_col)
    keyed = placed.select(F.struct(*placed.columns).alias("_row"), *_keys(own_text, own_host))
    with_base = keyed.select("*", F.col("_row")[own_id].cast("long").alias("doc_id"), F.col("_row")[own_text].alias("_text"))
    failed = with_base.select("_k1", "_k2", "doc_id", "_text").mapInArrow(_stats, STATS_DDL).where("base_failed").select("_k1", "_k2").distinct()
    verdicts = line_verdicts(placed, own_id, own_text, own_host, **limits)
    out = verdicts.select("_k1", "_k2", F.when(~F.col("_depleted"), F.col("_gone")).alias("_gone"), "_depleted")
    decided = failed.withColumn("_failed", F.lit(True)).join(out, ["_k1", "_k2"], "full")
    joined = keyed.join(decided, ["_k1", "_k2"], "left").where(
        ~F.coalesce(F.col("_failed"), F.lit(False)) & ~F.coalesce(F.col("_depleted"), F.lit(False))
    )
    text = F.col("_row")[own_text]
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    return joined.select(*[new.alias(c) if c == own_text else F.col("_row")[c].alias(c) for c in placed.columns]).toDF(*docs.columns)
