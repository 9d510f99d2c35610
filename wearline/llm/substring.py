"""Exact removal of repeated byte strings (suffix-array deduplication).

Every byte inside a ``length``-byte string that also starts anywhere else is
removed, over the whole corpus.  One transform of a whole corpus fits no task,
so equal strings are first brought together:

1. Anchors.  A string's anchor is its 32-byte gram with the smallest hash
   (the last of equals), a function of the string alone.  Consecutive strings
   of a document with one anchor are a segment (about 285 bytes).  Equal
   strings lie in segments of equal anchors.
2. Anchors that occur once are dropped.  Segments are counted by (anchor,
   hash of the segment): a segment that occurs twice is repeated as a whole,
   and copies of it enter the next step once.
3. Where an anchor has different segments, these are dealt by anchor into
   blocks of about ``block_bytes``; each block's Burrows-Wheeler transform is
   expanded breadth first up to ``length`` (see ``bwt``).  An anchor with more
   than ``split_over`` different segments would not fit a block: its strings
   are counted one by one by 128-bit hash, with map-side combine.
4. Marked starts go back to their documents, where the covered bytes are
   merged and removed.

Defined cases: a null text is empty; texts shorter than ``length`` lose
nothing; rows repeated with the same id and text are repeated strings of each
other; an empty table gives no row; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm import text as tx
from wearline.llm.bwt import repeated_windows
from wearline.llm.common import row_key, store

GRAM = 32
U64 = np.uint64
_PLACE_BITS = 24
_CHUNK = 1 << 21
_SEGMENT_VALUES = tx.mix(tx._VALUES[False] + U64(1))
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SEGMENTS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])


def _byte_grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each place, by doubling."""
    base = 0x9E3779B97F4A7C15 | 1
    h, k = tx._VALUES[False][data], 1
    while k < GRAM:
        h = h[:-k] * U64(pow(base, k, 2**64)) + h[k:]
        k *= 2
    return tx.mix(h)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, anchor, segment hash) of a chunk's segments."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = _byte_grams(data)
    top = U64((1 << _PLACE_BITS) - 1)
    best = (g & ~top) | (top - np.arange(len(g), dtype=np.uint64))
    span = 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    place = (top - (best & top)).astype(np.int64)  # the anchor of the string at each start
    starts = np.maximum(0, np.diff(offsets) - length + 1)
    doc = np.repeat(np.arange(len(starts)), starts)
    at = np.arange(starts.sum()) + np.repeat(offsets[:-1] - (np.cumsum(starts) - starts), starts)
    anchor_at = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    up, down = tx._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SEGMENT_VALUES[data] * up[:n], dtype=np.uint64, out=sums[1:])
    end = begin + count + length - 1
    seg = tx.mix((sums[end] - sums[begin]) * down[begin] ^ (end - begin).astype(np.uint64))
    return doc[first], begin - offsets[doc[first]], count, g[anchor_at[first]], seg


def _chunks(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, start in that row, bytes, offsets): whole documents, or overlapping parts of a long one."""
    for i, j in tx.pieces(offsets, _CHUNK):
        own = data[offsets[i] : offsets[j]]
        if len(own) <= 2 * _CHUNK:
            yield i, 0, own, offsets[i : j + 1] - offsets[i]
            continue
        # the starts of a part end where those of the next begin
        for lo in range(0, len(own) - length + 1, _CHUNK):
            part = own[lo : lo + _CHUNK + length - 1]
            yield i, lo, part, np.array([0, len(part)])


def _emit(length: int):
    def emit(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k1", "_k2"))
            for row, shift, part, own in _chunks(data, offsets, length):
                doc, start, count, anchor, seg = segments(part, own, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1[row + doc]), pa.array(k2[row + doc]), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)),
                    pa.array((start + shift).astype(np.int32)), pa.array(count.astype(np.int32)),
                ], schema=_SEGMENTS)

    return emit


def _emit_anchors(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int32())])

    def emit(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            for _, _, part, own in _chunks(data, offsets, length):
                anchor, n = np.unique(segments(part, own, length)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int32))], schema=schema)

    return emit


def _cut(length: int):
    """Bytes of the segments that a document represents."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            for i, own in enumerate(batch.column("_need").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                rows = [(x["anchor"], x["seg"], text[x["start"] : x["start"] + x["count"] + length - 1]) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _block(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("runs", _RANGES)])

    def expand(table: pa.Table) -> pa.Table:
        marks = repeated_windows(table.column("bytes").to_pylist(), length)
        runs = [_runs(m) for m in marks]
        keep = pa.array([bool(r) for r in runs])
        return pa.Table.from_arrays([table.column("anchor"), table.column("seg"), pa.array(runs, _RANGES)], schema=schema).filter(keep)

    return expand


def _windows(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("at", pa.int32()), ("w", pa.binary())])

    def windows(batches):
        for batch in batches:
            for anchor, seg, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "bytes")), strict=True):
                n = len(text) - length + 1
                digests = [hashlib.blake2b(text[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests)], schema=schema)

    return windows


def _finish(length: int, with_kept: bool):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("kept", pa.binary()),
    ])

    def finish(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, runs in enumerate(batch.column("_runs").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                change = np.zeros(len(own) + 1, np.int64)
                if runs:
                    np.add.at(change, [r["lo"] for r in runs], 1)
                    np.add.at(change, [r["hi"] + length - 1 for r in runs], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = own[~gone].tobytes()
                spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                rows.append((ids[i], len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[lo : lo + 256], strict=True), schema, strict=True)], schema=schema)

    return finish


def marked_segments(found: DataFrame, texts: DataFrame, length: int, block_bytes: int, split_over: int) -> DataFrame:
    """(anchor, seg, runs): ranges of starts, relative to the segment, of repeated strings."""
    kinds = store(
        found.groupBy("anchor", "seg").agg(F.min(F.struct("_k1", "_k2", "start", "count")).alias("_rep"), F.count(F.lit(1)).alias("n")),
        "substring-kinds",
    )
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = store(mixed, "substring-mixed")  # read back, its joins are plain exchanges that split a hot anchor
    several = kinds.join(mixed, "anchor")
    need = several.groupBy("_rep._k1", "_rep._k2").agg(
        F.collect_list(F.struct("anchor", "seg", F.col("_rep.start").alias("start"), F.col("_rep.count").alias("count"))).alias("_need")
    )
    pieces = texts.join(need, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_text", "_need")
    pieces = pieces.mapInArrow(_cut(length), "anchor long, seg long, bytes binary")
    pieces = store(pieces.join(mixed, "anchor"), "substring-pieces")
    small = pieces.where(F.col("kinds") <= split_over)
    total = small.agg(F.sum(F.octet_length("bytes")).cast("long")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    runs = small.select(block.alias("_block"), "anchor", "seg", "bytes").groupBy("_block").applyInArrow(
        _block(length), "anchor long, seg long, runs array<struct<lo:int,hi:int>>"
    )
    windows = pieces.where(F.col("kinds") > split_over).mapInArrow(_windows(length), "anchor long, seg long, at int, w binary")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("w")
    split = windows.join(twice, "w").groupBy("anchor", "seg").agg(
        F.transform(F.array_sort(F.collect_list("at")), lambda x: F.struct(x.alias("lo"), (x + 1).alias("hi"))).alias("runs")
    )
    whole = kinds.where("n > 1").select(
        "anchor", "seg", F.array(F.struct(F.lit(0).alias("lo"), F.col("_rep.count").alias("hi"))).alias("runs")
    )
    return store(whole.unionByName(runs).unionByName(split), "substring-runs")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                    block_bytes: int = 2 << 20, split_over: int = 8192, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` holds the remaining bytes."""
    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    source = keyed.select("_k1", "_k2", "_text")
    anchors = source.select("_text").mapInArrow(_emit_anchors(length), "anchor long, n int")
    repeated = store(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "substring-anchors")
    rows = source.mapInArrow(_emit(length), "_k1 long, _k2 long, anchor long, seg long, start int, count int")
    found = store(rows.join(repeated, "anchor"), "substring-segments")

    # only documents with a repeated anchor keep their text for the next shuffles; the others are done
    touched = found.select("_k1", "_k2").distinct().withColumn("_touched", F.lit(True))
    data = F.encode(F.coalesce("_text", F.lit("")), "UTF-8")
    alone = F.col("_touched").isNull()
    aside = keyed.join(touched, ["_k1", "_k2"], "left").select(
        "_k1", "_k2", "doc_id", "_touched", F.when(F.lit(with_kept) | ~alone, F.col("_text")).alias("_text"),
        F.when(alone, F.octet_length(data)).cast("long").alias("n_bytes"), F.when(alone, F.sha2(data, 256)).alias("kept_sha256"),
    )
    aside = store(aside, "substring-documents")
    texts = aside.where(~alone).select("_k1", "_k2", "doc_id", "_text")

    marked = marked_segments(found, texts, length, block_bytes, split_over)
    # a set: rows repeated with equal id and text bring the same ranges and hold them once
    per_doc = found.join(marked, ["anchor", "seg"]).groupBy("_k1", "_k2").agg(
        F.flatten(F.collect_set(
            F.transform("runs", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi")))
        )).alias("_runs")
    )
    done = texts.join(per_doc, ["_k1", "_k2"], "left").select("doc_id", "_text", "_runs").mapInArrow(
        _finish(length, with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    none = F.lit(0).cast("long")
    same = aside.where(alone).select(
        "doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256",
        (data if with_kept else F.lit(None).cast("binary")).alias("kept"),
    )
    return same.unionByName(done)
