"""Benchmark decontamination by winnowing.

Texts are words (digits, letters, every character beyond ASCII; A-Z folded).
A benchmark item of 13 words or more has a window at each of its 13-word runs;
a shorter one is one window of all its words.  Of the 5-word grams of a text
the minimum hash per sliding window of 9 grams is kept, so any shared run of
13 words shares a kept gram at the same place.  Fingerprints of the corpus are
joined with those of the benchmark and each hit is extended word by word to
both sides; a run of 13 equal words or more is contamination.  Items of m < 13
words are fingerprinted by their one m-gram and compared with every m-gram.

The benchmark's fingerprints are a table that a Spark job writes.  A bit table
of them, of fixed size, travels to the pass over the documents: what misses it
is in no item and is never shuffled; the rest, with the words around it, meets
the table in a Spark join, which broadcasts or splits a hot fingerprint by its
size at run time.  A full bit table lets more through, never fewer.  No
document text is shuffled and no item passes through the driver.

Hash equality of single words (64 bits), and of whole short items, decides.

Defined cases: a null or empty text has no words, no hit and is clean; an item
without words provides no window; the windows of items with a null id are hit
like any other, and the item is not listed; an id that several items carry is
listed once; an empty benchmark leaves every document clean; rows repeated with
the same id and text are judged alike; other columns pass through
``remove_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm import text as tx
from wearline.llm.common import by_place, row_key, store
from wearline.llm.phrases import _admitted, _table

WINDOW = 13
GRAM = 5
SLIDE = WINDOW - GRAM + 1
#: ``m`` of the fingerprints of items of WINDOW words or more.
LONG = 0
PRINTS = pa.schema([("h", pa.int64()), ("m", pa.int32()), ("item", pa.string()), ("around", pa.binary())])
_PLACE = pa.struct([("h", pa.int64()), ("m", pa.int32()), ("at", pa.int64()), ("own", pa.binary())])
SCANNED = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(_PLACE))])
SCANNED_DDL = "_k1 long, _k2 long, doc_id long, n_words long, places array<struct<h:long,m:int,at:long,own:binary>>"
HITS = "array<struct<lo:bigint,hi:bigint>>"


def winnow(g: np.ndarray, group: np.ndarray, slide: int) -> np.ndarray:
    """Indices of the grams kept: each run of ``slide`` grams of one group keeps its minimum (last of equals).

    A group with fewer grams than ``slide`` keeps none: it has no window.
    """
    n = len(g) - slide + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = g[:n].copy()
    at = np.arange(n)
    for j in range(1, slide):
        other = g[j : j + n]
        take = other <= best
        best[take] = other[take]
        at[take] = np.flatnonzero(take) + j
    valid = group[:n] == group[slide - 1 :]
    return np.unique(at[valid])


def _fingerprints(words: tx.Words, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept 5-grams for ``LONG``, else of every ``m``-gram inside a text."""
    size = GRAM if m == LONG else m
    g = tx.mix(tx.grams(h, size) ^ tx.U64(m))
    if not len(g):
        return np.zeros(0, np.int64), g
    doc = words.doc[: len(g)]
    inside = doc == words.doc[size - 1 :]
    if m != LONG:
        at = np.flatnonzero(inside)
    else:  # a gram across a border is a group of its own, so that no window holds it
        at = winnow(np.where(inside, g, tx.U64(2**64 - 1)), np.where(inside, doc, -1 - np.arange(len(doc))), SLIDE)
    return at, g[at]


def _around(words: tx.Words, h: np.ndarray, at: np.ndarray, none: int) -> pa.Array:
    """Word hashes from SLIDE - 1 before each place to WINDOW - 1 behind it; ``none`` beyond the text.

    Every window that holds a kept gram at its place lies in there.
    """
    index = at[:, None] + np.arange(1 - SLIDE, WINDOW)
    near = np.clip(index, 0, max(0, len(h) - 1))
    own = (index == near) & (words.doc[near] == words.doc[at][:, None])
    data = np.where(own, h[near], tx.U64(none))
    offsets = np.arange(len(at) + 1, dtype=np.int32) * (8 * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _print_items(block_words: int):
    def prints(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("text"))
            for i, j in tx.pieces(offsets, 2 * block_words):
                words = tx.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tx.WORD)
                h, names = words.hashes(lower=True), batch.column("item").slice(i, j - i)
                at, g = _fingerprints(words, h, LONG)
                found = [(LONG, at, g, _around(words, h, at, 1))]
                for m in np.unique(words.count[(words.count > 0) & (words.count < WINDOW)]).tolist():
                    at, g = _fingerprints(words, h, m)
                    whole = words.count[words.doc[at]] == m
                    found.append((m, at[whole], g[whole], pa.nulls(int(whole.sum()), pa.binary())))
                for m, at, g, around in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), pa.array(np.full(len(at), m, np.int32)), names.take(pa.array(words.doc[at])), around], schema=PRINTS
                    )

    return prints


def benchmark_prints(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> DataFrame:
    """Written table (h, m, item, around) of the fingerprints of all items."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return store(items.mapInArrow(_print_items(block_words), "h long, m int, item string, around binary").distinct(), "benchmark-prints")


def _scan(sizes: list[int], bits):
    """Per row its words, and the places whose fingerprint is in the bit table."""

    def scan(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            for i, j in tx.pieces(offsets):
                words = tx.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tx.WORD)
                h = words.hashes(lower=True)
                places, hashes, lengths, around = [], [], [], []
                for m in sizes:
                    at, g = _fingerprints(words, h, m)
                    known = _admitted(table, g)
                    at, g = at[known], g[known]
                    places.append(at)
                    hashes.append(g)
                    lengths.append(np.full(len(at), m, np.int32))
                    around.append(_around(words, h, at, 0) if m == LONG else pa.nulls(len(at), pa.binary()))
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                order = np.argsort(at, kind="stable")
                at = at[order]
                doc = words.doc[at]
                if len(at):
                    g, m, own = np.concatenate(hashes)[order], np.concatenate(lengths)[order], pa.concat_arrays(around).take(pa.array(order))
                else:
                    g, m, own = np.zeros(0, np.uint64), np.zeros(0, np.int32), pa.nulls(0, pa.binary())
                found = pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array(m), pa.array(at - words.first[doc]), own], fields=list(_PLACE))
                cuts = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                keys = [batch.column(c).slice(i, j - i) for c in ("_k1", "_k2", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(cuts, found)], schema=SCANNED
                )

    return scan


def _words_of(column: pa.Array) -> np.ndarray:
    """The word hashes of ``_around``, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SLIDE - 1 + WINDOW)


def _extend(batches):
    """Ranges of words of the joined places that are in an occurring window."""
    schema = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("item", pa.string())])
    for batch in batches:
        m = batch.column("m").to_numpy()
        lo = batch.column("at").to_numpy().copy()
        hi = lo + m
        long = m == LONG
        if long.any():
            mask = pa.array(long)
            equal = _words_of(batch.column("own").filter(mask)) == _words_of(batch.column("around").filter(mask))
            left = np.logical_and.accumulate(equal[:, SLIDE - 2 :: -1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(equal[:, SLIDE - 1 :], axis=1).sum(axis=1)
            run = left + right >= WINDOW
            hi[long] = np.where(run, lo[long] + right, lo[long])
            lo[long] -= np.where(run, left, 0)
        hit = pa.array(hi > lo)
        columns = [batch.column("_k1"), batch.column("_k2"), pa.array(lo), pa.array(hi), batch.column("item")]
        yield pa.RecordBatch.from_arrays([c.filter(hit) for c in columns], schema=schema)


def _merge(ranges: list[dict]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"lo": a, "hi": b} for a, b in out]


def _merge_hits(batches):
    hits_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        merged = [_merge(r) for r in batch.column("hits").to_pylist()]
        counts = [sum(x["hi"] - x["lo"] for x in r) for r in merged]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k1"), batch.column("_k2"), pa.array(counts, pa.int64()), batch.column("items"), pa.array(merged, hits_type)],
            names=["_k1", "_k2", "n_hit", "items", "hits"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: keys, doc_id, n_words, n_hit, items (ids as sorted strings), hits (word ranges).

    A task fingerprints about ``block_words`` words of the benchmark at a time.
    """
    prints = benchmark_prints(benchmark, item_col, item_text_col, block_words)
    sizes = sorted(r["m"] for r in prints.select("m").distinct().collect())  # WINDOW values at most
    bits = docs.sparkSession.sparkContext.broadcast(_table(prints).tobytes())
    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    scanned = store(keyed.mapInArrow(_scan(sizes, bits), SCANNED_DDL), "contamination")
    places = scanned.select("_k1", "_k2", F.explode("places").alias("p")).select("_k1", "_k2", "p.*")
    met = places.join(prints, ["h", "m"]).select("_k1", "_k2", "m", "at", "own", "around", "item")
    runs = met.mapInArrow(_extend, "_k1 long, _k2 long, lo long, hi long, item string")
    # a document's ranges are bounded by its words, its items by the benchmark's
    hits = runs.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("lo", "hi")).alias("hits"))
    hits = hits.mapInArrow(_merge_hits, f"_k1 long, _k2 long, n_hit long, items array<string>, hits {HITS}")
    return scanned.drop("places").join(hits, ["_k1", "_k2"], "left").select(
        "_k1", "_k2", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast(HITS)).alias("hits"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without its contaminated rows; other columns are passed through, whatever their names."""
    placed, (own_id, own_text) = by_place(docs, id_col, text_col)
    bad = contamination(placed, benchmark, own_id, own_text, **names).where(is_contaminated()).select("_k1", "_k2").distinct()
    marked = placed.select(F.struct(*placed.columns).alias("_row"), *row_key(F.col(own_id), F.col(own_text)))
    return marked.join(bad, ["_k1", "_k2"], "left_anti").select("_row.*").toDF(*docs.columns)
