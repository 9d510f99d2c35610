"""Best-fit packing of tokenised documents with swap-based local search.

A document is its token ids and an end id; a longer one than ``capacity`` is
cut into full pieces after a shorter first one.  Which piece of a given length
goes into a place of that length makes no difference to the fill, so the
packing is planned on the histogram of lengths, which has ``capacity`` entries
at any corpus size:

* the driver packs the histogram by best fit decreasing, whole groups of bins
  with equal contents at a time;
* swap-based local search then exchanges documents between underfull bins
  (move, one for one, two for one, one for two), always towards the fuller
  bin, which increases the sum of squared fills, until bins empty, the lower
  bound is reached or no exchange is left;
* tasks number the pieces per length and look up each number's bin and offset.

Numbers are exact without a global sort: a task counts its own pieces of each
length while it writes them, and the counts of earlier partitions are added.

Defined cases: a null or empty text is one piece that holds the end id alone;
null or repeated ids are documents of their own; an empty table gives no row;
only the id and the text column are read.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import store

CAPACITY = 2048
END_ID = 0
_CACHE_WORDS = 400_000
#: Runs of white space could be split otherwise inside a whole text than in its parts.
_TWO_SPACES = re.compile(r"\s\s")
_ENCODERS: dict = {}
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("_part", pa.int64()), ("_nth", pa.int64()), ("ids", pa.binary()),
])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, _part long, _nth long, ids binary"


class _Encoder(dict):
    """Token ids of space-separated parts as bytes, remembered up to a bounded number of parts.

    The ranks file holds the vocabulary of the JSON tokenizer; its encoder
    gives the same ids several times faster (tested against each other).
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.whole(" " + part)
        if len(self) < _CACHE_WORDS and len(part) < 64:
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """A token never holds a space behind another character, so parts that begin
        with a single space are encoded one by one."""
        if _TWO_SPACES.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def encoder(ranks_path: str, pattern: str) -> _Encoder:
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = _Encoder(ranks_path, pattern)
    return _ENCODERS[ranks_path]


def _tokenise(ranks_path: str, pattern: str, capacity: int, keep_ids: bool):
    def cut(batches):
        enc, part, seen = encoder(ranks_path, pattern), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            rows, size = [], 0
            for k, text in enumerate(batch.column("_text").to_pylist()):
                raw = enc.ids(text or "") + end
                n, at, piece = len(raw) // 4, 0, 0
                while at < n:
                    take = n % capacity or capacity if at == 0 else capacity
                    ids = raw[4 * at : 4 * (at + take)]
                    rows.append((ids_of[k], piece, at, take, zlib.crc32(ids), part, seen[take], ids if keep_ids else None))
                    seen[take] += 1
                    at, piece = at + take, piece + 1
                size += len(raw)
                if size > 1 << 23:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return cut


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over equal bins at a time: (contents, number of bins)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted residuals with bins

    def put(contents, n):
        left = capacity - sum(contents)
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        room[left].append((contents, n))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if count // fit:
                    put((length,) * fit, count // fit)
                if count % fit:
                    put((length,) * (count % fit), 1)
                break
            left = rooms[at]
            contents, n = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            fit = min(left // length, count)
            bins = min(n, count // fit)
            if n > bins:
                put(contents, n - bins)
            put(contents + (length,) * fit, bins)
            count -= fit * bins
    return [x for left in rooms for x in room[left]]


def _transfer(donor: tuple[int, ...], receiver: tuple[int, ...], left: int):
    """The exchange that moves most tokens, up to ``left``, from donor to receiver: (given, taken) or None."""
    ones, own = sorted(set(donor)), sorted(set(receiver))
    twos = {a + b: (a, b) for i, a in enumerate(ones) for b in ones[i:] if a != b or donor.count(a) > 1}
    pairs = {a + b: (a, b) for i, a in enumerate(own) for b in own[i:] if a != b or receiver.count(a) > 1}
    give = {a: (a,) for a in ones}
    best, found = 0, None
    for gifts, takes in ((give, {0: ()}), (give, {a: (a,) for a in own}), (twos, {a: (a,) for a in own}), (give, pairs)):
        sums = sorted(takes)
        for g, what in gifts.items():
            at = bisect.bisect_left(sums, g - left)  # the smallest return that fits
            if at < len(sums) and best < g - sums[at]:
                best, found = g - sums[at], (what, takes[sums[at]])
    return found


def _without(contents: tuple[int, ...], gone: tuple[int, ...]) -> tuple[int, ...]:
    out = list(contents)
    for x in gone:
        out.remove(x)
    return tuple(out)


def local_search(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Empty bins by exchanges that increase the sum of squared fills."""
    total = sum(sum(c) * n for c, n in bins)
    least = -(-total // capacity)
    full = [x for x in bins if sum(x[0]) == capacity]
    under: Counter = Counter()
    for contents, n in bins:
        if sum(contents) < capacity:
            under[tuple(sorted(contents))] += n
    count = sum(n for _, n in bins)
    settled: set[tuple[int, ...]] = set()  # donors without an exchange since the last change
    while count > least:
        donors = [c for c in under if c not in settled]
        if not donors:
            break
        donor = min(donors, key=lambda c: (sum(c), c))
        for receiver in sorted(under, key=lambda c: (-sum(c), c)):
            if sum(receiver) < sum(donor):
                continue
            times = under[donor] // 2 if receiver == donor else min(under[donor], under[receiver])
            swap = times and _transfer(donor, receiver, capacity - sum(receiver))
            if not swap:
                continue
            given, taken = swap
            for c in (donor, receiver):
                under[c] -= times
                if not under[c]:
                    del under[c]
            poorer = tuple(sorted(_without(donor, given) + taken))
            richer = tuple(sorted(_without(receiver, taken) + given))
            if poorer:
                under[poorer] += times
            else:
                count -= times
            if sum(richer) < capacity:
                under[richer] += times
            else:
                full.append((richer, times))
            settled.clear()
            break
        else:
            settled.add(donor)
    return full + list(under.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, first bin, offset) in order: numbers from there on fill bins from there on."""
    out, used, first_bin = [], Counter(), 0
    whole = histogram.get(capacity, 0)
    if whole:
        out.append((capacity, 0, 0, 0))
        first_bin = whole
    rest = {k: n for k, n in histogram.items() if k < capacity and n}
    for contents, n in local_search(best_fit(rest, capacity), capacity):
        offset = 0
        for length in contents:
            out.append((length, used[length], first_bin, offset))
            used[length] += n
            offset += length
        first_bin += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _assign(places: np.ndarray):
    keys = (places[:, 0].astype(np.uint64) << np.uint64(44)) | places[:, 1].astype(np.uint64)

    def assign(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("length", "_number"))
            at = np.searchsorted(keys, (length << np.uint64(44)) | number, "right") - 1
            bin_ = places[at, 2] + number.astype(np.int64) - places[at, 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(bin_), pa.array(places[at, 3]), batch.column("ids")],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"],
            )

    return assign


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (unsigned 32 bits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    pieces = store(rows.mapInArrow(_tokenise(ranks_path, pattern, capacity, keep_ids), _PIECES_DDL), "pack-pieces")
    counts = store(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    numbered = pieces.join(starts, ["_part", "length"]).withColumn("_number", F.col("_from") + F.col("_nth"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    return numbered.mapInArrow(_assign(plan(histogram, capacity)), ddl)
