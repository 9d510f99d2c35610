"""Collocations by sampled mining with a negative border (Toivonen).

A phrase is 1 to ``longest`` consecutive words of one piece of a text, counted
per language.  A sample of the documents proposes phrases; the full pass counts
them exactly together with their negative border, which for contiguous phrases
are those of which both shorter parts are proposed (all single words belong to
it).  A frequent phrase of the border that was not proposed is a failure of the
sample; then a closing pass counts every phrase not counted yet whose shorter
parts are all frequent or not known either.  A frequent phrase has frequent
parts only, so by induction over its length that pass leaves none out: one
expansion closes the border, and the counts do not depend on the sample.

These passes tell phrases apart by a 64-bit hash, and the proposals travel as a
bit table of fixed size.  A phrase that hits the table by chance is counted in
vain; one that was proposed is never missed.  A phrase is counted whole in one
pass, the two conditions exclude each other.  Two phrases of one hash could
pass together what neither would alone, never less, so a last pass counts by
text those whose hash was found frequent: its counts are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import store
from wearline.llm.text import U64, Words, mix, texts

LONGEST = 4
MIN_COUNT = 30
#: One document in SAMPLE is sampled; SAMPLE_COUNT sightings there propose a phrase.  Both only
#: shift work between the full pass and the passes behind it, never a count.
SAMPLE, SAMPLE_COUNT = 16, 4
#: log2 of the bits of the table of proposals (8 MB).
TABLE_BITS = 26
KEEP_PER_LANG = 2000

#: Bytes that end a piece, and those that only end a word.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _OTHER_BASE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _cut_long(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document of each part) of about ``most`` bytes.

    A document above that is cut behind a byte that ends a piece, where no
    phrase can lie across; without such a byte it stays whole.
    """
    cuts, docs = [0], []
    for d in range(len(offsets) - 1):
        at, end = int(offsets[d]), int(offsets[d + 1])
        while end - at > most:
            found = np.flatnonzero(_BREAK[data[at + most : end]])
            if not len(found):
                break
            at += most + int(found[0]) + 1
            cuts.append(at)
            docs.append(d)
        cuts.append(end)
        docs.append(d)
    cuts, docs = np.array(cuts, np.int64), np.array(docs, np.int64)
    i, n = 0, len(docs)
    while i < n:
        j = min(max(int(np.searchsorted(cuts, cuts[i] + most, side="right")) - 1, i + 1), n)
        yield data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], docs[i:j]
        i = j


def _lang_codes(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of each row's language, the languages, and a hash of each."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names]
    return coded.indices.to_numpy(zero_copy_only=False), names, np.array(hashes, np.uint64)


def _bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = U64(64 - TABLE_BITS)
    return h >> shift, (h * _BASE) >> shift


def _admitted(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for bit in _bits_of(h):
        out &= (table[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def _spell(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The phrases of ``k`` words from word ``first`` on, joined by one space."""
    index = first[:, None] + np.arange(k)
    sizes = (end - start)[index] + 1
    sizes[:, -1] -= 1
    flat = sizes.ravel()
    ends = np.cumsum(flat)
    source = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(start[index].ravel() - (ends - flat), flat)
    out = _LOWER[data[np.minimum(source, len(data) - 1)]]
    if k > 1:
        out[ends.reshape(-1, k)[:, :-1].ravel() - 1] = 0x20
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(sizes.sum(axis=1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))


class _Phrases:
    """The phrases of some documents: by length, the word each begins with and its hash.

    ``lang``: code of the language by document, ``lang_hash`` by code.  The hash
    takes in the language.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray):
        self.words = words = Words(data, offsets, _WORD)
        n = len(words.start)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], out=breaks[1:])
        joined = (breaks[words.start[1:]] == breaks[words.start[:-1]]) & (words.doc[1:] == words.doc[:-1])
        self.lang = lang[words.doc]
        salt = lang_hash[self.lang]
        word = self.word = words.hashes(True)
        self.valid, self.hash = [np.ones(n, bool)], [mix(word ^ salt)]
        rolling = word
        for k in range(2, min(LONGEST, n) + 1):
            m = n - k + 1
            rolling = rolling[:m] * _BASE + word[k - 1 :]
            self.valid.append(self.valid[-1][:m] & joined[k - 2 :])
            self.hash.append(mix(mix(rolling) ^ salt[:m] ^ U64(k)))

    def second(self, k: int, at: np.ndarray) -> np.ndarray:
        """Another hash of the phrases of ``k`` words from the words ``at`` on, and of their words' sizes."""
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            size = (self.words.end[at + j] - self.words.start[at + j]).astype(np.uint64)
            out = (out + self.word[at + j]) * _OTHER_BASE + size
        return out

    def of(self, k: int) -> np.ndarray:
        """First words of the phrases of ``k`` words."""
        return np.flatnonzero(self.valid[k - 1]) if k <= len(self.valid) else np.zeros(0, np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Phrases, list[str]]]:
    for batch in batches:
        code, names, hashes = _lang_codes(batch.column(0))
        data, offsets = texts(batch.column(1))
        for part, part_offsets, of in _cut_long(data, offsets):
            found = _Phrases(part, part_offsets, code[of], hashes)
            if len(found.words.start):
                yield found, names
        pa.default_memory_pool().release_unused()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def _hashed_counts(docs: DataFrame, proposed, closing=None) -> DataFrame:
    """(h, n): how often the phrases of hash ``h`` occur.

    ``proposed`` None: every phrase.  A table: single words, and what has both
    its shorter parts (without the last or the first word) in the table.
    ``closing``, a table that holds ``proposed``: what the pass with
    ``proposed`` left out and has each shorter part in ``closing`` or among the
    phrases counted here.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_table = None if proposed is None else np.frombuffer(proposed.value, np.uint8)
        second_table = None if closing is None else np.frombuffer(closing.value, np.uint8)
        for found, _ in _parts(batches):
            counted = [found.hash[0]] if second_table is None else []
            open_ = np.zeros(len(found.hash[0]), bool)  # shorter phrases counted in this pass
            for k in range(2, LONGEST + 1):
                at = found.of(k)
                if not len(at):
                    break
                if first_table is not None:
                    shorter = found.hash[k - 2]
                    known = _admitted(first_table, shorter)
                    in_first = known[at] & known[at + 1]
                    if second_table is None:
                        at = at[in_first]
                    else:
                        at = at[~in_first]
                        at = at[open_[at] | _admitted(second_table, shorter[at])]
                        at = at[open_[at + 1] | _admitted(second_table, shorter[at + 1])]
                        open_ = np.zeros(len(open_), bool)
                        open_[at] = True
                if len(at):
                    counted.append(found.hash[k - 1][at])
            if counted:
                h, n = np.unique(np.concatenate(counted), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return _rows(docs).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _exact_counts(docs: DataFrame, table, most: int = 1 << 17) -> DataFrame:
    """Counts by text of the phrases whose own hash is in ``table``, and all words as a phrase of no words.

    A task holds ``most`` counts before it hands them on.
    """
    columns = ["lang", "k", "phrase"]

    def merged(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(columns, use_threads=False).aggregate([("n", "sum")])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*columns, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(table.value, np.uint8)
        held: list[pa.Table] = []
        for found, names in _parts(batches):
            words, langs = found.words, pa.array(names, pa.string())
            total = np.bincount(found.lang, minlength=len(names))
            held.append(pa.table({
                "lang": langs, "k": pa.array(np.zeros(len(names), np.int32)), "phrase": pa.array([""] * len(names), pa.string()),
                "n": pa.array(total.astype(np.int64))}))
            for k in range(1, LONGEST + 1):
                at = found.of(k)
                at = at[_admitted(wanted, found.hash[k - 1][at])] if len(at) else at
                for i in range(0, len(at), 1 << 15):
                    some = at[i : i + (1 << 15)]
                    _, first, own, n = np.unique(found.hash[k - 1][some], return_index=True, return_inverse=True, return_counts=True)
                    second = found.second(k, some)
                    if (second[first][own] == second).all():
                        some = some[first]
                    else:  # two phrases of one hash
                        n = np.ones(len(some), np.int64)
                    held.append(pa.table({
                        "lang": langs.take(pa.array(found.lang[some])), "k": pa.array(np.full(len(some), k, np.int32)),
                        "phrase": _spell(words.data, words.start, words.end, some, k), "n": pa.array(n.astype(np.int64))}))
            if sum(t.num_rows for t in held) > most:
                held = [merged(held)]
                if held[0].num_rows > most // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    parts = _rows(docs).mapInArrow(count, "lang string, k int, phrase string, n long")
    return parts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _table(hashes: DataFrame) -> np.ndarray:
    """Bit table of the hashes ``h``: Spark merges the bits of each 64-bit word, the table has a fixed size."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for bit in _bits_of(h):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bit >> U64(6)).astype(np.int64)), pa.array((U64(1) << (bit & U64(63))).view(np.int64))], names=["at", "bits"])

    merged = hashes.select("h").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = merged.toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE, sample_count: int = SAMPLE_COUNT) -> DataFrame:
    """(lang, k, phrase, n): every phrase of 1 to 4 words found ``min_count`` times, and a
    row with ``k`` 0 and an empty phrase with the number of all words of the language.

    ``docs`` needs ``text`` and ``lang``; a null text has no words, a null
    language is ``und``, rows repeated are counted as often as they come.
    Texts without a word, and tables without a row, give nothing.
    """
    context = docs.sparkSession.sparkContext
    sampled = docs.where(F.pmod(F.xxhash64(F.lit("sample"), *[c for c in ("doc_id", "text", "lang") if c in docs.columns]), F.lit(sample)) == 0)
    table = _table(_hashed_counts(sampled, None).where(F.col("n") >= sample_count))
    proposed = context.broadcast(table.tobytes())
    counted = store(_hashed_counts(docs, proposed).where(F.col("n") >= min_count), "phrases")
    frequent = _table(counted)
    if (frequent & ~table).any():
        closing = context.broadcast((table | frequent).tobytes())
        failed = store(_hashed_counts(docs, proposed, closing).where(F.col("n") >= min_count), "phrases")
        frequent |= _table(failed)
    exact = _exact_counts(docs, context.broadcast(frequent.tobytes()))
    return store(exact.where((F.col("k") == 0) & (F.col("n") > 0) | (F.col("k") > 0) & (F.col("n") >= min_count)), "phrases")


def _wide(col: str):
    return F.col(col).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, keep: int = KEEP_PER_LANG, contained_share: int = 80, **mining) -> DataFrame:
    """Each language's ``keep`` best phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its weakest cut: twice its count over the counts of both
    parts, in millionths.  It is dropped if a longer frequent phrase holds it
    and has ``contained_share`` percent of its count.  Equal scores rank by
    count, then by the bytes of the phrase.
    """
    found = frequent_phrases(docs, min_count, **mining)
    words = F.split("phrase", " ")
    candidates = found.where(F.col("k") >= 2).select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    parts = found.where(F.col("k").between(1, LONGEST - 1)).select("lang", "phrase", "n")

    def part(name: str, value: str) -> DataFrame:
        return parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "k", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r", "a")).alias("c"))

    longer = candidates.where(F.col("k") >= 3)
    sizes = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inside = sizes.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))).select(
        "lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), F.col("a").alias("_longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = weakest.select("lang", "phrase", "c.*").join(inside, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.lit(100).cast("decimal(3,0)") * _wide("_longer") < F.lit(contained_share).cast("decimal(3,0)") * _wide("a")))

    # the best of each of 64 parts of a language first, so that no task ranks a whole language
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= keep)
    total = found.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
