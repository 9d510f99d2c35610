"""N-gram Jaccard join by parity sketches, and its connected components.

A document's set: its distinct 5-word shingles (A-Z folded, words split at
ASCII white space); with fewer words the whole sequence is the one shingle.
Documents link when 100 * intersection >= 80 * union.

Sketch.  Per size band (sizes from ``lo`` to 2 * ``lo``) the shingle space is
cut into m parts and every shingle hash is XORed into its part's word, so a
part's word is the parity of what falls into it.  Every element of the
symmetric difference changes one word, hence the number of differing words
(a Hamming distance) never exceeds the symmetric difference, which for linked
sets of n and up to 1.25 n shingles is at most D = n / 4.

Pigeonhole.  Each set offers its first D + e non-empty words as keys, with
e = n / 64 + 1, in one order for all sets: of the shorter of two such prefixes
at most D words can differ, so linked sets share e keys (the e of the smaller
set).  A set with fewer non-empty words offers them all and one key that such
sets share, which counts for any number.  Sets within 80 % of the next band's
lower bound offer keys there too.  No candidate is capped or sampled: keys that
many of a sixteenth of the texts offer only come last in the order, and any
order gives the same links.

Verify.  Sets equal by hash are one node.  Round one tests, per key, all
members against the member with most shared keys, which merges groups of near
copies by a star instead of all pairs.  Round two tests every remaining pair
of members of e keys whose components still differ.  Before texts are compared,
a 512-bit parity sketch (bit differences again bound the symmetric difference
from below) and the sizes drop hopeless pairs; then the shingle sets decide.

Defined cases: a null text, or one without words, has no shingle and links
with nothing; a null id is a component of its own value (null) and never the
smallest; repeated rows are linked like other copies; an empty table gives no
row; columns other than the id and the text are not read, or passed through
by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm import text as tx
from wearline.llm.common import by_place, row_key, store
from wearline.llm.graph import components

SHINGLE = 5
LEVEL = 80
SKETCH_BITS = 512
U64 = np.uint64
_SALT = [U64(x) for x in (0x8C511C2D4E7A9F31, 0x51A3F0B7C62D1E85, 0xD1B54A32D192ED03, 0xA24BAED4963EE407, 0x27BB2EE687B0B0FD)]


class Sets:
    """Sorted distinct shingle hashes of each document: ``h[first[d]:first[d+1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = tx.Words(data, offsets, tx.NOT_SPACE)
        w = words.hashes(lower=True)
        g = tx.grams(w, SHINGLE)
        inside = np.flatnonzero(words.doc[: len(g)] == words.doc[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
        hashes, docs = [g[inside]], [words.doc[inside]]
        for m in range(1, SHINGLE):
            short = words.first[:-1][words.count == m]
            hashes.append(tx.mix(tx.grams(w, m)[short] + U64(m)) if len(short) else np.zeros(0, np.uint64))
            docs.append(np.flatnonzero(words.count == m))
        h, doc = np.concatenate(hashes), np.concatenate(docs).astype(np.int64)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, self.doc = h[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))

    def digest(self, salt: np.uint64) -> np.ndarray:
        """A 64-bit hash of each non-empty set (0 for an empty one)."""
        out = np.zeros(len(self.n), np.uint64)
        if len(self.h):
            full = self.n > 0
            out[full] = tx.mix(np.add.reduceat(tx.mix(self.h ^ salt), self.first[:-1][full]) + self.n[full].astype(np.uint64))
        return out.view(np.int64)

    def sketch(self) -> np.ndarray:
        """512 parity bits per document, as 8 signed words."""
        bit = (tx.mix(self.h ^ _SALT[2]) & U64(SKETCH_BITS - 1)).astype(np.int64)
        odd = np.bincount(self.doc * SKETCH_BITS + bit, minlength=len(self.n) * SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(self.n), SKETCH_BITS // 64)

    def fine_sketches(self) -> list[bytes]:
        """Parity bits per document, 8 or more for each shingle; a power of two of them, so that halves fold by XOR."""
        out = []
        place = tx.mix(self.h ^ _SALT[2])
        for d, n in enumerate(self.n.tolist()):
            bits = max(SKETCH_BITS, 8 << (max(n, 1).bit_length() - 1))
            odd = np.bincount((place[self.first[d] : self.first[d + 1]] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
            out.append(np.packbits(odd.astype(np.uint8)).tobytes())
        return out

    def keys(self, common: np.ndarray | None = None, offer_all: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of the pigeonhole join; ``common``: sorted keys that come last in the order.

        ``offer_all``: every word of a set is a key, whatever the prefix."""
        low = np.int64(1) << np.int64(np.floor(np.log2(np.maximum(self.n, 1))))
        docs, keys = [], []
        for band, member in ((low, self.n > 0), (2 * low, (self.n > 0) & (100 * self.n >= LEVEL * 2 * low))):
            parts = -(-6 * band // 10) + 3
            own = member[self.doc]
            h, doc = self.h[own], self.doc[own]
            if not len(h):
                continue
            part = ((h >> U64(32)) * parts[doc].astype(np.uint64)) >> U64(32)
            start = np.ones(len(h), bool)
            start[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(start)
            word = np.bitwise_xor.reduceat(tx.mix(h ^ _SALT[3]), at)
            d, place = doc[at], tx.mix((band[doc[at]].astype(np.uint64) << U64(32)) ^ part[at])
            key = tx.mix(word ^ place)
            if offer_all:
                docs.append(d)
                keys.append(key)
                continue
            if common is not None and len(common):
                late = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
                key = key[np.argsort(2 * d + late, kind="stable")]  # d is in order and stays
            first = np.ones(len(at), bool)
            first[1:] = d[1:] != d[:-1]
            begin = np.flatnonzero(first)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            need = differing(self.n) + extra(self.n)
            offered = rank < need[d]
            docs.append(d[offered])
            keys.append(key[offered])
            filled = np.bincount(d, minlength=len(self.n))
            few = np.flatnonzero(member & (filled < need))
            docs.append(few)
            keys.append(tx.mix(band[few].astype(np.uint64) ^ _SALT[4]))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def differing(n: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of a set of n with one it links with, up to 1.25 n large."""
    return (n + 125 * n // 100) // 9


def extra(n):
    """Keys that a set of n shares at least with one it links with that is no smaller."""
    return n // 64 + 1


#: The keys of sets with fewer words than they would offer, one for each size band.
FEW_KEYS = tx.mix((U64(1) << np.arange(40, dtype=np.uint64)) ^ _SALT[4]).view(np.int64).tolist()
#: A key comes last if so many of a sixteenth of the texts have it; so many keys at most do.
COMMON_SHARE, COMMON_TEXTS, COMMON_KEYS = 16, 4, 100_000


_DOCS = pa.schema([
    ("_k1", pa.int64()), ("_k2", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("node2", pa.int64()),
    ("sketch", pa.list_(pa.int64())),
])
_DOCS_DDL = "_k1 long, _k2 long, doc_id long, n_shingles long, node long, node2 long, sketch array<long>"
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _parts(batch):
    data, offsets = tx.texts(batch.column("_text"))
    for i, j in tx.pieces(offsets):
        yield i, j, Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _describe(batches):
    for batch in batches:
        for i, j, s in _parts(batch):
            nodes = [pa.array(s.digest(salt), mask=s.n == 0) for salt in _SALT[:2]]
            keys = [batch.column(c).slice(i, j - i) for c in ("_k1", "_k2", "doc_id")]
            sketch = pa.array(list(s.sketch()), _DOCS.field("sketch").type)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(s.n), *nodes, sketch], schema=_DOCS)


def _emit_keys(batches, common: np.ndarray | None = None, offer_all: bool = False):
    seen: set[int] = set()  # nodes of this task: exact copies offer their keys once a task
    for batch in batches:
        for _, _, s in _parts(batch):
            nodes = s.digest(_SALT[0])
            new = np.zeros(len(nodes), bool)
            for d, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    new[d] = True
            doc, key = s.keys(common, offer_all)
            doc, key = doc[new[doc]], key[new[doc]]
            for lo in range(0, len(doc), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 65536]), pa.array(nodes[doc[lo : lo + 65536]])], schema=_KEYS)


def _compare(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            left, right = (Sets(*tx.texts(part.column(c))) for c in ("text_a", "text_b"))
            linked = []
            for d in range(part.num_rows):
                x, y = left.h[left.first[d] : left.first[d + 1]], right.h[right.first[d] : right.first[d + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= LEVEL * (len(x) + len(y) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], schema=schema)


def _fine(batches):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("fine", pa.binary())])
    for batch in batches:
        data, offsets = tx.texts(batch.column("text"))
        for i, j in tx.pieces(offsets):
            s = Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(s.n), pa.array(s.fine_sketches(), pa.binary())], schema=schema)


def _close(batches):
    """Pairs whose fine sketches differ in no more bits than linked sets can."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // 9
        close = []
        for x, y, limit in zip(batch.column("fine_a").to_pylist(), batch.column("fine_b").to_pylist(), most.tolist(), strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) != len(y):
                if len(x) < len(y):
                    x, y = y, x
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            close.append(int(np.bitwise_count(x ^ y).sum()) <= limit)
        mask = pa.array(close, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)


def extra_of(n: str) -> Column:
    """:func:`extra` of a column."""
    return F.floor(F.col(n) / 64) + 1


def _hopeful(n_a: str, n_b: str, s_a: str, s_b: str) -> Column:
    """Sizes and parity bits do not rule the pair out."""
    bits = sum(F.bit_count(F.col(s_a)[i].bitwiseXOR(F.col(s_b)[i])) for i in range(SKETCH_BITS // 64))
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return (100 * small >= LEVEL * large) & (9 * bits <= small + large)


def _common_keys(keyed: DataFrame) -> np.ndarray:
    """Sorted keys that many texts have, found in a sixteenth of them; they only set the order of the keys."""
    part = keyed.where(F.pmod(F.xxhash64("_text"), F.lit(COMMON_SHARE)) == 0)
    found = part.mapInArrow(lambda batches: _emit_keys(batches, offer_all=True), "key long, node long").distinct()
    many = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_TEXTS)
    rows = many.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _members(keyed: DataFrame) -> DataFrame:
    """(key, node) of keys with two nodes or more.

    One shuffle by key; the two windows share its sort and look one row back
    and ahead, so they hold no group in memory.
    """
    common = keyed.sparkSession.sparkContext.broadcast(_common_keys(keyed))
    rows = keyed.mapInArrow(lambda batches: _emit_keys(batches, common.value), "key long, node long")
    order = Window.partitionBy("key").orderBy("node")
    once = rows.withColumn("_last", F.lag("node").over(order)).where(F.col("_last").isNull() | (F.col("_last") != F.col("node"))).drop("_last")
    near = once.withColumns({"_prev": F.lag("node").over(order), "_next": F.lead("node").over(order)})
    return store(near.where(F.col("_prev").isNotNull() | F.col("_next").isNotNull()).select("key", "node"), "near-members")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its keys, doc_id, n_shingles, node (null for an empty set) and component_id."""
    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    described = store(keyed.mapInArrow(_describe, _DOCS_DDL), "near-documents")
    full = described.where(F.col("node").isNotNull())
    members = _members(keyed.select("_text"))
    nodes = full.groupBy("node").agg(
        F.min(F.struct("_k1", "_k2")).alias("_rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("s")
    )
    wanted = members.select("node").distinct()
    nodes = store(nodes.join(wanted, "node"), "near-nodes")
    texts = store(
        keyed.join(nodes.select("node", "_rep._k1", "_rep._k2"), ["_k1", "_k2"])
        .dropDuplicates(["_k1", "_k2"]).select("node", F.col("_text").alias("text")),
        "near-texts",
    )
    facts = nodes.select("node", "n", "s")

    fine = store(texts.mapInArrow(_fine, "node long, n long, fine binary"), "near-fine")

    def verified(pairs: DataFrame) -> DataFrame:
        fa, fb = (fine.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}")) for c in "ab")
        close = pairs.join(fa, "a").join(fb, "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(_close, "a long, b long")
        pairs = store(close, "near-close")
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return store(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long"), "near-links")

    # round one: every member against the member of its key that shares most keys
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("_shared"))
    central = members.join(shared, "node").groupBy("key").agg(F.max_by("node", F.struct("_shared", "node")).alias("a"))
    star = members.join(store(central, "near-central"), "key").where("a != node").select("a", F.col("node").alias("b")).distinct()
    fact = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"s_{c}"))
    star = star.join(fact("a"), "a").join(fact("b"), "b").where(_hopeful("n_a", "n_b", "s_a", "s_b")).select("a", "b")
    links = verified(star)
    comps = components(links)

    # round two: all pairs of a key that are still in different components
    labelled = members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    labelled = store(labelled, "near-labelled")
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("key")
    still = store(labelled.join(open_keys, "key").join(facts, "node"), "near-open")
    x = still.select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    y = still.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    pairs = x.join(y, "key").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _hopeful("n_a", "n_b", "s_a", "s_b"))
    weight = F.when(F.col("key").isin(FEW_KEYS), F.lit(1 << 40)).otherwise(F.lit(1).cast("long"))
    shares = pairs.groupBy("a", "b").agg(F.sum(weight).alias("_n"), F.first(F.least("n_a", "n_b")).alias("_least"))
    more = verified(shares.where(F.col("_n") >= extra_of("_least")).select("a", "b"))
    if not more.isEmpty():
        comps = components(links.unionByName(more))

    classes = full.join(comps, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    smallest = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_node = store(classes.select("node", "comp").distinct().join(smallest, "comp").select("node", "comp", "component_id"), "near-components")
    out = described.select("_k1", "_k2", "doc_id", "n_shingles", "node").join(by_node, "node", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (a null id comes last), then by hash.

    Rows without a shingle stay, but of rows repeated with the same id and text
    one stays.  Other columns are passed through, whatever their names.
    """
    placed, (own_id, own_text) = by_place(docs, id_col, text_col)
    found = link_components(placed.select(F.col(own_id).alias("doc_id"), F.col(own_text).alias("text")))
    member = found.where("node IS NOT NULL").select("comp", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2").alias("_m"))
    kept = member.groupBy("comp").agg(F.min("_m").alias("_keep"))
    go = member.join(kept, "comp").where(~F.col("_m").eqNullSafe(F.col("_keep"))).select("_m._k1", "_m._k2").distinct()
    marked = placed.select(F.struct(*placed.columns).alias("_row"), *row_key(F.col(own_id), F.col(own_text)))
    left = marked.join(go, ["_k1", "_k2"], "left_anti").dropDuplicates(["_k1", "_k2"])
    return left.select("_row.*").toDF(*docs.columns)
