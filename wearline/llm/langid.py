"""Language identification of mixed-language text.

Words are runs of letters.  The script of a word (Unicode ranges) narrows the
candidate languages to those that write with it; each candidate scores the
word by its letters' 1-, 2- and 3-grams (hashed, add-one smoothed log
probabilities learned per language).  Viterbi over the words with a penalty
per switch labels spans; a document's language is that of most letters, its
score their share.

Viterbi runs word by word for all documents of a batch at once.  A document
whose best single language cannot be beaten by any excursion (the largest sum
of consecutive gains is at most the penalty) is settled exactly without it.

Learning: per language about ``per_language`` documents, picked by a hash of
the id; whole texts; the counts are aggregated by Spark and bounded by
languages x ``BUCKETS``.  Prediction covers every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without training rows everything is ``und``; words of a script that no learned
language uses carry no evidence (a text of such words alone takes the
lexically first language with score 0); ties go to the lexically first
language; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm import text as tx

BUCKETS = 1 << 17
UNDETERMINED = "und"
#: First code points of script ranges and their scripts, fixed by Unicode.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter, its lower case, its script."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x32000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            letter[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    starts = [s for s, _ in SCRIPTS] + [0x110000]
    script = np.zeros(0x110000, np.uint8)
    for (start, name), stop in zip(SCRIPTS, starts[1:], strict=True):
        script[start:stop] = _NAMES.index(name)
    return letter, lower, script


class LetterWords:
    """Words of some texts: per letter its three gram buckets, per word its first letter and script."""

    def __init__(self, texts: list[str | None]):
        letter, lower, script = _tables()
        texts = [t or "" for t in texts]
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        mask = letter[code]
        before = np.concatenate(([False], mask[:-1]))
        keep = np.flatnonzero(mask | before)  # each word and one place behind it
        seq = np.concatenate(([0], np.where(mask[keep], lower[code[keep]], 0))).astype(np.uint64)
        at = np.flatnonzero(seq)
        a, b, c = seq[at - 1], seq[at], seq[at + 1]
        low = np.uint64(BUCKETS - 1)
        self.grams = np.stack([
            tx.mix(b + np.uint64(1 << 60)) & low, tx.mix((a << np.uint64(21)) ^ b ^ np.uint64(1 << 61)) & low,
            tx.mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c) & low,
        ]).astype(np.int64)
        begins = seq[at - 1] == 0
        self.first = np.flatnonzero(begins)  # index of each word's first letter
        self.letters = np.diff(np.append(self.first, len(at)))
        self.script = script[b[begins].astype(np.int64)]
        start = np.flatnonzero(mask & ~before)
        self.doc = np.searchsorted(bounds, start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column("_text").filter(pa.array(langs == lang)).to_pylist()
            for lo in range(0, len(texts), 256):
                w = LetterWords(texts[lo : lo + 256])
                for kind, values in (("gram", w.grams.ravel()), ("script", np.repeat(w.script, w.letters).astype(np.int64))):
                    bucket, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n)), pa.array([kind] * len(n)), pa.array(bucket), pa.array(n.astype(np.int64))], schema=schema
                    )


class Model:
    """Log probabilities (bucket x language) and the scripts each language writes with."""

    def __init__(self, counts: list[tuple[str, str, int, int]], script_share: float = 0.01):
        self.langs = sorted({c[0] for c in counts})
        index = {lang: i for i, lang in enumerate(self.langs)}
        grams = np.zeros((BUCKETS, len(self.langs)))
        scripts = np.zeros((len(_NAMES), len(self.langs)))
        for lang, kind, bucket, n in counts:
            (grams if kind == "gram" else scripts)[bucket, index[lang]] += n
        # a half in place of one: the three orders share the table
        self.logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
        self.writes = scripts >= script_share * np.maximum(scripts.sum(0), 1)

    def scores(self, w: LetterWords) -> np.ndarray:
        """Log score of each word in each language, relative to the word's best candidate (so 0 or less)."""
        if not len(w.first):
            return np.zeros((0, len(self.langs)), np.float32)
        each = self.logp[w.grams[0]] + self.logp[w.grams[1]] + self.logp[w.grams[2]]
        s = np.add.reduceat(each, w.first, axis=0)
        allowed = self.writes[w.script]
        known = allowed.any(1)
        s = np.where(allowed | ~known[:, None], s, np.float32(-1e4))
        s -= s.max(1, keepdims=True)
        s[~known] = 0
        return s


def viterbi(s: np.ndarray, doc: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word: the best path of each document over ``s`` with ``penalty`` per switch."""
    labels = np.zeros(len(s), np.int64)
    if not len(s) or s.shape[1] == 1:
        return labels
    docs = len(count)
    first = np.concatenate(([0], np.cumsum(count)))
    has = count > 0
    totals = np.zeros((docs, s.shape[1]))
    totals[has] = np.add.reduceat(s.astype(np.float64), first[:-1][has], axis=0)
    single = totals.argmax(1)
    own = single[doc]
    others = s.copy()
    others[np.arange(len(s)), own] = -np.inf
    gain = others.max(1).astype(np.float64) - s[np.arange(len(s)), own]
    # largest sum of consecutive gains within a document; the drop keeps documents apart
    drop = np.zeros(len(s))
    starts = first[:-1][has]
    sums = np.cumsum(gain)
    base = np.concatenate(([0.0], sums))[starts]
    run = sums - np.repeat(base, count[has])
    drop = np.concatenate(([0.0], run[:-1]))
    drop[starts] = 0.0
    span = np.abs(run).max() + 1.0
    lift = np.repeat(np.arange(len(starts))[::-1] * 2.0 * span, count[has])
    lowest = np.minimum.accumulate(drop + lift) - lift
    excursion = np.zeros(docs)
    excursion[has] = np.maximum.reduceat(run - lowest, starts)
    labels[:] = own
    mixed = np.flatnonzero(has & (excursion > penalty))
    if len(mixed):
        mixed = mixed[np.argsort(-count[mixed], kind="stable")]
        _paths(s, labels, first[mixed], count[mixed], penalty)
    return labels


def _paths(s: np.ndarray, labels: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> None:
    """Word by word over the documents at ``first`` (longest first), then back along the choices."""
    longest, n = int(count[0]), len(count)
    active = np.searchsorted(-count, -np.arange(1, longest + 1), "right")  # documents with a word at each step
    value = np.zeros((n, s.shape[1]))
    stay, top = [], []
    for t in range(longest):
        k = active[t]
        v = value[:k]
        best = v.argmax(1)
        jump = v[np.arange(k), best] - penalty
        keep = v >= jump[:, None]
        stay.append(keep)
        top.append(best)
        value[:k] = np.where(keep, v, jump[:, None]) + s[first[:k] + t]
    at = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        labels[first[:k] + t] = at[:k]
        if t:
            here = at[:k]
            at[:k] = np.where(stay[t][np.arange(k), here], here, top[t])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> Model:
    """Learn from about ``per_language`` documents of each language, picked by a hash of the id."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text"),
        (F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_draw"),
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([])
    picked = F.lit(False)
    for lang, n in sorted(sizes.items()):
        picked = picked | ((F.col("lang") == lang) & (F.col("_draw") < min(1.0, per_language / n)))
    counts = rows.where(picked).select("lang", "_text").mapInArrow(_count, "lang string, kind string, bucket long, n long")
    found = counts.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).collect()
    return Model([tuple(r) for r in found])


def _identify(model: Model, penalty: float, with_spans: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", span)])
    names = np.array([*model.langs, UNDETERMINED], object)
    langs = max(1, len(model.langs))

    def label(ids: list, parts: list[tuple]):
        s = np.concatenate([p[0] for p in parts])
        count = np.concatenate([p[1] for p in parts])
        letters = np.concatenate([p[2] for p in parts])
        known = np.concatenate([p[3] for p in parts])
        doc = np.repeat(np.arange(len(count)), count)
        at = viterbi(s, doc, count, penalty)
        by_lang = np.bincount(doc * langs + at, letters * known, minlength=len(count) * langs).reshape(-1, langs)
        every = np.bincount(doc, letters, minlength=len(count))
        choice = by_lang.argmax(1)
        score = by_lang.max(1) / np.maximum(every, 1)
        choice[(every == 0)] = langs
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        spans = np.bincount(doc[begin], minlength=len(count))
        listed = None
        if with_spans:
            first = np.concatenate(([0], np.cumsum(count)))[doc[begin]]
            stop = np.append(begin[1:], len(at))
            flat = [{"start": int(a), "end": int(b), "lang": names[k]} for a, b, k in zip(begin - first, stop - first, at[begin], strict=True)]
            cuts = np.concatenate(([0], np.cumsum(spans))).tolist()
            listed = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(names[choice], pa.string()), pa.array(np.where(choice == langs, 0.0, score)),
            pa.array(spans.astype(np.int64)), pa.array(listed if with_spans else [None] * len(ids), span),
        ], schema=schema)

    def identify(batches):
        for batch in batches:
            if not model.langs:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([UNDETERMINED] * n), pa.array([0.0] * n), pa.array([0] * n, pa.int64()), pa.array([None] * n, span),
                ], schema=schema)
                continue
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()
            parts, lo, held = [], 0, 0
            i = begin = 0
            while i < len(texts):
                lo, size = i, 0
                while i < len(texts) and (i == lo or size < 1 << 20):
                    size += len(texts[i] or "")
                    i += 1
                w = LetterWords(texts[lo:i])
                parts.append((model.scores(w), w.count, w.letters.astype(np.float64), model.writes[w.script].any(1) if len(w.script) else np.zeros(0, bool)))
                held += size
                if held > 12 << 20 or i == len(texts):
                    yield label(ids[begin:i], parts)
                    parts, held, begin = [], 0, i

    return identify


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans, spans) of every row; spans are ranges of letter words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(
        _identify(model, penalty, with_spans),
        "doc_id long, lang_pred string, score double, n_spans long, spans array<struct<start:int,end:int,lang:string>>",
    )
