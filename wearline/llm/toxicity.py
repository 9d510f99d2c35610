"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta[k+1] - w.x): one weight vector for all grades,
ascending thresholds between them.  Features are words and the 6-byte grams
inside words (A-Z folded, by 64-bit hash); a feature that occurs c times in n
words has the value log(1 + 1000 c / n).  The fit uses a bounded sample: about
``per_class`` labelled rows of each grade, picked by a hash of the id.  Spark
counts in how many toxic and clean sample texts each feature is; the features
that toxic texts hold significantly more often all enter the model, whatever
their number.  An L1 penalty picks among them.  Scoring covers every whole text.

Labels that only say toxic or not are refined into grades by quantiles of the
evidence (the features' lift times their value) among toxic texts.

Defined cases: a null or empty text has no feature and gets the expected
severity of an empty text; rows with a null label or id are not trained on; a
label table without both classes gives a model that scores every text 0; a
label of an unknown id is not used; an id with several labels takes the
largest; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm import text as tx
from wearline.llm.common import store

GRAM = 6
U64 = np.uint64


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature hash) of every occurrence, and the words of each document."""
    words = tx.Words(data, offsets, tx.WORD)
    values = tx._VALUES[True][data]
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        h = h * U64(tx._BASE) + values[j : j + len(h)]
    long = words.end - words.start >= GRAM
    size = (words.end - words.start - GRAM + 1)[long]
    at = np.arange(size.sum()) + np.repeat(words.start[long] - (np.cumsum(size) - size), size)
    return np.concatenate([words.doc, np.repeat(words.doc[long], size)]), np.concatenate([words.hashes(lower=True), tx.mix(h[at] + U64(GRAM))]), words.count


class Vocabulary:
    """Sorted feature hashes with a bit table in front, so that few occurrences need a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes & U64((1 << 20) - 1)).astype(np.int64)] = True

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature index, value) of the known features."""
        doc, h, words = occurrences(data, offsets)
        maybe = np.flatnonzero(self.table[(h & U64((1 << 20) - 1)).astype(np.int64)])
        h, doc = h[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1) if len(self.hashes) else np.zeros(0, np.int64)
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
        pair, count = np.unique(doc[known] * max(1, len(self.hashes)) + at[known], return_counts=True)
        doc, column = pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))
        return doc, column, np.log1p(1000.0 * count / words[doc])


class OrdinalModel:
    """A vocabulary, its shared weights and the thresholds."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(hashes)
        self.vocabulary, self.weights, self.thresholds = Vocabulary(hashes), weights[order], thresholds

    def linear(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, column, value = self.vocabulary.values(data, offsets)
        return np.bincount(doc, self.weights[column] * value, minlength=len(offsets) - 1)

    def grades(self, eta: np.ndarray) -> np.ndarray:
        """P(grade) per document: differences of the cumulative links."""
        if not len(self.thresholds):
            return np.ones((len(eta), 1))
        upto = _sigmoid(self.thresholds[None, :] - eta[:, None])
        return np.diff(np.concatenate([np.zeros((len(eta), 1)), upto, np.ones((len(eta), 1))], axis=1), axis=1)


def fit_ordinal(doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, l1: float, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient on the mean negative log likelihood."""
    n, top = len(grade), int(grade.max())
    weight = np.full(n, 1.0 / n)
    times = lambda w: np.bincount(doc, w[column] * value, minlength=n)
    back = lambda r: np.bincount(column, r[doc] * value, minlength=columns)
    u = np.ones(columns)
    for _ in range(15):  # largest curvature of the linear part
        u = back(weight * times(u))
        u /= np.linalg.norm(u) + 1e-12
    rate = 1.0 / (0.5 * float(np.linalg.norm(back(weight * times(u)))) + 1e-9)
    theta = np.linspace(0.5, 1.5, top) if top else np.zeros(0)
    w = ahead = np.zeros(columns)
    momentum = 1.0
    for _ in range(steps):
        eta = times(ahead)
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        upper = np.where(grade == top, 1.0, _sigmoid(np.where(grade == top, 0, edges[grade + 1]) - eta))
        lower = np.where(grade == 0, 0.0, _sigmoid(np.where(grade == 0, 0, edges[grade]) - eta))
        p = np.maximum(upper - lower, 1e-9)
        # slope of the log likelihood in eta: lower - (1 - upper)
        new = ahead - rate * back(weight * (1.0 - upper - lower))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        up, down = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        for k in range(top):
            pull = up[grade == k].sum() - down[grade == k + 1].sum()
            theta[k] += np.clip(2.0 * pull, -0.25, 0.25)
        for k in range(1, top):  # ascending, a little apart
            theta[k] = max(theta[k], theta[k - 1] + 0.05)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w, theta


def fit_relaxed(doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, relax: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Fit twice: the penalty picks the words, then those alone are fitted with ``relax`` of it, without its shrinkage.

    Columns are scaled to a root mean square of one.  The penalty is the
    universal threshold: what the largest of ``columns`` chance words reaches.
    """
    n, share = len(grade), float((grade > 0).mean())
    scale = np.sqrt(np.bincount(column, value**2, minlength=columns) / n)
    scale[scale == 0] = 1.0
    scaled = value / scale[column]
    l1 = np.sqrt(share * (1 - share)) * np.sqrt(2 * np.log(max(2, columns)) / n)
    w, theta = fit_ordinal(doc, column, scaled, grade, columns, l1)
    used = w != 0
    own = used[column]
    if own.any():
        w = np.zeros(columns)
        w[used], theta = fit_ordinal(doc[own], (np.cumsum(used) - 1)[column[own]], scaled[own], grade, int(used.sum()), l1 * relax, steps=600)
    return w / scale, theta


def refine_grades(evidence: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean documents, 1 to ``grades`` - 1 for toxic ones by quantiles of their evidence."""
    cuts = np.quantile(evidence[toxic], np.arange(1, grades - 1) / (grades - 1)) if grades > 2 else np.zeros(0)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, evidence, "left"), 0)
    return np.unique(grade, return_inverse=True)[1]  # ties may leave a grade out


def select_features(sample: DataFrame, sizes: dict[bool, int], min_z: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lifts) of all features that toxic texts hold significantly more often.

    The test is the signed root of the likelihood ratio of the two-by-two
    table, which holds for rare features too: no count is too small to enter.
    The number of features is bounded by the texts of the sample.
    """
    counts = sample.mapInArrow(_document_frequencies, "h long, bad long, good long").groupBy("h").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    toxic, clean = float(sizes[True]), float(sizes[False])
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    with_it, every = bad + good, F.lit(toxic + clean)
    without = every - with_it
    ratio = 2 * (
        part(bad, with_it * toxic / every) + part(good, with_it * clean / every)
        + part(toxic - bad, without * toxic / every) + part(clean - good, without * clean / every)
    )
    z = F.sqrt(F.greatest(ratio, F.lit(0.0)))
    lift = F.log((bad + 0.5) / (toxic + 1)) - F.log((good + 0.5) / (clean + 1))
    rows = counts.where((bad * clean > good * toxic) & (z >= min_z)).select("h", lift.alias("lift")).orderBy("h").collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["lift"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          grades: int = 4, per_class: int = 4000, min_z: float = 4.0) -> OrdinalModel:
    """Fit on about ``per_class`` distinct texts of each label; a label column with values above 1 is taken as grades."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("_label")
    )
    sizes = {r["_label"]: r["n"] for r in own.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if len(sizes) < 2 or min(sizes) != 0:
        return empty
    draw = F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = F.lit(False)
    for label, n in sizes.items():
        picked = picked | ((F.col("_label") == label) & (draw < min(1.0, per_class / n)))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # bounded by per_class rows a label; equal texts of a label count once
    sample = texts.join(F.broadcast(own.where(picked)), "_id").select("_label", "_text").dropDuplicates()
    sample = store(sample, "toxicity-sample")
    held = {r["bad"]: r["n"] for r in sample.groupBy((F.col("_label") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        return empty
    hashes, lifts = select_features(sample, held, min_z)
    order = np.argsort(hashes)
    vocabulary, lifts = Vocabulary(hashes), lifts[order]
    rows = sample.mapInArrow(_sample_values(vocabulary), "label int, columns array<long>, values array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["columns"], r["values"]))
    label = np.array([r["label"] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["columns"]) for r in rows])
    column = np.array([c for r in rows for c in r["columns"]], np.int64)
    value = np.array([v for r in rows for v in r["values"]], float)
    if label.max() == 1:
        label = refine_grades(np.bincount(doc, lifts[column] * value, minlength=len(rows)), label == 1, grades)
    weights, thresholds = fit_relaxed(doc, column, value, label, len(hashes))
    used = weights != 0
    return OrdinalModel(vocabulary.hashes[used], weights[used], thresholds)


def _document_frequencies(batches):
    schema = pa.schema([("h", pa.int64()), ("bad", pa.int64()), ("good", pa.int64())])
    for batch in batches:
        data, offsets = tx.texts(batch.column("_text"))
        label = batch.column("_label").to_numpy(zero_copy_only=False)
        for i, j in tx.pieces(offsets):
            doc, h, _ = occurrences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            feature, at = np.unique(h, return_inverse=True)
            pair = np.unique(doc * len(feature) + at) if len(feature) else np.zeros(0, np.int64)
            bad = label[i:j][pair // max(1, len(feature))] > 0
            at = pair % max(1, len(feature))
            n = len(feature)
            yield pa.RecordBatch.from_arrays([
                pa.array(feature.view(np.int64)), pa.array(np.bincount(at[bad], minlength=n)), pa.array(np.bincount(at[~bad], minlength=n)),
            ], schema=schema)


def _sample_values(vocabulary: Vocabulary):
    schema = pa.schema([("label", pa.int32()), ("columns", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def values(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            for i, j in tx.pieces(offsets):
                doc, column, value = vocabulary.values(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cuts = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_label").slice(i, j - i), pa.ListArray.from_arrays(cuts, pa.array(column)), pa.ListArray.from_arrays(cuts, pa.array(value)),
                ], schema=schema)

    return values


def _score(model: OrdinalModel):
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.int32()), ("expected_severity", pa.float64()), ("toxic_probability", pa.float64()), ("toxic", pa.bool_())])

    def score(batches):
        for batch in batches:
            data, offsets = tx.texts(batch.column("_text"))
            for i, j in tx.pieces(offsets):
                p = model.grades(model.linear(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                expected = p @ np.arange(p.shape[1])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(p.argmax(1).astype(np.int32)), pa.array(expected),
                    pa.array(1.0 - p[:, 0]), pa.array(p[:, 0] < 0.5),
                ], schema=schema)

    return score


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, expected_severity, toxic_probability, toxic) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_score(model), "doc_id long, severity int, expected_severity double, toxic_probability double, toxic boolean")
