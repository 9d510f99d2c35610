"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Statistics are column expressions.  A random forest of shallow trees over them
is fitted to a bounded sample of the labelled rows; every path from a root to a
node is a rule, a conjunction of thresholds.  A lasso logistic regression over
the rules leaves few of them with a weight.  Those are compiled into one column
expression, so scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import store

#: Most labelled rows fitted to, those with the smallest hash of their id.
MAX_TRAIN = 20_000
TREES, DEPTH = 60, 3
#: Weight of the lasso penalty.
PENALTY = 0.002

_SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; a null text counts as empty, ratios of an empty text are 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.length(text)
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def share(characters: str) -> Column:
        return ratio(size - F.length(F.translate(text, characters, "")), size)

    return {
        "log_chars": F.log1p(size.cast("double")),
        "symbol_share": share("#*$%&|<>{}[]\\^~=_+@"),
        "shout_share": share("!?"),
        "stop_share": share(".,;:"),
        "upper_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digit_share": share("0123456789"),
        "space_share": share(" \t\r"),
        "break_share": share("\n"),
        "wide_share": ratio(F.octet_length(text) - size, size),
        "words": F.size(words).cast("double"),
        "word_chars": ratio(size, F.size(words)),
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_chars": ratio(size, F.size(lines)),
    }


NAMES = (
    "log_chars", "symbol_share", "shout_share", "stop_share", "upper_share", "digit_share", "space_share", "break_share",
    "wide_share", "words", "word_chars", "distinct_words", "distinct_lines", "line_chars",
)

#: One threshold of a rule: statistic, whether above it, the threshold.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def _holds(rule: Rule, stats: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [stats[name] > at if above else stats[name] <= at for name, above, at in rule])


def _simplified(rule: list[Condition]) -> Rule:
    """The tightest threshold per statistic and side, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in rule:
        known = best.get((name, above))
        best[name, above] = at if known is None else (max if above else min)(known, at)
    return tuple((name, above, at) for (name, above), at in sorted(best.items()))


def _paths(node, path: list[Condition]) -> list[Rule]:
    """Rules of all nodes below ``node``; a sibling's rule is the complement on the root's level and is left out."""
    if node.subtreeDepth() == 0:
        return []
    name, at = NAMES[node.split().featureIndex()], float(node.split().threshold())
    out = []
    for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
        here = [*path, (name, above, at)]
        if path or not above:
            out.append(_simplified(here))
        out += _paths(child, here)
    return out


@dataclass(frozen=True)
class RuleModel:
    """``rules`` with a weight each, and an ``intercept``; no rules where no labels of both kinds were given."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def probability(self, stats: dict[str, Column]) -> Column:
        """Share of label 1 expected, as one column expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, the heaviest first."""
        def words(rule: Rule) -> str:
            return " and ".join(f"{name} {'>' if above else '<='} {at:.6g}" for name, above, at in rule)

        return [f"{weight:+.3f} if {words(rule)}" for rule, weight in sorted(self.rules, key=lambda r: (-abs(r[1]), r[0]))]


def _with_statistics(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and a struct of the statistics as ``_s``: other columns, whatever their names, are left behind."""
    made = statistics(F.col("text"))
    return rows.select(*keep, F.struct(*[made[n].cast("double").alias(n) for n in NAMES]).alias("_s"))


def _fields() -> dict[str, Column]:
    return {n: F.col(f"_s.{n}") for n in NAMES}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN, trees: int = TREES,
          depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fit to ``labels`` (doc_id, ``label`` 0 or 1) and the texts of ``docs``.

    At most ``most`` labelled rows are used.  Rows without an id or a label are
    no labels.  A document given several texts is taken with the smallest
    statistics, a label given twice counts twice.  With labels of one kind, or
    none, the model has no rule and gives that kind, or one half.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(
        F.col("_id").isNotNull() & F.col("label").isin(0, 1))
    sample = store(known.orderBy(F.xxhash64("_id"), "_id", "label").limit(most), "rules-sample")
    wanted = docs.join(F.broadcast(sample.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    texts = _with_statistics(wanted, "doc_id").groupBy("doc_id").agg(F.min("_s").alias("_s"))
    rows = sample.join(texts, F.col("_id") == F.col("doc_id")).select("label", "doc_id", "_s")
    # bounded by ``most``: one partition in a fixed order, so that the fit does not depend on the cluster
    rows = store(rows.repartition(1).sortWithinPartitions("doc_id", "label"), "rules-train").coalesce(1)
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        return RuleModel((), 0.0 if not n else (30.0 if ones else -30.0))

    data = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows.select(F.col("label").cast("double"), "_s.*"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, seed=13).fit(data)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), [])})
    fired = array_to_vector(F.array(*[_holds(r, _fields()).cast("double") for r in rules]))
    design = store(rows.select(F.col("label").cast("double").alias("label"), fired.alias("features")), "rules-design").coalesce(1)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=200, tol=1e-7, standardization=True).fit(design)
    weights = lasso.coefficients.toArray()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score, n_rules) of every row; ``n_rules``: weighted rules that hold.

    Null and empty texts have all statistics 0 and are scored like others;
    equal texts score equal.
    """
    rows = _with_statistics(docs, "doc_id")
    held = [_holds(rule, _fields()).cast("int") for rule, _ in model.rules]
    return rows.select("doc_id", model.probability(_fields()).alias("score"), reduce(lambda a, b: a + b, held, F.lit(0)).alias("n_rules"))
