"""A quality score from a sparse ensemble of rules, learned from labels and compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.textstats import measure
from gaugemill.session import stage

#: Statistics of a text as the rules see them, from its measurements.
FEATURES: dict[str, str] = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

#: Labelled texts that the model is fitted on at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 20_000
#: The forest that proposes rules, and the weight of the lasso that picks among them.
TREES, DEPTH, SEED, LASSO = 24, 3, 17, 0.002


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """All its conditions at once."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as one column expression on the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of every text; those of a null or empty text are 0."""
    return measure(docs, keep, text_col).select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def tree_rules(node, path: tuple[Condition, ...] = ()) -> set[Rule]:
    """A rule for each path from the root to a node of a tree of Spark's."""
    found = {Rule(_merged(path))} if path else set()
    if node.subtreeDepth() > 0:
        split, names = node.split(), list(FEATURES)
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            found |= tree_rules(child, (*path, Condition(names[split.featureIndex()], above, float(split.threshold()))))
    return found


def _merged(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest condition for each feature and side, in a fixed order."""
    tightest: dict[tuple[str, bool], float] = {}
    for c in path:
        key = (c.feature, c.above)
        tightest[key] = c.threshold if key not in tightest else (max if c.above else min)(tightest[key], c.threshold)
    return tuple(Condition(f, a, t) for (f, a), t in sorted(tightest.items()))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        training_rows: int = TRAINING_ROWS) -> Ensemble:
    """Rules along the paths of a random forest, weighted by logistic regression under a lasso.

    Fitted on at most ``training_rows`` labelled texts: those of ``labels`` with the smallest hashes of their ids. Their
    list has that bound and is broadcast. Rows without a label are left out. Without rows of both labels the score is
    their share of label 1, or 0.5.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__gm_of"), F.col(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("__gm_of"), "__gm_of", "label").limit(training_rows)
    )
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__gm_of")).select("label", text_col)
    training = stage(statistics(texts, ["label"], text_col), "rule-training")
    rows, ones = training.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < rows:
        share = ones / rows if rows else 0.5
        return Ensemble(20.0 if share == 1 else -20.0 if share == 0 else 0.0, ())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(training)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird",
        subsamplingRate=0.5, minInstancesPerNode=5, maxBins=128, seed=SEED,
    ).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree._java_obj.rootNode())}, key=str)
    marked = training.select("label", F.array(*[F.when(r.column(), 1.0).otherwise(0.0) for r in rules]).alias("fired"))
    marked = stage(marked, "rule-fired")
    lasso = LogisticRegression(
        labelCol="label", featuresCol="fired_vector", elasticNetParam=1.0, regParam=LASSO, maxIter=100,
    ).fit(marked.withColumn("fired_vector", array_to_vector("fired")))
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score(docs: DataFrame, model: Ensemble, keep: list[str], text_col: str = "text", score_as: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every whole text, null and empty ones too. Repeated rows score alike."""
    return statistics(docs, keep, text_col).select(*keep, model.score().alias(score_as))
