"""TF-IDF features, balanced logistic regression and scoring on Spark ML."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gaugemill.functions.text import TOKEN, negation_prefix, perturb
from gaugemill.operators import evaluation, logistic, termcounts
from gaugemill.settings import (
    MAX_FEATURES,
    MIN_TRAINING_ROWS,
    NEGATION_CONFIDENCE,
    NEGATION_SAMPLE_SIZE,
    NEGATIVE_RATING_CEILING,
    POSITIVE_RATING_FLOOR,
    RANDOM_SEED,
)


class TooFewRows(RuntimeError):
    """The labelled training set is below the configured minimum."""


@dataclass(frozen=True)
class TrainingConfig:
    C: float = 1.0
    ngram_max: int = 2
    min_df: int = 5
    positive_rating_floor: int = POSITIVE_RATING_FLOOR
    negative_rating_ceiling: int = NEGATIVE_RATING_CEILING
    random_seed: int = RANDOM_SEED

    def params(self) -> dict[str, object]:
        return asdict(self)


def words(text: Column) -> Column:
    """Lower-cased word tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def ngrams(tokens: Column, ngram_max: int) -> Column:
    """Word 1- to n-grams: each longer list pairs the one before with the tokens shifted on."""
    lists = [tokens]
    for n in range(2, ngram_max + 1):
        shifted = F.slice(tokens, F.lit(n), F.size(tokens))
        pairs = F.zip_with(lists[-1], shifted, lambda head, word: F.concat(head, F.lit(" "), word))
        lists.append(F.array_compact(pairs))
    return F.flatten(F.array(*lists))


def vocabulary(
    df: DataFrame, text: str, ngram_max: int = 2, min_df: int = 5, max_features: int = MAX_FEATURES
) -> DataFrame:
    """Top terms by corpus frequency among those in at least ``min_df`` documents, with idf.

    A row is a document, so its distinct terms are found inside the row. Tasks count the terms of about two million
    words at a time; only these totals are shuffled, never (document, term) pairs.
    """
    tokens = df.select(words(F.col(text)).alias("_words"))
    return _top_terms(tokens, ngram_max, df.agg(F.count("*")).scalar(), min_df, max_features)


def _top_terms(tokens: DataFrame, ngram_max: int, total: Column, min_df: int, max_features: int) -> DataFrame:
    """The vocabulary of documents whose words are in the column ``_words``; ``total`` is their number."""

    def run(batches):
        for batch in batches:
            for _, found, row in termcounts.steps(batch, "_words"):
                yield from termcounts.counted(found, row, ngram_max)

    return (
        tokens.select("_words").mapInArrow(run, "term string, df bigint, tf bigint").groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("tf").alias("corpus_tf"))
        .where(F.col("df") >= min_df)
        .orderBy(F.desc("corpus_tf"), "term")
        .limit(max_features)
        .withColumn("idf", F.ln((total + 1) / (F.col("df") + 1)) + 1)
    )


def tfidf_weights(
    df: DataFrame, doc: str, text: str, ngram_max: int = 2, min_df: int = 5, max_features: int = MAX_FEATURES
) -> DataFrame:
    """L2-normalized weight of every vocabulary term in every document.

    The vocabulary is limited to ``max_features`` rows, which is all the driver receives. A document is one row:
    its terms are counted, weighted and normalized inside it, so nothing is shuffled once the vocabulary is known.
    """
    known = vocabulary(df, text, ngram_max, min_df, max_features).select("term", "idf").collect()  # max_features rows
    if not known:
        return df.select(doc, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    shared = df.sparkSession.sparkContext.broadcast((termcounts.Terms([r["term"] for r in known]), np.array([r["idf"] for r in known])))

    def run(batches):
        terms, idf = shared.value
        for batch in batches:
            for part, found, row in termcounts.steps(batch, "_words"):
                rows, at, weight = termcounts.weighted(*terms.found(found, row), idf)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(at, pa.int32()), pa.array(weight)], names=["_doc", "_at", "weight"])

    tokens = df.select(F.col(doc).alias("_doc"), words(F.col(text)).alias("_words"))
    shape = StructType([StructField("_doc", tokens.schema["_doc"].dataType), StructField("_at", IntegerType()), StructField("weight", DoubleType())])
    names = df.sparkSession.createDataFrame([(i, r["term"]) for i, r in enumerate(known)], "_at int, term string")
    return tokens.mapInArrow(run, shape).join(F.broadcast(names), "_at").select(F.col("_doc").alias(doc), "term", "weight")


def fit(config: TrainingConfig, rows: DataFrame, text: str = "review_text", label: str = "sentiment",
        min_rows: int = MIN_TRAINING_ROWS, max_features: int = MAX_FEATURES) -> PipelineModel:
    """TF-IDF with unit-norm rows, then class-balanced L2 logistic regression.

    Spark averages the weighted loss, so the inverse strength C becomes
    regParam = 1 / (C * sum of weights), and balanced weights sum to the row count.
    """
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # one row per class
    total = sum(sizes.values())
    if total < min_rows:
        raise TooFewRows(f"Training data has {total} rows, below the configured minimum of {min_rows}.")

    tokenizer = RegexTokenizer(inputCol=text, outputCol="_terms1", pattern=TOKEN, gaps=False, toLowercase=True)
    longer = [
        NGram(n=n, inputCol="_terms1", outputCol=f"_terms{n}") for n in range(2, config.ngram_max + 1)
    ]
    pieces = ", ".join(f"_terms{n}" for n in range(1, config.ngram_max + 1))
    merged = SQLTransformer(statement=f"SELECT *, concat({pieces}) AS _terms FROM __THIS__")
    prepared = rows.select(text, label)
    for stage in (tokenizer, *longer, merged):
        prepared = stage.transform(prepared)
    tokens, prepared = prepared.select(F.col("_terms1").alias("_words")), prepared.select("_terms", label)

    known = _top_terms(tokens, config.ngram_max, F.lit(total), config.min_df, max_features)
    known = known.select("term", "idf").repartition(1).collect()  # max_features rows, cut by the tasks
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in known], "_terms", "_counts")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_features")

    balanced = F.lit(None).cast("double")
    for value, size in sizes.items():
        balanced = F.when(F.col(label) == value, total / (len(sizes) * size)).otherwise(balanced)
    features = unit.transform(scale.transform(counter.transform(prepared))).select(
        "_features", F.col(label).cast("double").alias(label), balanced.alias("_weight")
    )
    columns = dict(featuresCol="_features", predictionCol="prediction", probabilityCol="_probability", rawPredictionCol="_margin")
    penalty = 1.0 / (config.C * total)
    if sizes.keys() == {0, 1}:
        coefficients, intercept = logistic.fit(features, len(known), penalty, "_features", label, "_weight")
        fitted = LogisticRegressionModel._create_from_java_class(
            "org.apache.spark.ml.classification.LogisticRegressionModel", LogisticRegression().uid, Vectors.dense(coefficients), intercept
        )._set(**columns, labelCol=label, weightCol="_weight")
    else:  # one class, or more than two
        fitted = LogisticRegression(
            **columns, labelCol=label, weightCol="_weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=1000
        ).fit(features)
    return PipelineModel([tokenizer, *longer, merged, counter, scale, unit, fitted])


def predict(model: PipelineModel, rows: DataFrame, prediction: str = "prediction", probabilities: str = "probabilities") -> DataFrame:
    """Rows with the predicted class and the per-class probability array."""
    scored = model.transform(rows)
    return scored.select(
        *rows.columns,
        F.col("prediction").cast("int").alias(prediction),
        vector_to_array("_probability").alias(probabilities),
    )


def confident_sample(
    scored: DataFrame, order: str, probabilities: str = "probabilities",
    above: float = NEGATION_CONFIDENCE, size: int = NEGATION_SAMPLE_SIZE,
) -> DataFrame:
    """First ``size`` rows whose top probability exceeds ``above``."""
    return scored.where(F.array_max(probabilities) > above).orderBy(order).limit(size)


def negation_check(model: PipelineModel, scored: DataFrame, order: str, text: str = "review_text",
                   above: float = NEGATION_CONFIDENCE, size: int = NEGATION_SAMPLE_SIZE) -> DataFrame:
    """Probability drop of the predicted class on the confident sample after a negation prefix.

    The sample is at most ``size`` rows, so numbering it in one task is fine.
    """
    sample = confident_sample(scored, order, "probabilities", above, size)
    numbered = sample.select(
        order, text, "prediction", F.col("probabilities").alias("before"),
        (F.expr(f"row_number() over (order by {order})") - 1).alias("position"),
    )
    renamed = numbered.withColumn(text, negation_prefix(F.col(text), F.col("position"))).withColumnRenamed(
        "prediction", "predicted"
    )
    after = predict(model, renamed, "new_prediction", "after")
    return evaluation.negation_shift(after, "before", "after", "predicted").withColumn(
        "complete", F.col("n") >= size
    )


def invariance_agreement(model: PipelineModel, scored: DataFrame, row_id: str, text: str = "review_text",
                         transforms=("whitespace", "trailing_period", "lowercase", "char_swap")) -> DataFrame:
    """Share of equal predictions per benign rewrite; all rewrites are scored in one job."""
    variants = [
        F.struct(F.lit(how).alias("transform"), perturb(F.col(text), how, F.col(row_id)).alias("_rewritten"))
        for how in transforms
    ]
    rewritten = scored.select(
        row_id, F.col("prediction").alias("before"), F.inline(F.array(*variants))
    ).withColumnRenamed("_rewritten", text)
    return evaluation.agreement(predict(model, rewritten, "after", "_p"), "before", "after", ["transform"])


def champion_score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Label and its probability for every text, on a batch or a stream."""
    scored = predict(model, rows, "label", "_p")
    return scored.select(*rows.columns, "label", F.element_at("_p", F.col("label") + 1).alias("prob"))
