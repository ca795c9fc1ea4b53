"""Text classifier training and model selection with Spark ML.

The classifier is a Spark ML pipeline (characters and character pairs, which fit texts with and without spaces between
words -> hashed term frequencies -> IDF -> a weighted multinomial classifier); fitting and scoring are
distributed Spark jobs. The default learner is multinomial Naive Bayes: one
aggregation pass over the training rows, so it scales linearly with the data.
Logistic regression (``algorithm="logistic"``) is available; it makes one
distributed pass per optimizer iteration.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tagwright import constants as K
from tagwright.functions.vectors import argmax, spread_probs
from tagwright.operators import balance as B, metrics as M


def text_classifier(text_col: str = "message", label_col: str = "class", weight_col: str | None = "weight",
                    reg_param: float = 1.0, num_features: int = 1 << 16, max_iter: int = 30,
                    algorithm: str = "naive_bayes") -> Pipeline:
    """``reg_param`` is the additive smoothing for Naive Bayes, the L2 penalty for logistic regression."""
    chars = RegexTokenizer(inputCol=text_col, outputCol="_chars", pattern=r"[\p{L}\p{N}]", gaps=False, toLowercase=True)
    pairs = NGram(inputCol="_chars", outputCol="_pairs", n=2)
    tok = SQLTransformer(statement="SELECT *, concat(_chars, _pairs) AS _tokens FROM __THIS__")
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    if algorithm == "naive_bayes":
        lr = NaiveBayes(featuresCol="_features", labelCol="_label", modelType="multinomial", smoothing=reg_param,
                        predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")
    else:
        lr = LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial",
                                regParam=reg_param, maxIter=max_iter, predictionCol="_pred", probabilityCol="_prob",
                                rawPredictionCol="_raw")
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[chars, pairs, tok, tf, idf, lr])


def train_text_classifier(train: DataFrame, text_col: str = "message", label_col: str = "class",
                          class_weighted: bool = True, **params) -> PipelineModel:
    """Fit the pipeline (U2); class weights are the inverse-frequency weights of A12."""
    d = train.withColumn("_label", F.col(label_col).cast("double"))
    if class_weighted:
        d = B.attach_class_weight(d, B.class_weights(train, label_col), label_col)
    stages = text_classifier(text_col, label_col, "weight" if class_weighted else None, **params).getStages()
    counts = _term_counts(d, stages).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf = stages[-2].fit(counts)
        return PipelineModel(stages=[*stages[:-2], idf, stages[-1].fit(idf.transform(counts))])
    finally:
        counts.unpersist()


def _term_counts(df: DataFrame, stages: list) -> DataFrame:
    """The rows' hashed term counts, without their texts: IDF and every learner pass over these, no text is cut twice."""
    return PipelineModel(stages=stages[:-2]).transform(df).drop("_chars", "_pairs", "_tokens", stages[0].getInputCol())


def score_classifier(model: PipelineModel, df: DataFrame, key: str = "custom_id", label_col: str = "class",
                     n_classes: int = K.NUM_CLASSES) -> DataFrame:
    """Class, probabilities and confidence per row, in one model pass."""
    s = model.transform(df.withColumn("_label", F.col(label_col).cast("double")))
    p = vector_to_array(F.col("_prob"))
    out = s.select(key, F.col(label_col).cast("int").alias("true_label"), p.alias("_p"))
    out = out.select(key, "true_label", argmax("_p").alias("predicted_label"), "_p")
    return out.select(key, "true_label", "predicted_label",
                      F.round(F.array_max("_p"), 6).alias("confidence"),
                      *[F.round(c, 6).alias(f"prob_class_{i}") for i, c in enumerate(spread_probs("_p", n_classes))])


class Selection(NamedTuple):
    table: DataFrame          # one row per candidate: reg_param, val_accuracy, val_f1, chosen
    model: PipelineModel      # the chosen candidate with its feature stages, ready to score, save and load


def select_best_model(train: DataFrame, validation: DataFrame, reg_params=(0.1, 0.5, 1.0),
                      label_col: str = "class", text_col: str = "message",
                      algorithm: str = "naive_bayes", **params) -> Selection:
    """Fit one learner per parameter value, score validation, keep the best weighted F1.

    The feature stages (tokens, hashed TF, IDF) do not depend on the
    candidate: they are fitted once and the featurised rows are cached while the
    candidates are fitted, one learner fit each. Ties: the earlier candidate.
    """
    stages = text_classifier(text_col, label_col, "weight", algorithm=algorithm, **params).getStages()
    tr = B.attach_class_weight(train.withColumn("_label", F.col(label_col).cast("double")),
                               B.class_weights(train, label_col), label_col)
    counts = [_term_counts(d, stages).persist(StorageLevel.MEMORY_AND_DISK)
              for d in (tr, validation.withColumn("_label", F.col(label_col).cast("double")))]
    try:
        idf = stages[-2].fit(counts[0])
        tr_f, va_f = (idf.transform(c) for c in counts)
        learner = stages[-1]
        param = learner.smoothing if algorithm == "naive_bayes" else learner.regParam
        models, scored = [], None
        for i, rp in enumerate(reg_params):
            models.append(learner.copy({param: float(rp)}).fit(tr_f))
            p = vector_to_array(F.col("_prob"))
            part = models[-1].transform(va_f).select(F.lit(i).alias("candidate"), F.lit(float(rp)).alias("reg_param"),
                                                     F.col("_label").cast("int").alias("true_label"),
                                                     argmax(p).alias("predicted_label"))
            scored = part if scored is None else scored.unionByName(part)
        # all candidates evaluated in one aggregate, grouped by candidate: one row each
        rows = M.weighted_prf(scored, by=["candidate", "reg_param"]).select(
            "candidate", "reg_param", F.col("accuracy").alias("val_accuracy"), F.col("f1").alias("val_f1")).collect()
    finally:
        for c in counts:
            c.unpersist()
    best = max(rows, key=lambda r: (r["val_f1"], -r["candidate"]))["candidate"] if rows else 0
    table = train.sparkSession.createDataFrame(
        [(r["candidate"], r["reg_param"], r["val_accuracy"], r["val_f1"], int(r["candidate"] == best)) for r in rows],
        "candidate int, reg_param double, val_accuracy double, val_f1 double, chosen int")
    return Selection(table, PipelineModel(stages=[*stages[:-2], idf, models[best]]))
