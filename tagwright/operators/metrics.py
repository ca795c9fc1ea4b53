"""Evaluation tables.

Everything starts from one ``groupBy(true, pred).count()`` (partially
aggregated map-side, so a hot class never sits whole in one task); the
report, accuracies and error tables are arithmetic on those <= K*K rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwright import constants as K

T, P = "true_label", "predicted_label"


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Several one-row aggregates (distinct column names) as one row, without a join:
    union with null-padded columns, then one aggregate."""
    types = {f.name: f.dataType for d in one_row for f in d.schema.fields}
    cols = list(types)
    parts = [d.select(*[F.col(c) if c in d.columns else F.lit(None).cast(types[c]).alias(c) for c in cols])
             for d in one_row]
    u = parts[0]
    for d in parts[1:]:
        u = u.unionByName(d)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def class_spine(spark, n: int = K.NUM_CLASSES, name: str = "label") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def cell_spine(spark, n: int = K.NUM_CLASSES) -> DataFrame:
    """All n*n (true, predicted) cells, built from one range (no product)."""
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias(T), (F.col("id") % n).cast("int").alias(P))


def label_name(c) -> Column:
    """Name of a class id; an id outside the known classes is ``class <id>``, null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    names = F.array(*[F.lit(n) for n in K.CLASS_NAMES])
    return F.when(col.between(0, K.NUM_CLASSES - 1), F.element_at(names, (col + 1).cast("int"))).otherwise(
        F.concat(F.lit("class "), col.cast("string")))


def flag_correct(df: DataFrame, true: str = T, pred: str = P, name: str = "correct") -> DataFrame:
    """1 if prediction equals label else 0 (P10)."""
    return df.withColumn(name, (F.col(pred) == F.col(true)).cast("int"))


def with_label_names(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Class id -> name for both label columns."""
    return df.withColumn(f"{true}_name", label_name(true)).withColumn(f"{pred}_name", label_name(pred))


def valid_predictions(df: DataFrame, pred: str = P) -> DataFrame:
    """Rows with a usable prediction (P13); metrics are over these only."""
    return df.where(F.col(pred) != K.UNLABELED)


def confusion(df: DataFrame, true: str = T, pred: str = P, by=()) -> DataFrame:
    """Long confusion counts ``(*by, true_label, predicted_label, n)`` over observed cells.

    ``by`` evaluates several slices or models in the same pass (one aggregate).
    """
    return df.groupBy(*by, F.col(true).cast("int").alias(T), F.col(pred).cast("int").alias(P)) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Confusion counts over the K x K grid (zeros included) and every other cell that was observed.

    The counts add up to all rows, labels outside 0..K-1 and null ones included.
    """
    return matrix_of(confusion(df, true, pred))


def matrix_of(conf: DataFrame) -> DataFrame:
    """``confusion_matrix`` from confusion counts."""
    zeros = cell_spine(conf.sparkSession).withColumn("n", F.lit(0).cast("bigint"))
    return conf.unionByName(zeros).groupBy(T, P).agg(F.sum("n").alias("n"))


def confusion_pivot(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """The matrix: one row per true label (0..K-1 and others observed), a column per class and one for other predictions."""
    return pivot_of(confusion(df, true, pred))


def pivot_of(conf: DataFrame) -> DataFrame:
    """``confusion_pivot`` from confusion counts."""
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")
    inside = F.coalesce(F.col(P).between(0, K.NUM_CLASSES - 1), F.lit(False))
    return matrix_of(conf).groupBy(T).agg(
        *[n(F.col(P) == j).alias(f"pred_{j}") for j in range(K.NUM_CLASSES)], n(~inside).alias("pred_other"))


def per_class(conf: DataFrame, by=()) -> DataFrame:
    """(*by, label, tp, support, predicted) from confusion counts, for 0..K-1 and every other observed label.

    One aggregate over exploded entries: the spine's zeros travel with the counts, so nothing is joined.
    """
    by = list(by)
    entry = lambda label, kind, n: F.struct(label.cast("int").alias("label"), F.lit(kind).alias("k"), n.cast("bigint").alias("n"))
    zeros = [entry(F.lit(c), 0, F.lit(0)) for c in range(K.NUM_CLASSES)]
    hit = F.when(F.col(T) == F.col(P), F.col("n")).otherwise(F.lit(0))
    own = [entry(F.col(T), 0, F.col("n")), entry(F.col(P), 1, F.col("n")), entry(F.col(T), 2, hit)]
    parts = conf.select(*by, F.explode(F.array(*own, *zeros)).alias("x"))
    if not by:  # the spine also for no rows at all
        parts = parts.unionByName(conf.sparkSession.range(1).select(F.explode(F.array(*zeros)).alias("x")))
    total = lambda kind: F.sum(F.when(F.col("x.k") == kind, F.col("x.n")).otherwise(0)).cast("bigint")
    return parts.groupBy(*by, F.col("x.label").alias("label")).agg(
        total(2).alias("tp"), total(0).alias("support"), total(1).alias("predicted"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b is 0 (sklearn's zero_division behaviour)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(pc: DataFrame) -> DataFrame:
    p = safe_ratio(F.col("tp"), F.col("predicted"))
    r = safe_ratio(F.col("tp"), F.col("support"))
    return (pc.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def _averages() -> list[Column]:
    tot = F.sum("support")
    weighted = lambda c: safe_ratio(F.sum(F.col(c) * F.col("support")), tot)
    return [tot.alias("n"), safe_ratio(F.sum("tp"), tot).alias("accuracy"),
            *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
            *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]]


def classification_report(df: DataFrame, true: str = T, pred: str = P, by=()) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro avg, weighted avg.

    Long table ``(*by, row_kind, label, precision, recall, f1, support)``; the
    accuracy row carries accuracy in ``f1`` like the printed report. One
    aggregate per group of class rows emits all of its rows.
    """
    return report_of(confusion(df, true, pred, by), by)


def report_of(conf: DataFrame, by=()) -> DataFrame:
    """``classification_report`` from confusion counts."""
    by = list(by)
    prf = _prf(per_class(conf, by))
    none, nolabel = F.lit(None).cast("double"), F.lit(None).cast("int")
    row = lambda kind, label, p, r, f, n: F.struct(
        F.lit(kind).alias("row_kind"), label.alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support"))
    classes = F.collect_list(row("class", F.col("label"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support")))
    groups = prf.groupBy(*by).agg(classes.alias("_classes"), *_averages())
    summary = F.array(
        row("accuracy", nolabel, none, none, F.col("accuracy"), F.col("n")),
        *[row(f"{k} avg", nolabel, *[F.col(f"{k}_{c}") for c in ("precision", "recall", "f1")], F.col("n")) for k in ("macro", "weighted")])
    return groups.select(*by, F.explode(F.concat("_classes", summary)).alias("_r")).select(*by, "_r.*")


def weighted_prf(df: DataFrame, true: str = T, pred: str = P, by=()) -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1, one row per group."""
    by = list(by)
    prf = _prf(per_class(confusion(df, true, pred, by), by))
    return prf.groupBy(*by).agg(*_averages()).select(
        *by, "accuracy", *[F.col(f"weighted_{c}").alias(c) for c in ("precision", "recall", "f1")])


def accuracy(df: DataFrame, true: str = T, pred: str = P, by=()) -> DataFrame:
    """``sum(correct) / n``, one row per group (A5)."""
    correct = F.sum((F.col(true) == F.col(pred)).cast("int"))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), correct.cast("bigint").alias("correct"),
                               safe_ratio(correct, n).alias("accuracy"))


def class_accuracy(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Accuracy inside each true class (= recall), 0 for an empty class."""
    pc = per_class(confusion(df, true, pred))
    return pc.select(F.col("label").alias(T), F.col("support").alias("samples"), F.col("tp").alias("correct"),
                     safe_ratio(F.col("tp"), F.col("support")).alias("accuracy"))


def error_by_class(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Samples, errors and error rate per true class, on the class spine."""
    pc = per_class(confusion(df, true, pred))
    errors = F.col("support") - F.col("tp")
    return pc.select(F.col("label").alias(T), F.col("support").alias("samples"), errors.alias("errors"),
                     safe_ratio(errors, F.col("support")).alias("error_rate"))


def error_transitions(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Wrong rows by ``true -> predicted`` names with share of all errors, most frequent first."""
    return transitions_of(confusion(df, true, pred))


def transitions_of(conf: DataFrame) -> DataFrame:
    """``error_transitions`` from confusion counts."""
    wrong = conf.where(F.col(T) != F.col(P))
    # total over <= K*K aggregated cells: a window over the whole (tiny) table
    out = (wrong.withColumn("total_errors", F.sum("n").over(Window.partitionBy()))
           .select(T, P, label_name(T).alias("true_name"), label_name(P).alias("predicted_name"),
                   F.concat_ws(" -> ", label_name(T), label_name(P)).alias("transition"),
                   F.col("n"), safe_ratio(F.col("n") * 100, F.col("total_errors")).alias("pct_of_errors")))
    return out.orderBy(F.desc("n"), T, P)


def error_summary(df: DataFrame, true: str = T, pred: str = P) -> DataFrame:
    """Total errors and their share of the set."""
    errors = F.count_if(F.col(true) != F.col(pred))
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), errors.alias("errors"), safe_ratio(errors * 100, n).alias("pct_of_set"))


def valid_rate(df: DataFrame, pred: str = P) -> DataFrame:
    """Valid predictions and their percent of all rows."""
    valid = F.count_if(F.col(pred) != K.UNLABELED)
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), valid.alias("valid"), safe_ratio(valid * 100, n).alias("valid_pct"))


def high_confidence_mistakes(df: DataFrame, k: int = K.TOP_MISTAKES, true: str = T, pred: str = P,
                             conf: str = "confidence", key: str = "custom_id") -> DataFrame:
    """Wrong rows with the highest confidence first, top k (T1); ties broken by key.

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own top k, only k rows per task reach the final merge.
    """
    return df.where(F.col(true) != F.col(pred)).orderBy(F.desc(conf), F.col(key)).limit(k)


def class_distribution(df: DataFrame, label: str = "class", label_type: str = "int") -> DataFrame:
    """Count and percent per class, ordered by class id."""
    counts = df.groupBy(F.col(label).cast(label_type).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    # total over the per-class counts (one row per class): window over the tiny table
    return (counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
            .select(label, "n", safe_ratio(F.col("n") * 100, F.col("total")).alias("pct"))
            .orderBy(label))
