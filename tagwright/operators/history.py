"""Training history: best-so-far series and early-stopping decisions as window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagwright import constants as K


def history_best(history: DataFrame, run: str = "run_id", epoch: str = "epoch", metric: str = "val_f1") -> DataFrame:
    """Per epoch: best-so-far metric, whether this epoch improved, patience counter.

    Improvement is strict against the best so far, which starts at 0. Windows
    are partitioned by run; a run has one row per epoch.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    prev_best = F.greatest(F.coalesce(F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                           F.lit(0.0))
    d = history.withColumn("improved", (F.col(metric) > prev_best).cast("int"))
    last_imp = F.max(F.when(F.col("improved") == 1, F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (d.withColumn("best_so_far", F.greatest(F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
            .withColumn("patience", (F.col(epoch) - F.coalesce(last_imp, F.lit(0))).cast("int")))


def early_stopping(history: DataFrame, patience: int = K.PATIENCE, run: str = "run_id", epoch: str = "epoch",
                   metric: str = "val_f1") -> DataFrame:
    """Per run: the epoch training stops at, whether it stopped early, the best epoch and metric.

    Walk semantics: stop at the first epoch whose patience counter reaches
    ``patience``; the best epoch is the last improvement up to that point.
    Assumes dense epochs 1..E (use a row number otherwise).
    """
    whole = Window.partitionBy(run)   # one row per epoch
    stop = F.min(F.when(F.col("patience") >= patience, F.col(epoch))).over(whole)
    h = history_best(history, run, epoch, metric).withColumn("_stop", stop)
    j = h.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return j.groupBy(run).agg(
        F.max(epoch).cast("int").alias("stop_epoch"),
        F.max(F.col("_stop").isNotNull().cast("int")).alias("stopped"),
        F.max(F.when(F.col("improved") == 1, F.col(epoch))).cast("int").alias("best_epoch"),
        F.greatest(F.max(metric), F.lit(0.0)).alias("best_metric"))
