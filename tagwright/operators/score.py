"""Scoring any text function over a DataFrame in batches, with error isolation.

The scorer is a plain Python callable ``fn(list[str]) -> list[str]`` (a model,
a remote client, a stub). It runs inside Arrow-batched ``mapInPandas`` tasks:
Spark partitions the rows, Python only sees one batch at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagwright import constants as K
from tagwright.functions.text import strip_ws
from tagwright.operators.prepare import assign_batches, assign_row_id
from tagwright.session import ensure_checkpoint_dir, finished

Scorer = Callable[[list], list]


def _run_batch(fn: Scorer, texts: list, per_row_retry: bool) -> list:
    try:
        out = list(fn(texts))
        if len(out) != len(texts):
            raise ValueError(f"scorer returned {len(out)} outputs for {len(texts)} inputs")
        return [None if o is None else str(o) for o in out]
    except Exception:  # noqa: BLE001  (isolation is the point)
        if not per_row_retry:
            return [K.ERROR_OUTPUT] * len(texts)
        res = []
        for t in texts:
            try:
                one = list(fn([t]))[0]
                res.append(None if one is None else str(one))
            except Exception:  # noqa: BLE001
                res.append(K.ERROR_OUTPUT)
        return res


def batch_score(df: DataFrame, fn: Scorer, text_col: str = "prompt", key: str = "custom_id",
                batch_size: int = K.LLM_BATCH, on_error: str = "batch", batch_col: str | None = None,
                out_col: str = "model_output", strip_output: bool = True) -> DataFrame:
    """Score ``text_col`` with ``fn`` in batches (U1); the key passes through.

    on_error='batch': a batch that raises yields ``[ERROR]`` for all its rows
    and the run continues. With ``batch_col`` (from ``assign_batches``) batch
    membership is deterministic: rows are hash-partitioned by batch id and
    sorted, so every batch is whole inside one task whatever the Arrow
    boundaries are. on_error='row': the failing batch is retried row by row.
    Adds ``chunk_id``/``chunk_seconds`` (scoring time of the row's batch) for
    throughput reports. Outputs are stripped of surrounding whitespace
    (JVM-side) unless ``strip_output=False``.
    """
    per_row = on_error == "row"
    out_schema = T.StructType([df.schema[key], *_result_fields(out_col)])

    if batch_col is None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import uuid
            tag = uuid.uuid4().hex[:12]
            seq = 0
            for pdf in batches:
                outs, ids, secs = [], [], []
                texts = pdf[text_col].tolist()
                for i in range(0, len(texts), batch_size):
                    chunk = texts[i:i + batch_size]
                    t0 = time.perf_counter()
                    res = _run_batch(fn, chunk, per_row)
                    dt = time.perf_counter() - t0
                    outs += res
                    ids += [f"{tag}-{seq}"] * len(chunk)
                    secs += [dt] * len(chunk)
                    seq += 1
                yield pd.DataFrame({key: pdf[key].values, out_col: outs, "chunk_id": ids, "chunk_seconds": secs})

        return _strip(df.select(key, text_col).mapInPandas(run, out_schema), out_col, strip_output)

    run_grouped = _grouped_runner(fn, text_col, [key], batch_col, out_col, per_row)

    # every batch lands whole in one partition; AQE may coalesce partitions, which keeps batches whole
    ordered = (df.select(key, text_col, batch_col)
               .repartition(batch_col)
               .sortWithinPartitions(batch_col, key))
    return _strip(ordered.mapInPandas(run_grouped, out_schema), out_col, strip_output)


def _result_fields(out_col: str) -> list[T.StructField]:
    return [T.StructField(out_col, T.StringType()), T.StructField("chunk_id", T.StringType()),
            T.StructField("chunk_seconds", T.DoubleType())]


def _grouped_runner(fn: Scorer, text_col: str, through: list[str], batch_col: str, out_col: str, per_row: bool):
    """mapInPandas body: rows arrive ordered by batch id; each batch is scored whole.

    A batch cut by an Arrow batch boundary is carried over to the next Arrow
    batch of the same partition.
    """
    def run_grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending = None

        def flush(part: pd.DataFrame) -> pd.DataFrame:
            outs = []
            for b, g in part.groupby(batch_col, sort=False):
                t0 = time.perf_counter()
                res = _run_batch(fn, g[text_col].tolist(), per_row)
                dt = time.perf_counter() - t0
                outs.append(pd.DataFrame({**{c: g[c].values for c in through}, out_col: res, "chunk_id": str(b),
                                          "chunk_seconds": dt}))
            return pd.concat(outs) if outs else pd.DataFrame(columns=[*through, out_col, "chunk_id", "chunk_seconds"])

        for pdf in batches:
            if pending is not None:
                pdf = pd.concat([pending, pdf], ignore_index=True)
            last = pdf[batch_col].iloc[-1]
            done, pending = pdf[pdf[batch_col] != last], pdf[pdf[batch_col] == last]
            if len(done):
                yield flush(done)
        if pending is not None and len(pending):
            yield flush(pending)

    return run_grouped


def _strip(df: DataFrame, out_col: str, on: bool) -> DataFrame:
    return df.withColumn(out_col, strip_ws(out_col)) if on else df


def batch_score_ordered(df: DataFrame, fn: Scorer, order_cols, text_col: str = "prompt", key: str = "custom_id",
                        batch_size: int = K.LLM_BATCH, on_error: str = "batch", out_col: str = "model_output",
                        strip_output: bool = True, text: Column | None = None) -> DataFrame:
    """Score consecutive fixed-size batches in ``order_cols`` order (U1), shuffling only boundary batches.

    The rows are range-sorted and checkpointed (as for the dense index). A
    batch lies inside one partition except at most one batch per partition
    boundary: those (<= P-1 batches) are shuffled together by batch id; all
    other rows are scored where they are, in order, without any exchange.
    ``text`` builds the scorer's input (``text_col``) from the columns after the
    sort, so a long fixed prompt is neither sorted nor stored. All columns of
    ``df`` pass through. The result is lazy: store it once and derive from the
    stored rows, or the scorer runs again for every use.
    """
    spark = df.sparkSession
    per_row = on_error == "row"
    ensure_checkpoint_dir(spark)
    s = df.orderBy(*order_cols).checkpoint(eager=True)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # P rows, checkpointed (nothing to release): read by the rows and by the list of cut batches
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")).checkpoint(eager=True)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    rows = (s.join(F.broadcast(offsets), "_pid")
            .withColumn("_idx", F.col("_off") + local)
            .withColumn("batch_id", F.floor(F.col("_idx") / F.lit(batch_size)).cast("bigint")).drop("_pid", "_mid", "_off"))
    if text is not None:
        rows = rows.withColumn(text_col, text)
    # batches cut by a partition boundary: the batch of each partition's first row when it does not start a batch
    cut = (offsets.where((F.col("_off") > 0) & (F.col("_off") % batch_size != 0))
           .select(F.floor(F.col("_off") / F.lit(batch_size)).cast("bigint").alias("batch_id")).distinct())
    cut = F.broadcast(cut)  # at most P-1 rows
    through = [c for c in df.columns if c != text_col]
    runner = _grouped_runner(fn, text_col, through, "batch_id", out_col, per_row)
    out_schema = T.StructType([*[df.schema[c] for c in through], *_result_fields(out_col)])
    cols = [*through, text_col, "batch_id"]
    inner = rows.join(cut, "batch_id", "left_anti").select(*cols).mapInPandas(runner, out_schema)
    edge = (rows.join(cut, "batch_id", "left_semi").select(*cols, "_idx")
            .repartition("batch_id").sortWithinPartitions("batch_id", "_idx").select(*cols)
            .mapInPandas(runner, out_schema))
    return _strip(inner.unionByName(edge), out_col, strip_output)


def score_resumable(df: DataFrame, fn: Scorer, path: str, order_cols, text_col: str = "prompt", key: str = "custom_id",
                    batch_size: int = K.LLM_BATCH, wave_batches: int = 10_000, retries: int = 0, on_error: str = "batch",
                    out_col: str = "model_output", text: Column | None = None) -> DataFrame:
    """Score in consecutive batches as ``batch_score_ordered``, so that a run that ended halfway can be taken up again.

    ``path`` (shared) holds the run: the input with its batches, written once, and the outputs by wave of ``wave_batches`` batches,
    each committed as a whole. A rerun scores only waves that are not committed; the batches of committed ones are
    not sent to the scorer again. Batches that hold an ``[ERROR]`` are then scored anew, at most ``retries`` times, each
    attempt committed like a wave; the last attempt counts. Returns key, batch_id, attempt, the output, chunk_id, chunk_seconds.
    """
    spark = df.sparkSession
    if not finished(spark, f"{path}/input"):
        d = df.orderBy(*order_cols).checkpoint(eager=True)       # the batches are fixed before any is scored
        d = assign_batches(assign_row_id(d, order_cols, "_idx"), batch_size, "_idx")
        d.withColumn("wave", F.floor(F.col("batch_id") / wave_batches)).write.mode("overwrite").partitionBy("wave").parquet(f"{path}/input")
    added = [T.StructField(c, T.LongType()) for c in ("_idx", "batch_id", "wave")]
    rows = spark.read.schema(T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], *added])).parquet(f"{path}/input")
    waves = (rows.agg(F.max("wave")).first()[0] or 0) + 1 if not rows.isEmpty() else 0
    prompt = rows if text is None else rows.withColumn(text_col, text)

    def scored(d: DataFrame, at: str) -> DataFrame:
        if not finished(spark, at):
            out = batch_score(d.select(key, text_col, "batch_id"), fn, text_col, key, batch_size, on_error, "batch_id", out_col)
            out.withColumn("batch_id", F.col("chunk_id").cast("bigint")).write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)

    parts = [scored(prompt.where(F.col("wave") == w), f"{path}/output/wave={w}") for w in range(waves)]
    if not parts:
        return rows.select(key, F.lit(0).cast("bigint").alias("batch_id"), F.lit(0).alias("attempt"), F.lit("").alias(out_col),
                           F.lit("").alias("chunk_id"), F.lit(0.0).alias("chunk_seconds"))
    done = spark.read.option("basePath", f"{path}/output").parquet(*[f"{path}/output/wave={w}" for w in range(waves)]).drop("wave")
    done = done.withColumn("attempt", F.lit(0))
    for attempt in range(1, retries + 1):
        failed = done.where(F.col(out_col) == K.ERROR_OUTPUT).select("batch_id").distinct()
        if not finished(spark, f"{path}/retry={attempt}") and failed.isEmpty():
            break
        again = scored(prompt.join(failed, "batch_id", "left_semi"), f"{path}/retry={attempt}").withColumn("attempt", F.lit(attempt))
        done = done.join(again.select("batch_id").distinct(), "batch_id", "left_anti").unionByName(again)
    return done.select(key, "batch_id", "attempt", out_col, "chunk_id", "chunk_seconds")


def ledger(scored: DataFrame, out_col: str = "model_output") -> DataFrame:
    """One row per batch of a resumable run: its last attempt, rows, failed rows and scoring seconds."""
    return scored.groupBy("batch_id").agg(F.max("attempt").alias("attempt"), F.count(F.lit(1)).alias("rows"),
                                          F.count_if(F.col(out_col) == K.ERROR_OUTPUT).alias("failed"), F.max("chunk_seconds").alias("seconds"))


def throughput(scored: DataFrame) -> DataFrame:
    """Rows, scoring seconds and rows per second from ``batch_score`` output."""
    per_chunk = scored.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"), F.max("chunk_seconds").alias("sec"))
    return per_chunk.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("batches"),
                         F.sum("sec").alias("seconds"),
                         F.try_divide(F.sum("rows").cast("double"), F.sum("sec")).alias("rows_per_second"))


def log_loss(df: DataFrame, logits: str = "logits", true: str = "true_label", weight: str = "weight",
             batch: str = "batch_id") -> DataFrame:
    """Cross-entropy from logits (A15): ``logsumexp(logits) - logits[true]``, finite for any finite logits.

    A certain mistake costs its full logit difference; a true label outside the logits is an error, not a skipped row.
    Per batch the class-weighted mean ``sum(w * nll) / sum(w)``; the reported
    loss is the plain mean over batches, plus the row-level mean.
    """
    z, y = F.col(logits), F.col(true)
    top = F.array_max(z)
    lse = top + F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    known = y.isNotNull() & (y >= 0) & (y < F.size(z))
    wrong = F.raise_error(F.concat(F.lit("log_loss: no logit for true label "), F.coalesce(y.cast("string"), F.lit("null"))))
    nll = F.when(known, lse - F.get(z, y.cast("int"))).otherwise(wrong.cast("double"))
    per_batch = df.groupBy(batch).agg(
        (F.sum(F.col(weight) * nll) / F.sum(weight)).alias("bl"), F.sum(nll).alias("sn"),
        F.count(F.lit(1)).alias("bn"))
    return per_batch.agg(F.sum("bn").cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"),
                         F.avg("bl").alias("weighted_batch_loss"), (F.sum("sn") / F.sum("bn")).alias("mean_loss"))


def length_stub_scorer(texts: list) -> list:
    """Deterministic stand-in model: answers ``[len % 4]``; fails any batch holding a text
    whose length is a multiple of 53 (exercises batch isolation)."""
    if any(len(t) % 53 == 0 for t in texts):
        raise RuntimeError("stub model failure")
    return [f"[{len(t) % 4}]" for t in texts]
