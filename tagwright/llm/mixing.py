"""Mixing sources to target weights: Efraimidis-Spirakis sampling up to token budgets.

Each source has a budget of words. Whole epochs come first: floor(budget / size)
copies of every document. The rest is a weighted sample without replacement:
documents sorted by the exponential key ``-ln(u) / weight`` are taken in order
until the budget is met (the last one if that brings the total nearer).

No source is sorted as a whole, so a source may hold any share of the rows: keys fall
into about sqrt(documents) buckets per source, bucket sums give the running total,
and only the one bucket that holds the cut is sorted. Its outcome is one cut per
source (a bucket and a last key), and every document is decided against that cut in
a map, without moving its text.

Defined results: null and empty texts have size 0 and are never needed for a budget;
null sources form one source, last in order; documents are ordered by (key, doc_id,
text) and rows equal in id and text are taken alike; a null or non-positive weight
counts as ``MIN_WEIGHT``; an empty table gives no rows. ``u`` comes from a hash of id and
text, so reruns agree on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tagwright.llm.common import n_words, packed, text_key, unpacked
from tagwright.operators.prepare import assign_row_id
from tagwright.session import ensure_checkpoint_dir

MIN_WEIGHT = 0.05
MAX_SOURCES_BROADCAST = 100_000  # checked: one small row per source
CYCLE = 3                        # sources weigh 1, 2, 3, 1, 2, 3, ...


def letter_share(text: Column | str = "text") -> Column:
    """A document's quality weight: the share of letters in its characters, MIN_WEIGHT at least."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    letters = F.length(F.regexp_replace(t, "\\P{L}+", ""))
    return F.greatest(F.lit(MIN_WEIGHT), F.coalesce(F.try_divide(letters, F.length(t)), F.lit(0.0)))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text_key(text)))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(F.lit(MIN_WEIGHT), F.coalesce(weight, F.lit(MIN_WEIGHT)))


def targets(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add each source's weight and its target: shares of the total by weight, at most ``max_epochs`` times its size.

    ``sources``: one row (source, docs, source_size) per source; there may be as many as there are hosts. Ranks come from a
    sort in ranges. The level that uncapped sources share rises round by round, as those whose cap it passes are held at
    it, until it passes no more; a round is one aggregate, of which the driver gets three numbers.
    """
    ensure_checkpoint_dir(sources.sparkSession)
    s = assign_row_id(sources.checkpoint(), [F.col("source").asc_nulls_last()], "_rank")
    s = (s.withColumn("weight", (F.col("_rank") % CYCLE + 1).cast("double"))
         .withColumn("cap", max_epochs * F.col("source_size")).checkpoint())
    first = s.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, level, held = float(first["words"] or 0), (first["words"] or 0) / (first["weights"] or 1), 0
    while True:
        capped = F.col("cap") / F.col("weight") <= F.lit(level)
        now = s.agg(F.count_if(capped).alias("held"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("spent"),
                    F.sum(F.when(~capped, F.col("weight"))).alias("free")).first()
        if now["held"] == held:
            break
        held, level = now["held"], (words - now["spent"]) / now["free"] if now["free"] else float("inf")
    return (s.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight"))))
            .select("source", "docs", "source_size", "weight", "target"))


def _sized(docs: DataFrame, weight: Column, seed: str) -> DataFrame:
    return docs.select(F.col("source").alias("source"), F.col("doc_id"), text_key("text").alias("_text"),
                       n_words("text").alias("size"),
                       exponential_key(F.col("doc_id"), F.col("text"), weight, seed).alias("_key"))


def _bucket() -> Column:
    """Monotone in the key; ``_buckets`` of them. key / (1 + key) spreads keys of every weight from MIN_WEIGHT to 1: no
    bucket is expected to hold over 12 times its even share (the density's peak is 4 / (e * e * weight) times even at low weights)."""
    return F.least(F.floor(F.col("_key") / (1 + F.col("_key")) * F.col("_buckets")), F.col("_buckets") - 1).cast("long")


def _order() -> Column:
    return F.struct("_key", F.col("doc_id").isNull(), "doc_id", "_text")


def cuts(sized: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """One row per source: target, whole epochs, the bucket that holds the cut, and the last document taken in it."""
    src = targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")), max_epochs)
    src = (src.withColumn("_epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
           .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
           .withColumn("_buckets", F.ceil(F.sqrt("docs")).cast("long")))
    src = src.checkpoint()  # one row per source; read by each of the steps below
    if src.count() <= MAX_SOURCES_BROADCAST:
        src = F.broadcast(src)
    keyed = sized.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("d.source"))
    running = W.partitionBy("source").orderBy("_at")
    sums = (keyed.withColumn("_at", _bucket()).groupBy("source", "_at")
            .agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
            .withColumn("_after", F.sum("_sum").over(running)))
    edge = (sums.where((F.col("_after") > F.col("_rest")) & (F.col("_after") - F.col("_sum") <= F.col("_rest")))
            .select(F.col("source").alias("_src"), F.col("_at").alias("_cut_bucket"), (F.col("_after") - F.col("_sum")).alias("_before")))
    edge = edge.groupBy("_src").agg(F.min_by("_cut_bucket", "_cut_bucket").alias("_cut_bucket"),
                                    F.min_by("_before", "_cut_bucket").alias("_before"))
    inside = (keyed.withColumn("_at", _bucket())
              .join(edge, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_cut_bucket"))))
    upto = W.partitionBy("source").orderBy("_key", F.col("doc_id").asc_nulls_last(), "_text").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    last = (inside.where((F.col("_rest") > 0) & (F.col("_upto") + F.col("size") / 2 <= F.col("_rest")))
            .groupBy(F.col("source").alias("_src2")).agg(F.max(_order()).alias("_last")))
    out = (src.join(edge, F.col("source").eqNullSafe(F.col("_src")), "left")
           .join(last, F.col("source").eqNullSafe(F.col("_src2")), "left"))
    return out.select("source", "source_size", "target", "_epochs", "_rest", "_buckets", "_cut_bucket", "_last")


def decide(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """Add source_size, target and copies (whole epochs plus 1 for the sampled documents) to sized rows."""
    small = cut.count() <= MAX_SOURCES_BROADCAST
    right = (F.broadcast(cut) if small else cut).withColumnRenamed("source", "_source")
    d = sized.join(right, F.col("source").eqNullSafe(F.col("_source")))
    # a target of whole epochs takes no document once more, not even an empty one
    extra = (F.col("_rest") > 0) & ((_bucket() < F.col("_cut_bucket"))
             | ((_bucket() == F.col("_cut_bucket")) & F.col("_last").isNotNull() & (_order() <= F.col("_last"))))
    return d.withColumn("copies", F.col("_epochs") + F.when(extra, 1).otherwise(0)).drop(*[c for c in right.columns if c[0] == "_"])


def mix(docs: DataFrame, weight: Column | None = None, seed: str = "mix", max_epochs: float = 3.0) -> DataFrame:
    """source, doc_id, size, source_size, target, copies and taken (words) of every document; texts are read once."""
    ensure_checkpoint_dir(docs.sparkSession)
    sized = _sized(docs, letter_share() if weight is None else weight, seed).checkpoint()  # numbers only, no texts
    out = decide(sized, cuts(sized, max_epochs).checkpoint())
    return out.select("source", "doc_id", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weight: Column | None = None, seed: str = "mix", max_epochs: float = 3.0) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, in its own columns."""
    ensure_checkpoint_dir(docs.sparkSession)
    weight = letter_share() if weight is None else weight
    sized = _sized(docs, weight, seed).checkpoint()
    cut = cuts(sized, max_epochs).checkpoint()
    rows = docs.select(packed(docs), F.col("source"), F.col("doc_id"), text_key("text").alias("_text"),
                       exponential_key(F.col("doc_id"), F.col("text"), weight, seed).alias("_key"))
    taken = decide(rows, cut).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unpacked(docs))
