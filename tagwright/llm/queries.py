"""One registered query per operator, over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagwright.llm import (digest, divergence, hardneg, linededup, minhash, mixing, oracles, quality, secretscan, simhash, spm, substring, toxicity,
                           urlfilter)
from tagwright.sources.tables import load


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    g = simhash.near_groups(load(spark, sf, "documents"), shingle=3, distance=2)
    return g.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def _part(x: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(x), start, n), 16, 10).cast("long")


def captured(pages: DataFrame) -> DataFrame:
    """Captures: the pages' URLs, fetched on a day of 2020 to 2023 that a hash of the page id gives."""
    day = (_part(F.concat(F.lit("f"), F.col("page_id").cast("string")), 1, 6) % 1461).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), day).alias("fetched"))


def listed(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own URLs: a hash chooses a quarter of their hosts, parent domains and first path
    prefixes, the day each is listed, and whether and when it is taken off and listed again."""
    host = urlfilter.host_of(F.col("url"))
    labels = F.split(host, "\\.")
    segments = F.filter(F.split(F.regexp_extract("url", urlfilter.PATH, 1), "/"), lambda x: x != "")
    some = F.array(host, F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, 2, F.size(labels)), ".")),
                   F.when(F.size(segments) > 0, F.concat(host, F.lit("/"), F.get(segments, 0))))
    p = F.col("pattern")
    c = (pages.where(host != "").select(F.explode(some).alias("pattern")).where(p.isNotNull()).distinct()
         .where(_part(p, 1, 4) % 4 == 0)
         .withColumn("d1", F.date_add(F.lit("2020-01-01").cast("date"), (_part(p, 5, 4) % 1000).cast("int")))
         .withColumn("days", (1 + _part(p, 11, 3) % 400).cast("int"))
         .withColumn("off", _part(p, 9, 2) % 2 == 0).withColumn("again", _part(p, 14, 2) % 3 == 0))
    dated = F.array(F.struct(F.col("d1").alias("date"), F.lit("block").alias("action")),
                    F.when(F.col("off"), F.struct(F.date_add("d1", F.col("days")).alias("date"), F.lit("allow").alias("action"))),
                    F.when(F.col("off") & F.col("again"),
                           F.struct(F.date_add("d1", F.col("days") + 100).alias("date"), F.lit("block").alias("action"))))
    return c.select("pattern", F.explode(dated).alias("e")).where("e is not null").select("pattern", "e.date", "e.action")


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    d = urlfilter.filter_urls(captured(pages), listed(pages))
    return d.withColumn("fetched", F.col("fetched").cast("string"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.dedup_lines(load(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(load(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    pieces = spm.read_model()
    d = spm.decode(spm.encode(docs, pieces), pieces)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                    (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return quality.apply_rules(docs, quality.train(docs, load(spark, sf, "labels")))


def op7_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = digest.with_neighbours(load(spark, sf, "documents"))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                    "near_edited", "near_next")


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = substring.dedup_passages(load(spark, sf, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = secretscan.scan(load(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in secretscan.BASE],
                    F.sha2(secretscan.joined(base), 256).alias("base_sha256"), secretscan.joined(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf, "labels"), ~toxicity.held_out())
    d = toxicity.score(docs, model)
    return d.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_copies(load(spark, sf, "documents"), shingle=4, percent=80).drop("text_key")


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(load(spark, sf, "documents"), min_docs=10, k=10)


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    planted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(hardneg.usable(vectors, "embedding", planted), F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_url_filter, op3_line_dedup, op4_mix_sources, op5_sentencepiece,
                            op6_quality_rules, op7_fingerprints, op8_substring_dedup, op9_secret_scan, op10_toxicity, op11_minhash_near_dedup, op12_source_divergence, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": oracles.URL_FILTER, "op3_line_dedup": oracles.LINE_DEDUP,
                              "op4_mix_sources": oracles.MIXING, "op8_substring_dedup": oracles.PASSAGES,
                              "op9_secret_scan": oracles.secrets(), "op11_minhash_near_dedup": oracles.NEAR_COPIES,
                              "op12_source_divergence": oracles.DIVERGENCE,
                              "op13_hard_negatives": oracles.HARD_NEGATIVES}
