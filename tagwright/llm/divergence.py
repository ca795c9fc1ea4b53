"""Source divergence audit: how the word use of each source differs, found through dominance skybands.

A term is a run of letters (ASCII letters, and every character beyond ASCII), in lower case where ASCII. Each language
keeps the terms of ``min_docs`` of its documents. A source's (or the language's) smoothed share of a term is the integer
``p = 1 + floor(10^9 (n + 2) / (N + 2 V))``, and two shares diverge by ``f = floor((p - q)^2 / (p + q))``. Shares are
computed in decimals and stay below 2^31, so everything after them fits a long exactly.

Which terms tell a source apart: ``f`` never falls with a higher count in the source or a lower one in the language, and
ties go to the earlier term. So a term dominated by k others in all three can't be among the first k. Each task keeps
its skyband (terms dominated by fewer than k others), which holds the whole skyband's terms of its rows; the tasks'
skybands are merged, cut again, and only what is left is ranked by ``f``.

Which sources differ most: ``f`` summed over all kept terms for every two sources of a language, in tiles (a chunk of
terms, two blocks of sources), so neither a language's terms nor its sources meet in one task.

Defined results: null text, lang and source count as ''; a language without kept terms gives its pairs of sources the
value 0 and no terms; a source alone in its language has no pairs; repeated rows are documents of their own; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tagwright.llm.common import utf8
from tagwright.session import ensure_checkpoint_dir

SHARE = 1_000_000_000
TERMS = 512          # kept terms of a tile
SOURCES = 64         # sources of a block
PIECE = 1 << 20      # bytes of a text cut into terms at a time
MAX_LANGS = 100_000  # checked: one small row per language is broadcast
HELD = 200_000       # counts or terms that a task holds before it passes them on

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: str | None) -> Iterator[list[bytes]]:
    data, at = utf8(text).translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; counted per batch of texts, then summed."""
    schema = _parse_datatype_string("lang string, source string, term string, n long, docs long")
    arrow = to_arrow_schema(schema)

    def rows(n: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), count in n.items():
            terms, own = list(count), docs[lang, source]
            columns = ([lang] * len(terms), [source] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), list(count.values()), [own[t] for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        for b in batches:
            for i, (lang, source, text) in enumerate(zip(*(b.column(i) for i in range(3))), 1):
                group, own = (lang.as_py(), source.as_py()), set()
                count = n.setdefault(group, Counter())
                for piece in _terms(text.as_py()):
                    count.update(piece)
                    own.update(piece)
                docs.setdefault(group, Counter()).update(own)
                if i % 500 == 0 and sum(map(len, n.values())) > HELD:
                    yield from rows(n, docs)
                    n, docs = {}, {}
        yield from rows(n, docs)

    empty = F.lit("")
    d = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text")
    return d.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """p of a count, as a long; null without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({SHARE} AS DECIMAL(11, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) END")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def skyband(n: np.ndarray, total: np.ndarray, term: list[str], k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate (count at least, language count at most, not later in UTF-8).

    Taken in an order in which dominators come first, it is enough to count those that were kept: of k dominators the
    first k in that order are dominated by fewer than k themselves.
    """
    place = np.empty(len(term), dtype=np.int64)
    place[sorted(range(len(term)), key=[utf8(t) for t in term].__getitem__)] = np.arange(len(term))
    kept_total, kept_place, out = (np.empty(len(term), dtype=np.int64) for _ in range(3))
    m = 0
    for i in np.lexsort((place, total, -n)).tolist():
        if m < k or np.count_nonzero((kept_total[:m] <= total[i]) & (kept_place[:m] <= place[i])) < k:
            kept_total[m], kept_place[m], out[m] = total[i], place[i], i
            m += 1
    return out[:m]


def skybands(terms: DataFrame, k: int) -> DataFrame:
    """Of rows (lang, source, term, n, total, value) those in the skyband of their (lang, source)."""
    terms = terms.select("lang", "source", "term", "n", "total", "value")
    schema = terms.schema

    def cut(d: pd.DataFrame) -> pd.DataFrame:
        return d.iloc[skyband(d["n"].to_numpy(), d["total"].to_numpy(), d["term"].tolist(), k)]

    def local(batches):
        held: dict[tuple, list[pd.DataFrame]] = {}
        for b in batches:
            for group, d in b.groupby(["lang", "source"], sort=False):
                held.setdefault(group, []).append(d)
                if sum(map(len, held[group])) > 4 * TERMS:
                    held[group] = [cut(pd.concat(held[group]))]
            if sum(len(d) for parts in held.values() for d in parts) > HELD:
                yield from (cut(pd.concat(parts)) for parts in held.values())
                held = {}
        yield from (cut(pd.concat(parts)) for parts in held.values())

    return terms.mapInPandas(local, schema).groupBy("lang", "source").applyInPandas(cut, schema)


def _tile(d: pd.DataFrame) -> pd.DataFrame:
    """f between every two sources of a tile, summed over its terms; a source's row without a term has its share of none."""
    own = d[d["term"].isna()]
    source, none, block = own["source"].tolist(), own["p"].to_numpy(), own["block"].to_numpy()
    e = d[d["term"].notna()]
    code, names = pd.factorize(e["term"])
    p = np.repeat(none[:, None], len(names) + 1, axis=1)            # the last column: a term that none of them has
    at = {s: i for i, s in enumerate(source)}
    p[e["source"].map(at).to_numpy(dtype=np.int64), code] = e["p"].to_numpy()
    times = np.ones(len(names) + 1, dtype=np.int64)
    times[-1] = own["n_terms"].iloc[0] - len(names)
    a, b = d["a"].iloc[0], d["b"].iloc[0]
    out = []
    for i, s in enumerate(source):
        diff = p[i] - p
        value = (diff * diff // (p[i] + p) * times).sum(axis=1).tolist()
        out += [(s, source[j], value[j]) for j in range(len(source)) if j != i and {block[i], block[j]} == {a, b}]
    r = pd.DataFrame(out, columns=["source", "item", "value"])
    r.insert(0, "lang", d["lang"].iloc[0])
    return r


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source the others by divergence, and its k most telling terms."""
    ensure_checkpoint_dir(docs.sparkSession)
    empty, zero = F.lit(""), F.lit(0).cast("long")
    counts = term_counts(docs).checkpoint()                          # texts are read once
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "total").checkpoint())
    found = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total").checkpoint()
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", zero).alias("size")).checkpoint()
    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
             .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size")), "lang", "left")
             .select("lang", "n_sources", F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_size", zero).alias("lang_size")))
    # sources and terms fall into blocks and chunks by hash: their numbers follow the language's
    langs = (langs.withColumn("blocks", F.ceil(F.col("n_sources") / SOURCES)).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)))
             .checkpoint())
    if langs.count() <= MAX_LANGS:
        langs = F.broadcast(langs)
    groups = (groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
              .withColumn("none", share("0L", "size", "terms")).checkpoint())
    e = found.join(groups, ["lang", "source"])
    e = e.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn("p", share("n", "size", "terms"))

    told = e.withColumn("q", share("total", "lang_size", "terms")).where("p > q").withColumn("value", _f("p", "q"))
    first = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")    # a skyband's rows
    terms = (skybands(told, k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))

    in_chunk = (kept.join(langs, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))
                .agg(F.count(F.lit(1)).alias("n_terms")))
    chunks = (langs.select("lang", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"))
              .join(in_chunk, ["lang", "chunk"], "left").select("lang", "chunk", F.coalesce("n_terms", zero).alias("n_terms")))
    every = groups.join(chunks, "lang").select("lang", "chunk", "n_terms", "source", "block", "blocks", F.lit(None).cast("string").alias("term"),
                                               F.coalesce("none", F.lit(1).cast("long")).alias("p"))
    rows = every.unionByName(e.select("lang", "chunk", F.lit(None).cast("long").alias("n_terms"), "source", "block", "blocks", "term", "p"))
    other = F.explode(F.sequence(zero, F.col("blocks") - 1))
    rows = rows.withColumn("_o", other).select("lang", "chunk", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "block", "source",
                                               "term", "p", "n_terms")
    tiles = rows.groupBy("lang", "chunk", "a", "b").applyInPandas(_tile, "lang string, source string, item string, value long")
    pairs = tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")    # a source's pairs, all in the result
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)

