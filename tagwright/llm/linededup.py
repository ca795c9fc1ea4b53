"""Line dedup: winnowing over line hashes, in DataFrame operations only.

A line is compared without the white space around it; blank lines are neither matched nor
deleted. A window is the shortest run of lines from some line on that has ``min_lines``
lines or ``min_words`` words. The line with the smallest hash in a window is its
fingerprint, so equal windows select the same line wherever they stand: any
repeated run as long as a window is found through a selected line. Selected lines whose
hash occurs at one position only are done with. Around the others all windows that
selected the line are compared, and a window is deleted where an equal one (128-bit
digest of its lines) starts earlier, in a document before it or further up in the
same one.

``extend`` (on in the query and the pipeline) grows matches both ways to their full runs:
every line of a repeated run of ``min_lines`` lines or ``min_words`` words goes, up to its
first and last line. Such a run is the union of its parts of ``min_lines`` lines at
most that qualify themselves (any three lines, or fewer with the words), so these are the
windows then, but for those that two shorter ones make up. Without it the last lines of a
run stay where their own window reaches past the run's end.

Documents are ordered by (doc_id, text), a null id last. Hot lines are counted before
they are shuffled (one row per task); what is joined to them is stored first, so
that both sides of these joins are plain shuffles, which adaptive execution splits.

Defined results: a null text stays null, an empty one empty; rows equal in id and text are
one document and share its result; an empty table gives no rows; extra columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagwright.llm.common import WORD, packed, unpacked
from tagwright.session import ensure_checkpoint_dir

_TRIM = "\t\n\x0b\x0c\r "


def _lines(text: Column) -> Column:
    """The text's non-blank lines: position among all lines, trimmed line, words."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                        lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(_TRIM)).alias("line")))
    return F.transform(F.filter(every, lambda x: x["line"] != ""),
                       lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), F.regexp_count(x["line"], F.lit(WORD)).alias("words")))


def _lengths(words: list[Column], min_lines: int, min_words: int, extend: bool) -> Column:
    """Lengths of the windows that start at a line, from the words of the lines from there on (null past the end)."""
    def enough(start: int, n: int) -> Column:
        return F.coalesce(sum(words[start + 1:start + n], words[start]) >= min_words, F.lit(False))

    fits = [words[n - 1].isNotNull() if n == min_lines else enough(0, n) for n in range(1, min_lines + 1)]
    if not extend:
        return F.array(F.coalesce(*[F.when(fit, n) for n, fit in enumerate(fits, 1)]))
    # a window that the ones without its last and without its first line make up isn't needed
    return F.array(*[F.when(fit & ~(enough(0, n - 1) & enough(1, n - 1)) if n > 1 else fit, n) for n, fit in enumerate(fits, 1)])


def windows(docs: DataFrame, min_lines: int = 3, min_words: int = 50, extend: bool = True) -> DataFrame:
    """One row per window: (doc_id, _h) of the document, positions of its lines, digest, and the line it selects."""
    d = docs.select("doc_id", F.xxhash64("text").alias("_h"), _lines(F.col("text")).alias("_l0"))
    ahead = [F.slice("_l0", k + 1, F.greatest(F.size("_l0") - k, F.lit(0))).alias(f"_l{k}") for k in range(1, min_lines)]
    d = d.select("doc_id", "_h", "_l0", *ahead)
    # each line side by side with the ones after it: a row holds one window, however long the document
    d = d.select("doc_id", "_h", F.explode(F.arrays_zip(*[f"_l{k}" for k in range(min_lines)])).alias("_z"))
    d = d.select("doc_id", "_h", F.array(*[F.col(f"_z._l{k}") for k in range(min_lines)]).alias("_next"))
    words = [F.get("_next", F.lit(k))["words"] for k in range(min_lines)]
    d = d.select("doc_id", "_h", "_next", F.explode(_lengths(words, min_lines, min_words, extend)).alias("_n")).where("_n is not null")
    d = d.select("doc_id", "_h", F.slice("_next", 1, F.col("_n")).alias("_run"))
    hashed = F.transform("_run", lambda x: F.struct(F.xxhash64(x["line"]).alias("print"), x["at"].alias("at")))
    d = d.select("doc_id", "_h", F.col("_run.at").alias("at"), F.md5(F.array_join("_run.line", "\n")).alias("digest"),
                 F.array_min(hashed).alias("_least"))
    return d.select("doc_id", "_h", "at", "digest", F.col("_least.print").alias("print"), F.col("_least.at").alias("print_at"))


def deletions(docs: DataFrame, min_lines: int = 3, min_words: int = 50, extend: bool = True) -> DataFrame:
    """(doc_id, _h, removed, origin): positions of the lines to delete, for the documents that lose any, and the other
    document where most of the deleted windows come first (null: all of them repeat the document itself)."""
    ensure_checkpoint_dir(docs.sparkSession)
    w = windows(docs, min_lines, min_words, extend).checkpoint()   # positions and digests, no texts: lines are read once
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("_h"), F.col("print_at"))
    selected = w.groupBy("print").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    # at two positions or more; stored, so that the join below has a shuffle on either side and hot lines can be split
    repeated = selected.where(F.col("_lo") < F.col("_hi")).select("print").checkpoint()
    around = w.join(repeated, "print", "left_semi")
    start = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("_h"), F.element_at("at", 1).alias("at"))
    first = around.groupBy("digest").agg(F.min(start).alias("_first"), F.max(start).alias("_last"))
    first = first.where(F.col("_first") < F.col("_last")).select("digest", "_first").checkpoint()
    later = around.join(first, "digest").where(start > F.col("_first"))
    origin = F.struct(F.col("_first.doc_id").alias("doc_id"), F.col("_first._h").alias("_h"))
    itself = F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first._h") == F.col("_h"))
    return (later.groupBy("doc_id", "_h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("removed"),
                                              F.mode(F.when(~itself, origin), True).alias("origin")))


def _deduped(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``_row`` (the document) and its entry in ``gone`` (see ``deletions``); the other columns of ``gone`` are kept."""
    d = docs.select(packed(docs), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_h"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "_h": "_of"})
    return d.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_of")), "left")


def _left(d: DataFrame) -> DataFrame:
    """Add _text, _lines, _gone, _lost to ``_deduped``: its new text, its lines, those deleted, the share of words lost."""
    text = F.col("_row.text")
    lines = F.col("_split")
    d = d.withColumn("_split", F.split(text, "\n", -1))     # a column of its own, read by place below
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    words = F.regexp_count(text, F.lit(WORD))
    lost = F.coalesce(F.try_divide(words - F.regexp_count(left, F.lit(WORD)), words), F.lit(0.0))
    same = F.col("removed").isNull()
    return d.select("*", F.when(same, text).otherwise(left).alias("_text"),
                    F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_lines"),
                    F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("_gone"),
                    F.when(same, F.lit(0.0)).otherwise(lost).alias("_lost")).drop("_split")


def _shingles(text: Column, n: int = 5) -> Column:
    """Hashes of the text's distinct runs of n words."""
    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), of), F.lit(0))   # words: cut once


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int = 50, extend: bool = True) -> DataFrame:
    """The documents with later repeated windows (``extend``: whole runs) deleted from ``text``; n_lines, n_removed and
    lost_share (of the words) are added and replace columns of these names."""
    d = _left(_deduped(docs, deletions(docs, min_lines, min_words, extend).drop("origin")))
    return d.select(*unpacked(docs, ("text", "n_lines", "n_removed", "lost_share")), F.col("_text").alias("text"),
                    F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.col("_lost").alias("lost_share"))


def dedup_documents(docs: DataFrame, copy_share: float = 0.8, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """As ``dedup_lines`` with whole runs, in the documents' own columns, without copies: documents of which no word is left,
    or which lost ``copy_share`` of their words and have that likeness (Jaccard, 5-word shingles) to one document before them."""
    gone = deletions(docs, min_lines, min_words, extend=True).checkpoint()
    origins = gone.where("origin is not null").select("origin.doc_id", "origin._h", F.lit(True).alias("is_origin"))
    marks = (gone.unionByName(origins, allowMissingColumns=True).groupBy("doc_id", "_h")
             .agg(F.first("removed", True).alias("removed"), F.first("origin", True).alias("origin"), F.max("is_origin").alias("is_origin")))
    d = _left(_deduped(docs, marks).checkpoint())   # texts moved once; each of the steps below reads a part
    out = [F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    some = F.col("removed").isNull() | F.col("_text").rlike(WORD)
    suspect = F.col("origin").isNotNull() & (F.col("_lost") >= copy_share)
    s = d.where(suspect & some).select("_row", "_text", "origin", _shingles(F.col("_row.text")).alias("_own")).checkpoint()
    wanted = s.select(F.col("origin.doc_id").alias("_o"), F.col("origin._h").alias("_oh")).distinct()
    at = F.col("_doc").eqNullSafe(F.col("_o")) & (F.col("_h") == F.col("_oh"))
    first = (d.where("is_origin").select("_doc", "_h", "_row.text").join(wanted, at, "left_semi")
             .groupBy("_doc", "_h").agg(F.first("text").alias("text")))
    first = first.select("_doc", "_h", _shingles(F.col("text")).alias("_theirs")).checkpoint()   # many copies may have one
    s = s.join(first, F.col("origin.doc_id").eqNullSafe(F.col("_doc")) & (F.col("origin._h") == F.col("_h")), "left")
    common = F.size(F.array_intersect("_own", "_theirs"))
    alike = common / (F.size("_own") + F.size("_theirs") - common)
    return (d.where(some & ~suspect).select(*out)
            .unionByName(s.where(F.coalesce(alike < copy_share, F.lit(True))).select(*out)))
