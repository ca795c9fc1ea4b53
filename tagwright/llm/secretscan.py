"""Secret scans: a trigram inverted index chooses the documents that each rule has to read.

From each rule's regular expression a Boolean trigram query is derived: every
alternative through the expression is a conjunction of the trigrams of its literal
runs. The index holds a posting (trigram, document) for every trigram that any rule
asks for; joining the queries to it and counting intersects the postings, and
only these candidates are verified with the expression. A rule with an alternative
without trigrams (``hex``) reads every document. All of it is DataFrame operations.

Defined results: a null text counts as empty; an empty text has no spans; rows equal in
id and text share their result; positions count code points, the end exclusive;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from re import _constants as C, _parser as P

from pyspark.sql import Column, DataFrame, functions as F

# kind -> (expression, group whose length counts, least length); the first three are the base kinds
RULES: dict[str, tuple[str, int, int]] = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),   # the maximal runs of [0-9a-f]+ that are long enough
    "private": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "forge": ("(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 40),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "maps": ("AIza[A-Za-z0-9_-]{35}", 0, 39),
    "payment": ("[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "signed": ("eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 20),
    "login": ("://[A-Za-z0-9._-]+:[^\\s/@:]{3,}@", 0, 0),
}
BASE = ("assign", "access", "hex")
SMALL_SET = 8   # characters of a set that are taken as alternatives; a larger set is a gap
_GAP = None


def _paths(tokens) -> list[list[str | None]]:
    """All ways through an expression as characters and gaps (anything that isn't one known character)."""
    ways: list[list[str | None]] = [[]]
    for op, arg in tokens:
        if op is C.LITERAL:
            more = [[chr(arg)]]
        elif op is C.IN and len(arg) <= SMALL_SET and all(o is C.LITERAL for o, _ in arg):
            more = [[chr(c)] for _, c in arg]
        elif op is C.BRANCH:
            more = [w for branch in arg[1] for w in _paths(branch)]
        elif op is C.SUBPATTERN:
            more = _paths(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, item = arg
            once = _paths(item)
            more = [[_GAP]] if _GAP in sum(once, []) and not least else once if (least, most) == (1, 1) else \
                [[]] + once if (least, most) == (0, 1) else [w + [_GAP] for w in once] if least else [[_GAP]]
        elif op is C.AT:
            more = [[]]
        else:
            more = [[_GAP]]
        ways = [w + m for w in ways for m in more]
    return ways


def trigram_query(expression: str) -> list[list[str]] | None:
    """Alternatives, each the trigrams (in lower case) that all have to occur; None: some alternative has none."""
    out = []
    for way in _paths(P.parse(expression)):
        runs = "".join("\0" if c is _GAP else c for c in way).lower().split("\0")
        need = sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2)})
        if not need:
            return None
        if need not in out:
            out.append(need)
    return [x for x in out if not any(set(y) < set(x) for y in out)]   # an alternative that asks for more than another is met by it


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the given trigrams: (trigram, doc_id, _h)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return d.select(F.explode(found).alias("trigram"), "doc_id", "_h")


def candidates(docs: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(doc_id, _h, kinds): the rules with mandatory trigrams whose queries the document satisfies."""
    queries = {k: q for k, (e, _, _) in rules.items() if (q := trigram_query(e))}
    rows = [(t, k, i, len(alt)) for k, q in queries.items() for i, alt in enumerate(q) for t in alt]
    spark = docs.sparkSession
    asked = F.broadcast(spark.createDataFrame(rows, "trigram string, kind string, way int, need int"))  # bounded by the rules
    hits = postings(docs, sorted({r[0] for r in rows})).join(asked, "trigram")
    met = (hits.groupBy("doc_id", "_h", "kind", "way").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need"))
           .where("n = need"))
    return met.groupBy("doc_id", "_h").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(parts: Column, least: int, order: int) -> Column:
    """Spans of one rule from the lengths of pieces, matches and checked groups: one running position over them.

    An array that grows by one entry is copied each time, so entries are gathered in blocks of the square root of their
    number, and the blocks' arrays are put together at the end.
    """
    def step(a, x):
        start = a["pos"] + x["piece"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(x["part"] >= least, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    def block(a, x):
        inner = F.aggregate(x, F.struct(a["pos"].alias("pos"), none.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["pos"].alias("pos"), F.array_append(a["out"], r["out"]).alias("out"))), F.lit(0))

    none = F.array().cast(_SPANS)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(parts).cast("double"))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size).cast("int")), lambda k: F.slice(parts, k * size + 1, size))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    return F.coalesce(F.when(F.size(parts) > 0, F.flatten(F.aggregate(blocks, begin, block, lambda a: a["out"]))), none)


def scan(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """doc_id and ``spans`` (array of start, kind, end by start, then by the rules' order) of every document."""
    for e, _, _ in rules.values():
        re.compile(e)
    kinds = list(rules)
    cand = candidates(docs, rules).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_text"), "kinds")
    d = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.join(cand, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text")), "left")
    text, parts = F.col("text"), []
    for k, (e, group, _) in rules.items():
        # rlike first: pieces and matches are only built where there is one
        read = text.rlike(e) if trigram_query(e) is None else F.array_contains("kinds", k) & text.rlike(e)
        lengths = F.arrays_zip(F.transform(F.split(text, e, -1), F.length).alias("piece"),
                               F.transform(F.regexp_extract_all(text, F.lit(e), F.lit(0)), F.length).alias("hit"),
                               F.transform(F.regexp_extract_all(text, F.lit(e), F.lit(group)), F.length).alias("part"))
        typed = lengths.cast("array<struct<piece:int,hit:int,part:int>>")
        parts.append(F.when(F.coalesce(read, F.lit(False)), typed).alias(f"_p{len(parts)}"))
    d = d.select("doc_id", *parts)
    found = [_spans(F.col(f"_p{i}"), least, i) for i, (_, _, least) in enumerate(rules.values())]
    ordered = F.array_sort(F.concat(*found))
    names = F.array(*[F.lit(k) for k in kinds])
    return d.select("doc_id", F.transform(ordered, lambda s: F.struct(
        s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
