"""SimHash near-dedup: pigeonhole blocks, joined on blocks, verified by Hamming distance.

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64
hashes of its word shingles, repeats included. Fingerprints at most ``distance`` bits
apart are linked; components of links are the groups of near copies.

Equal fingerprints are one node, whatever the number of copies. The 64 bits are cut
into ``BLOCKS`` blocks; two fingerprints within the distance agree on all but
``distance`` of them, so they share one of the keys made of the other blocks. In a key
with few fingerprints these are compared. A key with many (a large group of near
copies) is not expanded into pairs: there a fingerprint and its neighbours at half
the distance become variants, and fingerprints that share a variant are within the
distance of each other by the triangle inequality, so each is linked to the
smallest of its variant. Both ways give the same components.

Defined results: null and empty texts have fingerprint 0 and are linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows share their
group; a null id is in its fingerprint's component but is never the smallest
(component null if all its ids are null); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tagwright.llm.common import packed, text_key, unpacked, utf8
from tagwright.session import ensure_checkpoint_dir

SEED = 42
BLOCKS = 4
PAIRS_UP_TO = 32   # fingerprints of one key that are compared pairwise; larger keys go by variants, exactly
EDGES = 1 << 17    # of a partition in a round of components


def simhash(text: str | None, shingle: int) -> int:
    words = utf8(text).lower().split()  # bytes: only A-Z change
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of a text as a signed long."""
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return of(F.col(text) if isinstance(text, str) else text)


def hex16(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(distance: int) -> list[int]:
    width = 64 // BLOCKS
    block = [((1 << width) - 1) << (width * b) for b in range(BLOCKS)]
    if distance >= BLOCKS:
        raise ValueError(f"a distance of {distance} bits needs more than {BLOCKS} blocks")
    return [sum(block[b] for b in keep) for keep in combinations(range(BLOCKS), BLOCKS - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) whose components are those of all close pairs."""
    ensure_checkpoint_dir(fps.sparkSession)
    if distance % 2:
        raise ValueError("variants at half the distance need an even distance")
    masks = _masks(distance)
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k"))
                     for i, m in enumerate(masks)])
    blocks = fps.select("fp", F.explode(keys).alias("_")).select("_.m", "_.k", "fp")
    # stored, as every grouped side of a join here: with a shuffle on either side a hot key can be split
    sizes = blocks.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    shared = blocks.join(sizes, ["m", "k"]).checkpoint()

    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = shared.where(F.col("n") <= PAIRS_UP_TO).groupBy("m", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (few.select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(PAIRS_UP_TO))).alias("b"))
             .where(far <= distance))

    # many: two fingerprints within the distance share a variant at half of it; the key itself can't differ
    bits = [F.lit(_signed(1 << b)).cast("long") for b in range(64)]
    many = shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    variants = many.select("fp", F.lit(0).alias("left"), F.col("fp").alias("v"))
    for _ in range(distance // 2):
        flipped = F.transform(F.array(*bits), lambda b: F.col("v").bitwiseXOR(b))
        variants = variants.select("fp", F.explode(F.array_append(flipped, F.col("v"))).alias("v")).distinct()
    smallest = variants.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("_b")).where("a < _b").checkpoint()
    stars = variants.join(smallest, "v").where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b")).where(far <= distance)
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node of the component, by alternating large and small stars.

    Each round is joins and grouped minima over the remaining edges, checkpointed in the shared folder; a hub with any
    number of neighbours is a pre-aggregated minimum and a join that adaptive execution may split. A round's tables have
    as few partitions as their rows need: every partition is a file of each checkpoint and some of each shuffle.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    before = None
    rows = e.count()
    while True:
        few = -(-rows // EDGES) or 1     # a round adds no edges
        swapped = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = e.coalesce(few).select(F.explode(F.array(F.struct("u", "v"), swapped)).alias("_")).select("_.u", "_.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(2 * few).checkpoint()
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct().coalesce(few).checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few).checkpoint()
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(few).checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, rows = now, now[0]


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, root (smallest fingerprint linked) and component_id (smallest id reachable), and a key of the text."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = docs.select("doc_id", text_key("text").alias("text_key"), fingerprint("text", shingle).alias("fp")).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint()
    roots = components(links(nodes.select("fp"), distance))
    # a root's own row is missing from (node, root): a fingerprint without one is its own root
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id")).checkpoint()
    group = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return fps.join(group, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Of each group one document, in its own columns: the one with the smallest id (null last), of equal ids by text key."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_")
    keep = near_groups(docs, shingle, distance).groupBy("root").agg(first).select(
        F.col("_.doc_id").alias("_id"), F.col("_.text_key").alias("_text"))
    rows = docs.select(packed(docs), F.col("doc_id").alias("_doc"), text_key("text").alias("_key"))
    mine = rows.join(keep, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left_semi")
    return mine.dropDuplicates(["_doc", "_key"]).select(*unpacked(docs))
