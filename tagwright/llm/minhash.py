"""MinHash near-dedup by tensored banding: table keys are pairs from two small collections of minhash bands.

A document's set holds its distinct word shingles (as XXH64 values). Two collections of ``BANDS`` bands, each of ``ROWS``
minhashes, are computed; table (i, j) is keyed by band i of the first and band j of the second collection. So BANDS^2
tables of 2 ROWS minhashes each cost 2 BANDS ROWS minhashes, about the square root of computing them table by table. Two
sets of Jaccard similarity s share a table with probability (1 - (1 - s^ROWS)^BANDS)^2: 0.9999 at 0.8. Only bands that
two sets have count, so a document without likes costs no keys. Sets of one band i are a key, BANDS at most of a document:
what shares a table shares it. Only if more than KEY_TILE sets have a band, in which clusters still meet at last, are its
sets cut into the tables (i, j).

Equal sets are one node. A pair is plausible if SIGNATURE of the minhashes agree (of pairs at the threshold 99.997 % are).
Within a table key every two sets are compared but for those that plausible pairs have joined already: every set meets one
centre of its keys first, then the clusters that meet in a key are compared, one set of each with a centre that is drawn
per key among clusters. So a large group of near copies is one cluster before, at last, every two sets of a key that are
still in different clusters are compared, in tiles of bounded size. Links are confirmed on the full sets within the clusters
so found: sets meet in tiles of bounded size, and a tile compares only sets that it has not linked yet and gives no more
links than it has sets.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle; repeated rows share their component; a null id is in its set's component but
never the smallest (component null if all its ids are null; kept if component and id are equal, nulls included); an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagwright.llm.common import map_batches, text_key, utf8
from tagwright.llm.simhash import components
from tagwright.session import ensure_checkpoint_dir, scratch_path

SEED = 42
ROWS = 3
BANDS = 14
SIGNATURE = 0.62
TILE = 512            # sets of a cluster that meet as many others in one task
TILE_SHINGLES = 4_000_000
KEY_TILE = 4096       # sets of a table key that meet as many others in one task
_SLICE = 1 << 16      # shingles hashed at a time

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = utf8(text).lower().split()   # bytes: only A-Z change
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())),
                                 dtype=np.uint64, count=len(starts)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The set's minhashes, 32 bits each."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _SLICE):
        h = hashes[at:at + _SLICE]
        for i, (m, a) in enumerate(zip(_MUL, _ADD)):
            low[i] = min(low[i], (h * m + a).min())
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def band_hashes(sig: np.ndarray) -> list[int]:
    """One hash per band; the band's number goes into it."""
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(sig.reshape(-1, ROWS))]


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n (set size), digest (128 bits of the set), bands (their hashes) and short (the minhashes' last
    bytes); the last three are null for an empty set."""
    def run(columns):
        n, digest, bands, short = [], [], [], []
        for text in columns["text"]:
            h = shingle_set(text.as_py(), shingle)
            n.append(len(h))
            digest.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
            sig = signature(h) if len(h) else None
            bands.append(None if sig is None else band_hashes(sig))
            short.append(None if sig is None else (sig & 0xFF).astype(np.uint8).tobytes())
        return {"doc_id": columns["doc_id"], "text_key": columns["text_key"], "n": n, "digest": digest, "bands": bands, "short": short}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text_key("text").alias("text_key"), "text"), run,
                       f"doc_id {kind}, text_key string, n long, digest binary, bands array<bigint>, short binary")


def _one_of_each(keys: DataFrame) -> DataFrame:
    """Of keys with the same nodes, two or more, one."""
    h = F.xxhash64("node")
    members = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                      F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s1"), F.sum(F.shiftright(h, 32)).alias("s2"))
    one = members.where("lo < hi").groupBy("n", "lo", "hi", "s1", "s2").agg(F.min("key").alias("key")).select("key").checkpoint()
    return keys.join(one, "key", "left_semi")


def tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node): the bands of the first collection that two nodes or more share; (node, band): those of the second.
    Nodes without both are left out: they share no table key."""
    bands = nodes.select("node", F.posexplode("bands").alias("slot", "band")).select("node", (F.col("slot") >= BANDS).alias("second"), "band").checkpoint()
    common = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band").checkpoint()
    shared = bands.join(common, "band", "left_semi").checkpoint()
    both = shared.groupBy("node").agg(F.min("second").alias("u"), F.max("second").alias("v")).where("not u and v").select("node").checkpoint()
    shared = shared.join(both, "node", "left_semi").checkpoint()
    first = shared.where("not second").select(F.col("band").alias("key"), "node")
    return _one_of_each(first).select("key", "node").checkpoint(), shared.where("second").select("node", "band")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, cut again from one text of each."""
    first = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")).checkpoint()
    d = docs.select("doc_id", text_key("text").alias("text_key"), "text")
    d = d.join(first, d["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "text")

    def run(columns):
        return {"node": columns["node"], "hashes": [shingle_set(t.as_py(), shingle).view(np.int64) for t in columns["text"]]}

    # a row that occurs twice has one set
    return map_batches(d.dropDuplicates(["node"]), run, "node long, hashes array<bigint>").checkpoint()


def _stored(df: DataFrame) -> DataFrame:
    """A table written in the shared folder and reread. A checkpoint carries what the optimizer knows of its columns on, which
    grows from round to round; a file does not."""
    path = scratch_path(df.sparkSession, "minhash")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def plausible(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose signatures (``short``: node, short) agree enough."""
    def run(batches):
        for p in batches:
            a, b = (np.frombuffer(b"".join(p.column(i).to_pylist()), dtype=np.uint8).reshape(p.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(_agreement(a, b) >= SIGNATURE))

    s = lambda x: short.select(F.col("node").alias(x), F.col("short").alias(f"_{x}"))
    return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _order(turn: int, root: str, node: str) -> Column:
    """One order of all nodes per turn, cluster by cluster."""
    return F.struct(F.xxhash64(F.lit(turn), root).alias("_"), F.xxhash64(F.lit(turn), node).alias("_n"), F.col(node).alias("centre"), F.col(root).alias("of"))


def _met(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one tile the pairs of clusters (a, b) of which two plausible sets share a key."""
    d = pdf.sort_values("key", kind="stable") if pdf["a"].iloc[0] == pdf["b"].iloc[0] else pdf
    key, root, n, chunk = (d[c].to_numpy() for c in ("key", "root", "n", "chunk"))
    short = np.frombuffer(b"".join(d["short"]), dtype=np.uint8).reshape(len(d), -1)
    out: set[tuple[int, int]] = set()

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        may = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[may], j[may]
        same = _agreement(short[i], short[j]) >= SIGNATURE
        i, j = root[i[same]], root[j[same]]
        out.update(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))

    if d is pdf:                                     # two chunks of one key
        left, right = (np.flatnonzero(chunk == pdf[c].iloc[0]) for c in ("a", "b"))
        for i in left:
            compare(np.full(len(right), i), right)
    else:                                            # whole keys side by side: each set with the next one, the one after it, ...
        at, step = np.arange(len(d)), 1
        while len(at := at[:np.searchsorted(at, len(d) - step)]):
            at = at[key[at + step] == key[at]]
            compare(at, at + step)
            step += 1
    return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")


def narrowed(there: DataFrame, second: DataFrame) -> DataFrame:
    """Keys (key, node, root) of more than KEY_TILE sets, where clusters meet, are cut by the second bands of their sets."""
    large = there.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    large = large.where((F.col("lo") < F.col("hi")) & (F.col("size") > KEY_TILE)).select("key").checkpoint()
    if large.isEmpty():
        return there
    cut = there.join(large, "key", "left_semi").join(second, "node").select("node", F.xxhash64("key", "band").alias("key"), "root").checkpoint()
    return there.join(large, "key", "left_anti").unionByName(_one_of_each(cut)).checkpoint()


def meetings(keys: DataFrame, root: DataFrame, short: DataFrame, percent: int, second: DataFrame | None = None) -> DataFrame:
    """(a, b): clusters of which two plausible sets share a key. Every two sets of a key that lie in different clusters are
    compared, in tiles of bounded size; keys with one cluster are left out. Large keys are cut by ``second``, if given."""
    there = keys.join(root, "node").checkpoint()
    there = there if second is None else narrowed(there, second)
    sizes = there.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    sizes = sizes.select("key", "size", F.ceil(F.col("size") / KEY_TILE).alias("chunks")).checkpoint()
    bins = max(1, (sizes.where("chunks = 1").agg(F.sum("size")).first()[0] or 0) // KEY_TILE)       # many small keys in one tile
    d = there.join(sizes, "key").checkpoint()
    zero = F.lit(0).cast("long")
    whole = d.where("chunks = 1").select(F.lit(False).alias("large"), F.pmod(F.xxhash64("key"), F.lit(bins)).alias("tile"),
                                         zero.alias("a"), zero.alias("b"), zero.alias("chunk"), "key", "root", "node")
    parts = d.where("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    parts = parts.withColumn("_o", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    parts = parts.select(F.lit(True).alias("large"), F.col("key").alias("tile"), F.least("chunk", "_o").alias("a"),
                         F.greatest("chunk", "_o").alias("b"), "chunk", "key", "root", "node")
    d = whole.unionByName(parts).join(short, "node")
    return d.groupBy("large", "tile", "a", "b").applyInPandas(lambda pdf: _met(pdf, percent), "a long, b long").distinct()


def clusters(nodes: DataFrame, keys: DataFrame, percent: int = 80, second: DataFrame | None = None) -> DataFrame:
    """(node, root): the clusters of plausible pairs that share a key (and, if given, a band of ``second``: larger keys are
    cut by it), of two nodes or more."""
    short = nodes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "n", "short").checkpoint()
    every = short.select("node")

    # first the centre that comes first among all those of a node's keys
    centre = keys.withColumn("root", F.col("node")).groupBy("key").agg(F.min(_order(0, "root", "node")).alias("c")).checkpoint()
    nearest = keys.join(centre, "key").groupBy("node").agg(F.min("c").alias("c")).where("node <> c.centre")
    edges = _stored(plausible(nearest.select("node", "c.centre").toDF("a", "b"), short))
    root = _stored(every.join(edges.toDF("node", "_r"), "node", "left").select("node", F.coalesce("_r", "node").alias("root")))
    # then every two clusters that meet in a key, the others with one of them, each by one of its sets there
    there = (keys.join(root, "node").groupBy("key", "root").agg(F.min(_order(1, "root", "node")).alias("c")).checkpoint())
    centre = there.groupBy("key").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("c").alias("m")).checkpoint()
    pairs = there.join(centre, "key").where("root <> m.of").select(F.least("c.centre", "m.centre").alias("a"), F.greatest("c.centre", "m.centre").alias("b")).distinct()
    found = components(edges.unionByName(_stored(plausible(pairs, short)))).withColumnsRenamed({"root": "_r"})
    root = _stored(every.join(found, "node", "left").select("node", F.coalesce("_r", "node").alias("root")))
    # at last every two sets that share a key and are still in different clusters
    left = _stored(meetings(keys, root, short, percent, second))
    if not left.isEmpty():
        found = components(left).toDF("root", "_r")
        root = _stored(root.join(found, "root", "left").select("node", F.coalesce("_r", "root").alias("root")))
    return root.join(root.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "root").select("node", "root")


def _linked(left: list[int], right: list[int], n: np.ndarray, short: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two groups of sets (places; maybe the same group) that make the components of all their links."""
    up = list(range(len(sets)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out, every = [], np.array(right)
    for i in left:
        q = every[every > i] if left is right else every
        q = q[100 * np.minimum(n[q], n[i]) >= percent * np.maximum(n[q], n[i])]
        for j in q[_agreement(short[q], short[i]) >= SIGNATURE].tolist():
            if top(i) != top(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (int(n[i]) + int(n[j]) - both):
                    up[top(i)] = top(j)
                    out.append((i, j))
    return out


def links(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) within clusters; members: node, root, short, hashes."""
    members = members.withColumn("n", F.size("hashes").cast("long"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))
    sizes = sizes.select("root", "size", chunks.alias("chunks")).checkpoint()
    bins = max(1, (sizes.where("chunks = 1").agg(F.sum("size")).first()[0] or 0) // TILE)       # many small clusters in one tile
    d = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tile = F.when(F.col("chunks") > 1, F.col("root")).otherwise(-1 - F.pmod(F.xxhash64("root"), F.lit(bins)))
    d = d.select(tile.alias("tile"), F.least("chunk", "_o").alias("a"), F.greatest("chunk", "_o").alias("b"), "chunk", "root", "node", "n", "short", "hashes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, node, chunk = [], pdf["node"].to_numpy(), pdf["chunk"].to_numpy()
        n, sets = pdf["n"].to_numpy(), pdf["hashes"].tolist()
        short = np.frombuffer(b"".join(pdf["short"]), dtype=np.uint8).reshape(len(pdf), -1)
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        for at in pdf.groupby("root", sort=False).indices.values():
            left = [i for i in at.tolist() if chunk[i] == a]
            right = left if a == b else [i for i in at.tolist() if chunk[i] == b]
            out += [(node[i], node[j]) for i, j in _linked(left, right, n, short, sets, percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return d.groupBy("tile", "a", "b").applyInPandas(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest id reachable) and kept of every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    p = prints(docs, shingle).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    nodes = p.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short")).checkpoint()
    # numbered after a checkpoint, and stored: a node's number is the same for all that follows
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    first_bands, second_bands = tables(nodes)
    cluster = _stored(clusters(nodes, first_bands, percent, second_bands))
    sets = full_sets(docs, nodes, cluster.select("node"), shingle)
    members = cluster.join(nodes.select("node", "short"), "node").join(sets, "node")
    roots = components(_stored(links(members, percent))).withColumnsRenamed({"root": "_r"})
    rooted = nodes.select("node", "digest", "first.doc_id").join(roots, "node", "left").select("digest", "doc_id", F.coalesce("_r", "node").alias("root"))
    rooted = rooted.checkpoint()
    low = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")).checkpoint()
    group = rooted.join(low, "root").select("digest", "component_id")
    d = p.select("doc_id", "text_key", "n", "digest").join(group, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return d.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
