"""Quality rules: gradient-boosted trees over document statistics with monotonic constraints.

The statistics of a text are counted in Spark tasks over the whole text. The
trees are boosted in numpy on a bounded labelled sample (logistic loss, binned
features) and flattened into node arrays, so a batch of documents walks all
trees with array indexing. A constrained feature only ever lowers the score:
more symbols, repeated lines, repeated words or capitals can't make a document
look better.

Defined results: a null text has no words; an empty text has zero statistics;
equal texts get equal verdicts; without labels of both classes there are no
trees and the base rules alone decide; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagwright.llm.common import bounded_labels, map_batches, text_key, words_of

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: feature name -> -1: a larger value never raises the score; 0: free
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "capital_share": -1, "symbol_word_share": -1, "mark_share": -1, "distinct_share": 0, "line_words": 0}
_ASCII_UPPER = bytes(range(65, 91))


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by a window of ``size`` words that occurs twice or more in the text, the first one included."""
    if len(words) <= size:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    windows = np.zeros(len(words) - size + 1, dtype=np.int64)
    for k in range(size):
        windows = windows * len(seen) + code[k:k + len(windows)]
        if k + 1 < size and len(seen) ** (k + 2) >= 2 ** 62:  # renumber before the next step could overflow
            windows = np.unique(windows, return_inverse=True)[1]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(size):
        covered[k:k + len(windows)] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the counts of COUNTS, the values of FEATURES) of one whole text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_window_words(words)
    raw = text.encode("utf-8", "replace")
    capitals = len(raw) - len(raw.translate(None, _ASCII_UPPER))
    marks = text.count("!") + text.count("?")
    chars = max(1, word_chars)
    per_word = max(1, n)
    odd = sum(text.count(c + " ") + text.count(c + "\n") for c in SYMBOLS)
    feats = [float(np.log1p(n)), word_chars / per_word, symbols / chars, dup_lines / max(1, len(lines)), repeat / per_word,
             capitals / chars, odd / per_word, marks / chars, len(set(words)) / per_word, n / max(1, len(lines))]
    return [n, word_chars, symbols, dup_lines, repeat], feats


@dataclass(frozen=True)
class Config:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    leaf_rows: int = 10
    penalty: float = 1.0
    max_rows: int = 8000   # bound of the labelled sample the trees are fitted on


@dataclass
class Trees:
    """All trees in flat arrays: node -> feature, threshold, left, right, value; leaves point at themselves."""
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], config: Config = Config()) -> Trees:
    """Newton boosting; a split on a signed feature is refused if its sides are in the wrong order, and the middle of
    the two sides bounds everything below them, so the whole ensemble is monotone in that feature."""
    nodes: list[list] = []   # feature, threshold, left, right, value
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base, roots = float(np.log(share / (1 - share))), []

    def flat() -> Trees:
        cols = list(zip(*nodes)) if nodes else [[]] * 5
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        return Trees(base, np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(cols, kinds)), config.depth)

    if len(np.unique(y)) < 2:
        return flat()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, config.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    logit = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + config.penalty), low, high))
        nodes.append([0, np.inf, me, me, value * config.rate])
        if depth == config.depth or len(rows) < 2 * config.leaf_rows:
            return me
        best = (1e-6, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
            gr, hr = total_g - gl, total_h - hl
            vl = np.clip(-gl / (hl + config.penalty), low, high)
            vr = np.clip(-gr / (hr + config.penalty), low, high)
            loss = lambda gg, hh, v: gg * v + 0.5 * (hh + config.penalty) * v * v
            gain = loss(total_g, total_h, value) - loss(gl, hl, vl) - loss(gr, hr, vr)
            gain[(nl < config.leaf_rows) | (len(rows) - nl < config.leaf_rows)] = 0
            if signs[j]:
                gain[(vr - vl) * signs[j] < 0] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return me
        j, k, vl, vr = best[1]
        goes_left = binned[rows, j] <= k
        bounds_l = bounds_r = (low, high)
        if signs[j]:
            mid = (vl + vr) / 2
            bounds_l, bounds_r = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid))
        nodes[me][:2] = [j, float(cuts[j][k])]
        nodes[me][2] = grow(rows[goes_left], g, h, depth + 1, *bounds_l)
        nodes[me][3] = grow(rows[~goes_left], g, h, depth + 1, *bounds_r)
        return me

    everything = np.arange(len(y))
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-logit))
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = flat()
        tree.base, tree.roots = 0.0, tree.roots[-1:]
        logit += tree.logits(x)
    return flat()


def sample_features(docs: DataFrame, labels: DataFrame, where: Column | None = None,
                    config: Config = Config()) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample, by id and text. Texts are counted in tasks; the driver gets numbers only."""
    chosen = F.broadcast(bounded_labels(labels, "quality", config.max_rows, where))  # <= max_rows rows of two numbers

    def count(cols):
        return {"doc_id": cols["doc_id"], "key": cols["key"], "label": cols["label"],
                "features": [statistics(t.as_py())[1] for t in cols["text"]]}

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), F.col("label").cast("long").alias("label"), "text")
    counted = map_batches(rows, count, "doc_id long, key string, label long, features array<double>")
    got = counted.orderBy("doc_id", "key").limit(2 * config.max_rows).select("features", "label").toArrow()
    x = got["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return x.reshape(len(got), len(FEATURES)), got["label"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, config: Config = Config()) -> Trees:
    """Fit on at most ``config.max_rows`` labelled documents (half per class, chosen by a hash of the id)."""
    return boost(*sample_features(docs, labels, where, config), list(FEATURES.values()), config)


def apply_rules(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, score (probability of good quality) and kept of every document. A narrow map."""
    held = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def run(cols):
        trees = Trees(**held.value)
        counted = [statistics(t.as_py()) for t in cols["text"]]
        counts = np.array([c for c, _ in counted], dtype=np.int64)
        score = 1 / (1 + np.exp(-trees.logits(np.array([f for _, f in counted]))))
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        return {"doc_id": cols["doc_id"].cast(pa.int64()), **{n: counts[:, i] for i, n in enumerate(COUNTS)},
                "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
