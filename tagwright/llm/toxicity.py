"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into passages of ``passage_words`` words. Each passage is the
average of the vectors of its character n-grams (hashed into ``buckets`` rows;
word ends count as characters), put through a linear softmax of two classes. The
text's score is that of its most toxic passage, in training as in scoring:
a few abusive words in a text of 20,000 words are found as easily as in a short
one. An unseen misspelling shares most of its n-grams with a known word.

The softmax is linear in the averaged vectors, so for scoring the two factors
fold into one number per bucket; a task only gathers and averages these.

Defined results: null and empty texts have one empty passage (zero vector, the
bias alone); repeated rows get equal scores; no labels of one class at all: the
score is that class's share, clipped to (0, 1); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tagwright.llm.common import by_size, labelled, packed, unpacked, utf8

SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
SCORE_CHARS = 200_000     # characters cut into n-grams at a time: the cut takes over 100 bytes for each


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 17
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5)
    passage_words: int = 8
    max_rows: int = 8000       # bound of the labelled sample the model is fitted on
    epochs: int = 25
    rate: float = 0.05
    decay: float = 3e-4
    batch: int = 128
    seed: int = 7


@dataclass
class Model:
    config: Config
    vectors: np.ndarray       # buckets x dim
    weights: np.ndarray       # dim x 2
    bias: np.ndarray          # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """One number per bucket and one bias: the difference of the two classes' logits."""
        return ((self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32),
                float(self.bias[1] - self.bias[0]))


def ngrams(texts: list[str], config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its passage, first passage of each text); every text has one passage at least."""
    chars = np.frombuffer("".join(f"\n{t}" for t in map(str.lower, texts)).encode("utf-32-le", "replace") + b"\n\0\0\0", dtype="<u4")
    low = [len(t.lower()) + 1 for t in texts]
    start = np.concatenate([[0], np.cumsum(low)]).astype(np.int64)[:-1]
    space = np.isin(chars, SPACES)
    chars = np.where(space, np.uint32(32), chars)
    first = np.zeros(len(chars), dtype=bool)          # first character of a word
    first[1:] = space[:-1] & ~space[1:]
    word = np.cumsum(first)                           # words begun up to here
    before = word[start]                              # words of earlier texts
    doc = np.zeros(len(chars), dtype=np.int64)
    doc[start] = 1
    doc = np.cumsum(doc) - 1
    n = np.diff(np.append(before, word[-1]))          # words of each text
    passages = np.maximum(1, n // config.passage_words)  # the last one takes the remainder: no passage of a few words
    head = np.concatenate([[0], np.cumsum(passages)]).astype(np.int64)
    buckets, owner = [], []
    for size in config.sizes:
        m = len(chars) - size + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(2166136261 + size), dtype=np.uint32)
        for k in range(size):
            h ^= chars[k:k + m]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inner = np.concatenate([[0], np.cumsum(space)])
        whole = inner[size - 1:size - 1 + m] - inner[1:m + 1] == 0   # no word end inside, one at either side may be
        at = np.flatnonzero(whole)
        mid = at + 1                                                 # an inner character belongs to the word
        own = doc[mid]
        buckets.append((h[at] & np.uint32(config.buckets - 1)).astype(np.int64))
        owner.append(head[own] + np.clip((word[mid] - 1 - before[own]) // config.passage_words, 0, passages[own] - 1))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), head
    return np.concatenate(buckets), np.concatenate(owner), head


def passage_scores(grams: np.ndarray, owner: np.ndarray, count: int, table: np.ndarray) -> np.ndarray:
    total = np.bincount(owner, weights=table[grams], minlength=count)
    return total / np.maximum(1, np.bincount(owner, minlength=count))


def word_ids(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words; new words are added to ``known``."""
    return np.array([known.setdefault(w, len(known)) for w in utf8((text or "").lower()).split()], dtype=np.int32)


@dataclass
class Sample:
    """Texts as numbers of words: n-grams don't reach over a word's end, so each distinct word is cut once."""
    words: np.ndarray         # word of each place, 4 bytes each
    edge: np.ndarray          # place where each passage begins, and the end
    passages: np.ndarray      # passages of each text
    grams: np.ndarray         # buckets of the n-grams, word by word
    begin: np.ndarray         # where each word's n-grams begin, and the end

    @classmethod
    def of(cls, texts: list[str], config: Config) -> Sample:
        known: dict[bytes, int] = {}
        ids = [word_ids(t, known) for t in texts]
        return cls.from_ids(np.concatenate(ids + [np.zeros(0, dtype=np.int32)]), np.array(list(map(len, ids)), dtype=np.int64),
                            (w.decode() for w in known), config)

    @classmethod
    def from_ids(cls, ids: np.ndarray, lengths: np.ndarray, words: Iterable[str], config: Config) -> Sample:
        """From the texts' word numbers, one text after another, how many each has, and the words in order of number."""
        passages = np.maximum(1, lengths // config.passage_words)
        sizes = np.full(int(passages.sum()), config.passage_words, dtype=np.int64)
        sizes[np.cumsum(passages) - 1] = lengths - (passages - 1) * config.passage_words   # a text's last passage takes the rest
        grams, counts = [], []
        for group in by_size(words, 200_000):
            g, o, _ = ngrams(group, config)
            grams.append(g[np.argsort(o, kind="stable")].astype(np.int32))
            counts.append(np.bincount(o, minlength=len(group)))
        none = [np.zeros(0, dtype=np.int32)]
        begin = np.concatenate([[0], np.cumsum(np.concatenate(counts + none))]).astype(np.int64)
        return cls(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), passages, np.concatenate(grams + none), begin)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Mean of the table's values over each passage's n-grams; an empty passage has 0."""
        total = np.concatenate([[0.0], np.cumsum(table[self.grams], dtype=np.float64)])
        value, count = np.diff(total[self.begin]), np.diff(self.begin)
        out = np.zeros(len(self.edge) - 1)
        for k in range(0, len(out), 100_000):
            edge = self.edge[k:k + 100_001]
            ids, filled = self.words[edge[0]:edge[-1]], np.flatnonzero(np.diff(edge))
            if len(filled):
                at = edge[filled] - edge[0]
                out[k + filled] = np.add.reduceat(value[ids], at) / np.maximum(1, np.add.reduceat(count[ids], at))
        return out

    def grams_of(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of the passages, one after another; how many each has)."""
        ids = np.concatenate([self.words[self.edge[p]:self.edge[p + 1]] for p in passages])
        own = np.repeat(np.arange(len(passages)), self.edge[passages + 1] - self.edge[passages])
        count = self.begin[ids + 1] - self.begin[ids]
        at = np.arange(count.sum()) + np.repeat(self.begin[ids] - (np.cumsum(count) - count), count)
        return self.grams[at], np.bincount(own, count, len(passages)).astype(np.int64)


def text_logits(texts: list[str], table: np.ndarray, bias: float, config: Config) -> np.ndarray:
    grams, owner, head = ngrams(texts, config)
    return np.maximum.reduceat(passage_scores(grams, owner, int(head[-1]), table), head[:-1]) + bias


def logits(texts: Iterable[str | None], table: np.ndarray, bias: float, config: Config) -> np.ndarray:
    """``text_logits`` of any number of texts, a few at a time."""
    return np.concatenate([np.zeros(0), *(text_logits(group, table, bias, config) for group in by_size(texts, SCORE_CHARS))])


def fit(texts: list[str], labels: list[int], config: Config = Config()) -> Model:
    return fit_sample(Sample.of(texts, config), labels, config)


def fit_sample(sample: Sample, labels: list[int], config: Config = Config()) -> Model:
    """Vectors and softmax trained together by Adagrad; each text counts by its passage that scores highest so far."""
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1, 1, (config.buckets, config.dim)) / config.dim
    weights = rng.uniform(-1, 1, (config.dim, 2)) / config.dim
    y = np.asarray(labels, dtype=np.int64)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    bias = np.zeros(2)
    if len(set(labels)) < 2:
        return Model(config, vectors * 0, weights, np.log(np.array([1 - share, share])))
    lengths, base = sample.passages, len(sample.edge) - 1
    head = np.cumsum(lengths) - lengths
    class_weight = 0.5 / np.array([1 - share, share])
    g2v, g2w, g2b = np.full(config.buckets, 1e-8), np.full(weights.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(config.epochs):
        diff = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        score = sample.scores(diff)
        top = np.maximum.reduceat(score, head)
        best = np.maximum.reduceat(np.where(score == np.repeat(top, lengths), np.arange(base), -1), head)
        if epoch == 0:  # before anything is learned, any passage is as good
            best = head + rng.integers(0, lengths)
        for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // config.batch)):
            flat, sizes = sample.grams_of(best[pick])
            row = np.repeat(np.arange(len(pick)), sizes)
            mean = np.stack([np.bincount(row, vectors[flat, k], len(pick)) for k in range(config.dim)], axis=1)
            mean /= np.maximum(1, sizes)[:, None]
            logit = mean @ weights + bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            err = prob / prob.sum(1, keepdims=True)
            err[np.arange(len(pick)), y[pick]] -= 1
            err *= class_weight[y[pick]][:, None] / len(pick)
            dw, db = mean.T @ err + config.decay * weights, err.sum(0)
            used, slot = np.unique(flat, return_inverse=True)
            pull = (err @ weights.T) / np.maximum(1, sizes)[:, None]
            dv = np.stack([np.bincount(slot, pull[row, k], len(used)) for k in range(config.dim)], axis=1)
            dv += config.decay * vectors[used]
            g2v[used] += (dv * dv).mean(1)
            vectors[used] -= config.rate * dv / np.sqrt(g2v[used])[:, None]
            g2w += dw * dw
            weights -= config.rate * dw / np.sqrt(g2w)
            g2b += db * db
            bias = bias - config.rate * db / np.sqrt(g2b)
    return Model(config, vectors, weights, bias)


def sample_words(rows: DataFrame) -> DataFrame:
    """(label, ids, new) of the sample's rows (text, label) in one partition: a text's word numbers, the words it adds."""
    def run(batches):
        known: dict[bytes, int] = {}     # distinct words of the bounded sample
        for b in batches:
            ids, new = [], []
            for text in b.column("text"):
                begin = len(known)
                ids.append(word_ids(text.as_py(), known))
                new.append([w.decode() for w in islice(reversed(known), len(known) - begin)][::-1])
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(new, pa.list_(pa.string()))],
                                             names=["label", "ids", "new"])

    return rows.mapInArrow(run, "label int, ids array<int>, new array<string>")


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, config: Config = Config()) -> Model:
    """Fit on at most ``config.max_rows`` labelled documents (half per class, chosen by a hash of the id). Their texts
    are cut into words in a task; the driver gets word numbers and each distinct word once."""
    got = sample_words(labelled(docs, labels, "toxic", config.max_rows, where).coalesce(1)).toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], [], config)
    ids, new = (got[c].chunk(0) for c in ("ids", "new"))
    sample = Sample.from_ids(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64), (w.as_py() for w in new.flatten()), config)
    y = got["label"].to_pylist()
    del got, ids, new
    return fit_sample(sample, y, config)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of the toxic class of each whole text. A narrow map: no shuffle, all columns pass through."""
    table, bias = model.folded()
    held, config = docs.sparkSession.sparkContext.broadcast(table), model.config  # buckets * 4 bytes

    @pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-logits(texts, held.value, bias, config))))

    return docs.withColumn(out, toxic(F.col(text_col)))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, config: Config = Config()) -> DataFrame:
    """Documents whose score stays under ``threshold``, with their own columns unchanged."""
    rows = docs.select(packed(docs), F.col("text").alias("_text"))
    scored = score(rows, train(docs, labels, ~held_out(), config), "_text", "_score")
    return scored.where(F.col("_score") < threshold).select(*unpacked(docs))
