"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (its output
links); each report relaxes the best score at that position from the finished best
score where the piece starts. A character that is no piece of its own may also
be spelled in byte pieces at a score below every piece's. Spaces become U+2581 and one is
put before the text; nothing else is normalised, so decoding gives back the
exact text, a literal U+2581 (always spelled in bytes) included.

No piece holds U+2581 after another character and none holds a line feed (checked when the
model is read), so the best segmentation of a text is that of its words side by side. The
segmentations of recent words are kept in a bounded cache per task.

The model file is read on the driver (its path is a parameter) and its pieces, some ten thousand,
are broadcast: executors need no file.

Defined results: null and empty texts have no ids and decode to the empty text; equal texts
have equal ids; of equal scores the segmentation with the longest last piece wins; an empty
table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagwright.llm.common import add_column

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 120_000   # per generation; two generations are held


@dataclass(frozen=True)
class Pieces:
    """Text, score and id of the ordinary pieces, and the ids of the 256 byte pieces."""
    texts: list[str]
    scores: list[float]
    ids: list[int]
    byte_ids: list[int]


def read_model(path: str = DEFAULT_MODEL) -> Pieces:
    """Pieces of a model file. A unigram model's scores are log probabilities and are taken as they are. A BPE model
    stores minus the merge rank (a huge number for pieces that no merge makes), and sums of ranks mean nothing: there the
    score is the log probability that Zipf's law gives the rank, -ln(rank + 2)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    byte_ids = [-1] * 256
    texts, scores, ids = [], [], []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
            texts.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
            ids.append(i)
    if all(s <= 0 and s == int(s) for s in scores):
        scores = [-math.log(min(-s, len(scores)) + 2) for s in scores]
    return checked(Pieces(texts, scores, ids, byte_ids))


def checked(p: Pieces) -> Pieces:
    if min(p.byte_ids) < 0:
        raise ValueError("the model has no byte pieces: decoding could not give back every text")
    if any("\n" in t or SPACE in t.lstrip(SPACE) for t in p.texts):
        raise ValueError("a piece reaches over a word's end: words can't be encoded one by one")
    return p


class Encoder:
    """Segments texts; one per Python worker and model."""

    def __init__(self, pieces: Pieces):
        self.automaton = ahocorasick.Automaton()
        for text, score, i in zip(pieces.texts, pieces.scores, pieces.ids):
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        self.single = {t for t in pieces.texts if len(t) == 1}
        self.unknown = min(pieces.scores, default=0.0) - UNKNOWN_PENALTY
        self.bytes = pieces.byte_ids
        # words by the number of space marks before them (0 at the start of a line, else 1): recent ones and those before
        self.young: list[dict[str, tuple[int, ...]]] = [{}, {}]
        self.old: list[dict[str, tuple[int, ...]]] = [{}, {}]

    def segment(self, marks: int, word: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of ``marks`` space marks followed by a word (in which U+2581 is an ordinary character)."""
        text = SPACE * marks + word
        read = SPACE * marks + word.replace(SPACE, "\0") if SPACE in word else text
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        if self.single.issuperset(read):
            for end, piece in self.automaton.iter(read):
                got = best[end + 1 - piece[0]] + piece[1]
                if got > best[end + 1]:
                    best[end + 1], back[end + 1] = got, piece
        else:
            done = 0
            ends = [*self.automaton.iter(read), (n, None)]
            for end, piece in ends:
                for at in range(done, end):   # byte pieces of the characters before, before anything starts after them
                    if read[at] not in self.single and best[at] + self.unknown > best[at + 1]:
                        best[at + 1], back[at + 1] = best[at] + self.unknown, (1, 0.0, -1)
                done = max(done, end)
                if piece and best[end + 1 - piece[0]] + piece[1] > best[end + 1]:
                    best[end + 1], back[end + 1] = best[end + 1 - piece[0]] + piece[1], piece
        out: list[int] = []
        at = n
        while at:
            size, _, i = back[at]
            if i < 0:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "replace")))
            else:
                out.append(i)
            at -= size
        out.reverse()
        return tuple(out), best[n]

    def word(self, marks: int, word: str) -> tuple[int, ...]:
        """Ids of a word that isn't among the recent ones, which it joins."""
        if marks > 1:
            return self.segment(marks, word)[0]
        ids = self.old[marks].get(word) or self.segment(marks, word)[0]
        if len(self.young[marks]) >= CACHE_WORDS:
            self.old[marks], self.young[marks] = self.young[marks], {}
        if len(word) <= 64:
            self.young[marks][word] = ids
        return ids

    def encode(self, text: str | None, out: list[int] | None = None) -> list[int]:
        """Ids of a text, appended to ``out`` if given."""
        out = [] if out is None else out
        if not text:
            return out
        marks = 1    # one before the text
        for line_no, line in enumerate(text.split("\n")):
            if line_no:
                out.append(self.bytes[10])
            recent = self.young[1]
            for k, word in enumerate(line.split(" ")):
                if k:
                    if marks == 0 and (ids := recent.get(word)):
                        out += ids
                        continue
                    marks += 1
                if word:
                    out += self.young[marks].get(word) or self.word(marks, word) if marks < 2 else self.word(marks, word)
                    recent, marks = self.young[1], 0
            if marks:
                out += self.segment(marks, "")[0]
                marks = 0
        return out


def decode_table(pieces: Pieces) -> list[bytes]:
    """The bytes of each id; ids of control and unknown pieces have none."""
    table = [b""] * (max([*pieces.ids, *pieces.byte_ids]) + 1)
    for t, i in zip(pieces.texts, pieces.ids):
        table[i] = t.replace(SPACE, " ").encode("utf-8")
    for b, i in enumerate(pieces.byte_ids):
        table[i] = bytes([b])
    return table


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    raw = b"".join([table[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text. A narrow map: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(vars(pieces))   # bounded by the model's vocabulary

    def ids_of(texts: pa.Array) -> pa.Array:
        # the worker's own copy of the broadcast also keeps the automaton and its words from task to task
        encoder = held.value.get("_encoder") or Encoder(Pieces(**held.value))
        held.value["_encoder"] = encoder
        ids, ends = [], [0]
        for t in texts.to_pylist():
            ends.append(len(encoder.encode(t, ids)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, dtype=np.int32)))

    return add_column(docs, text_col, out, "array<int>", ids_of)


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each id list (null: empty). A narrow map: no shuffle."""
    held = encoded.sparkSession.sparkContext.broadcast(decode_table(pieces))

    def text_of(lists: pa.Array) -> pa.Array:
        table = held.value
        return pa.array([decode_ids(x or [], table) for x in lists.to_pylist()], pa.string())

    return add_column(encoded, ids_col, out, "string", text_of)
