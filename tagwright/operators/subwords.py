"""Subword encoding by longest match with a given vocabulary.

A text is cut into words (runs of letters, digits and marks, single ideographs, single other signs), lower-cased; each word is
cut into pieces from the left, always the longest piece that the vocabulary has at that place. Pieces inside a word carry
a prefix there (``##ing``), or the last piece of a word a suffix (``ing</w>``). A word of which some place matches no piece,
or of more than ``MAX_WORD`` characters, is one unknown token. Tasks walk a trie, one step per character; the vocabulary is
read from a file on the driver and broadcast, its size is checked.

Defined results: a null or empty text has no tokens; offsets are code points of the text, the end exclusive; where
lower-casing changes a word's length all its pieces have the word's offsets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MAX_PIECES = 2_000_000   # checked: the vocabulary is broadcast
MAX_WORD = 100
_IDEOGRAPH = "[㐀-䶿一-鿿豈-﫿]"
WORDS = re.compile(rf"{_IDEOGRAPH}|(?:(?!{_IDEOGRAPH})\w)+|[^\w\s]")
_ANY, _LAST = 0, 1       # what a trie's node keeps beside its characters: the piece that ends there, and if only as a word's last


class Vocabulary(NamedTuple):
    pieces: dict[str, int]
    unknown: int
    inside: str = "##"   # prefix of the pieces that don't begin a word; '' if none have one
    final: str = ""      # suffix of the pieces that end a word


def read_vocabulary(spark: SparkSession, path: str, unknown: str) -> Vocabulary:
    """From a text file with a piece per line (its number is its id), or a tokenizer's JSON file with ``model.vocab``."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect())   # one file
    if path.endswith(".json"):
        file = json.loads(text)
        model, added = file["model"], file.get("added_tokens") or []
        pieces, inside, final = model["vocab"] | {t["content"]: t["id"] for t in added}, model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or ""
    else:
        pieces, inside, final = {p: i for i, p in enumerate(text.splitlines()) if p}, "##", ""
    if not 0 < len(pieces) <= MAX_PIECES:
        raise ValueError(f"a vocabulary has between 1 and {MAX_PIECES} pieces, not {len(pieces)}")
    return Vocabulary(pieces, pieces[unknown], inside, final)


def tries(v: Vocabulary) -> tuple[dict, dict]:
    """The tries of the pieces that may begin a word and of those that may follow (one and the same without a prefix)."""
    begin: dict = {}
    rest: dict = begin if not v.inside else {}
    for piece, i in v.pieces.items():
        node = begin
        if v.inside and piece.startswith(v.inside) and len(piece) > len(v.inside):
            node, piece = rest, piece[len(v.inside):]
        kind = _ANY
        if v.final and piece.endswith(v.final) and len(piece) > len(v.final):
            kind, piece = _LAST, piece[:-len(v.final)]
        for c in piece:
            node = node.setdefault(c, {})
        node[kind] = i
    return begin, rest


def pieces_of(word: str, begin: dict, rest: dict) -> list[tuple[int, int, int]] | None:
    """(id, start, end) of the word's pieces; None if some place has no piece."""
    out, at, node = [], 0, begin
    while at < len(word):
        found = end = None
        for j in range(at, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            here = node.get(_LAST) if j + 1 == len(word) and _LAST in node else node.get(_ANY)
            if here is not None:
                found, end = here, j + 1
        if found is None:
            return None
        out.append((found, at, end))
        at, node = end, rest
    return out


def tokens_of(text: str | None, begin: dict, rest: dict, unknown: int) -> Iterable[tuple[int, int, int]]:
    for m in WORDS.finditer(text or ""):
        word = m.group().lower()
        found = pieces_of(word, begin, rest) if len(word) <= MAX_WORD else None
        if found is None:
            yield unknown, m.start(), m.end()
        elif len(word) == m.end() - m.start():
            yield from ((i, m.start() + a, m.start() + b) for i, a, b in found)
        else:
            yield from ((i, m.start(), m.end()) for i, _, _ in found)


def encode_subwords(df: DataFrame, vocabulary: Vocabulary, text: str = "message", limit: int | None = None) -> DataFrame:
    """Add ids, starts and ends (arrays of int) of the text's tokens, of its first ``limit`` ones if given. A narrow map;
    the other columns pass through, columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast((*tries(vocabulary), vocabulary.unknown))
    keep = [c for c in df.columns if c.lower() not in ("ids", "starts", "ends")]
    ints = ArrayType(IntegerType())
    schema = StructType([*[df.schema[c] for c in keep], *[StructField(c, ints) for c in ("ids", "starts", "ends")]])
    at = len(keep)

    def run(batches):
        begin, rest, unknown = shared.value
        for b in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for t in b.column(at):
                own: tuple[list, list, list] = ([], [], [])
                for k, token in enumerate(tokens_of(t.as_py(), begin, rest, unknown)):
                    if k == limit:
                        break
                    for o, x in zip(own, token):
                        o.append(x)
                for c, o in zip(columns, own):
                    c.append(o)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(at)], *[pa.array(c, pa.list_(pa.int32())) for c in columns]],
                                             names=[f.name for f in schema])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")).mapInArrow(run, schema)


def fixed_length(ids: Column | str, start: int, end: int, pad: int, max_len: int) -> Column:
    """``struct(input_ids, attention_mask, token_type_ids)``: start + ids + end, truncated and padded."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    core = F.concat(F.array(F.lit(start)), F.slice(ids, 1, max_len - 2), F.array(F.lit(end)))
    rest = F.lit(max_len) - F.size(core)
    return F.struct(F.concat(core, F.array_repeat(F.lit(pad), rest)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size(core)), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
                    F.array_repeat(F.lit(0), F.lit(max_len)).alias("token_type_ids"))
