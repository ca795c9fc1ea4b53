import random

import pytest
import sentencepiece

from tagwright.llm import spm

PIECES = spm.Pieces(["▁", "a", "b", "ab", "▁ab", "ba", "bab", "▁▁", "abab"], [-3.0, -2.0, -2.5, -3.1, -4.0, -3.3, -4.2, -5.5, -5.9],
                    list(range(1000, 1009)), list(range(256)))


def brute_best(pieces, text):
    """Best score over all segmentations, by looking up every substring."""
    read = "▁" + text.replace(" ", "▁") if text else ""
    marks = {i for i, c in enumerate(text) if c == "▁"}   # spelled, never matched
    score = dict(zip(pieces.texts, pieces.scores))
    unknown = min(pieces.scores) - spm.UNKNOWN_PENALTY
    best = [0.0] + [float("-inf")] * len(read)
    for end in range(1, len(read) + 1):
        for start in range(end):
            s = read[start:end]
            if s in score and not any(start <= m + 1 < end for m in marks):
                best[end] = max(best[end], best[start] + score[s])
        if read[end - 1] not in score or end - 2 in marks:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def total(pieces, text, ids):
    """Score of a segmentation; byte pieces score once per character."""
    score = dict(zip(pieces.ids, pieces.scores))
    spelled = bytes(i for i in (pieces.byte_ids.index(x) if x in pieces.byte_ids else -1 for x in ids) if i >= 0).decode()
    return sum(score.get(i, 0.0) for i in ids) + len(spelled) * (min(pieces.scores) - spm.UNKNOWN_PENALTY)


def texts():
    rng = random.Random(6)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "ab\nab", "\n\n", " \n ", "▁", "a▁b", "\x1f", "\x1fab a", "\x00▁\x00", "é日本😀", "a\tb", "\r\n"]
    return out + ["".join(rng.choice("aaabbb  \n▁é") for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def test_viterbi_is_optimal_and_round_trips():
    code, table = spm.Encoder(spm.checked(PIECES)), spm.decode_table(PIECES)
    for t in texts() + texts():   # the second time from the cache
        ids = code.encode(t)
        assert spm.decode_ids(ids, table) == t
        assert total(PIECES, t, ids) == pytest.approx(brute_best(PIECES, t)), t


def test_public_model_round_trips(spark, docs_of):
    pieces = spm.read_model()
    texts_ = texts() + ["The quick brown fox", "Ünïcödé straße"]
    got = spm.decode(spm.encode(docs_of(texts_), pieces), pieces).collect()
    assert all(r["decoded"] == r["text"] for r in got) and len(got) == len(texts_)
    assert all(0 <= i < 32000 for r in got for i in r["ids"])
    # known pieces decode to the same text as the library's decoder
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    plain = [r for r in got if r["text"] == "The quick brown fox"][0]
    assert sp.decode(list(plain["ids"])) == "The quick brown fox"


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(spm, "CACHE_WORDS", 5)
    code, table = spm.Encoder(PIECES), spm.decode_table(PIECES)
    text = " ".join("ab" * (i % 13) for i in range(100))
    assert spm.decode_ids(code.encode(text), table) == text and all(len(d) <= 6 for d in code.young + code.old)


def test_models_that_cannot_round_trip_are_refused():
    with pytest.raises(ValueError):
        spm.checked(spm.Pieces(["a"], [0.0], [0], [-1] * 256))
    with pytest.raises(ValueError):
        spm.checked(spm.Pieces(["a▁b"], [0.0], [0], list(range(256))))


def test_hostile_rows(spark, hostile):
    pieces = spm.read_model()
    got = spm.decode(spm.encode(hostile, pieces, out="ids"), pieces).collect()
    assert len(got) == 12 and all((r["text"] or "") == r["decoded"] for r in got)
    assert all(r["ids"] == [] for r in got if not r["text"])
    assert spm.encode(hostile.limit(0), pieces).count() == 0
