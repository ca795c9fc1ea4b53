"""Longest match against brute force over all prefixes, both ways of marking pieces, and the fixed-length arrays."""

import json
import random
import re

from pyspark.sql import functions as F

from tagwright.operators import subwords as SW

PIECES = ["[UNK]", "un", "##aff", "##able", "##a", "##ff", "a", "##b", "##le", "run", "##ning", "##n", ",", "好", "straße", "##e", "é"]


def brute(text, v):
    out = []
    for m in re.finditer(r"[㐀-䶿一-鿿豈-﫿]|[^\W㐀-䶿一-鿿豈-﫿]+|[^\w\s]", text or ""):
        word, at, own = m.group().lower(), 0, []
        while at < len(word) and own is not None:
            for end in range(len(word), at, -1):
                names = [(v.inside if at else "") + word[at:end] + v.final] if v.final and end == len(word) else []
                names += [(v.inside if at else "") + word[at:end]]
                hit = next((v.pieces[x] for x in names if x in v.pieces), None)
                if hit is not None:
                    own.append((hit, m.start() + at, m.start() + end))
                    at = end
                    break
            else:
                own = None
        out += own if own is not None and len(word) <= 100 else [(v.unknown, m.start(), m.end())]
    return out


def tokens(spark, texts, v, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, message string").withColumn("ids", F.lit("clash")).repartition(3)
    return [list(zip(r["ids"], r["starts"], r["ends"])) for r in SW.encode_subwords(df, v, **kw).orderBy("i").collect()]


def test_longest_match_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["un", "aff", "able", "a", "b", "run", "ning", "n", ",", "好", " ", "X", "é", "le", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(200)] + [None, "", "a" * 101, "a" + "n" * 99, "Unaffable RUNNING,好好 q"]
    prefix = SW.Vocabulary({p: i for i, p in enumerate(PIECES)}, 0)
    suffix = SW.Vocabulary({p: i for i, p in enumerate(["?", "un", "aff", "able</w>", "a", "a</w>", "b", "n</w>", "n", "run", "run</w>", "ning</w>", ",</w>", "好</w>"])}, 0, "", "</w>")
    for v in (prefix, suffix):
        got = tokens(spark, texts, v)
        assert got == [brute(t, v) for t in texts]
        assert any(t[0] == 0 for d in got for t in d) and any(len(d) > 3 for d in got)


def test_offsets_where_lower_case_is_longer(spark):
    v = SW.Vocabulary({"[UNK]": 0, "i": 1, "##̇": 2, "x": 3}, 0)
    assert tokens(spark, ["x İ x"], v) == [[(3, 0, 1), (1, 2, 3), (2, 2, 3), (3, 4, 5)]]


def test_files_and_fixed_length(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(PIECES))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b</w>": 1, "<end>": 2}, "end_of_word_suffix": "</w>"}}))
    v = SW.read_vocabulary(spark, str(tmp_path / "vocab.txt"), "[UNK]")
    assert v.pieces["##able"] == 3 and v.inside == "##" and v.unknown == 0
    j = SW.read_vocabulary(spark, str(tmp_path / "t.json"), "<end>")
    assert tokens(spark, ["ab aB a"], j) == [[(0, 0, 1), (1, 1, 2), (0, 3, 4), (1, 4, 5), (0, 6, 7)]]
    assert tokens(spark, ["a a a a"], v, limit=2) == [[(6, 0, 1), (6, 2, 3)]]
    e = spark.range(1).select(SW.fixed_length(F.array(F.lit(5), F.lit(6), F.lit(7)), 1, 2, 0, 4).alias("a"), SW.fixed_length(F.array(F.lit(5)), 1, 2, 0, 4).alias("b")).first()
    assert list(e["a"]["input_ids"]) == [1, 5, 6, 2] and list(e["b"]["input_ids"]) == [1, 5, 2, 0] and list(e["b"]["attention_mask"]) == [1, 1, 1, 0]
