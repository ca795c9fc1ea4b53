"""Golden semantics of the scalar functions (parsers, message recovery, strip)."""

import pytest

from tagwright import constants as K
from tagwright.functions import labels as FL, text as FT, vectors as V

IDEO = "　"
# input, strict (None = invalid), lenient
GOLDEN = [
    ("[1]", 1, 1), ("(2)", 2, -1), ("3", 3, -1), (" [1)\n", 1, -1), ("[ 1 ]", None, -1), ("[7]", 7, -1),
    ("[7] negative", None, -1), ("It is [2], not [0]", None, 2), ("It is 1", None, -1), ("Not Negative", None, 2),
    ("mild, not positive", None, 0), ("Neutral", None, 1), ("[ERROR]", None, -1), ("", None, -1),
    (f"{IDEO}[1]{IDEO}", 1, 1), ("[１]", 1, 1), ("12345678901", None, -1), ("irrelevant!", None, 3),
    ("[١]", 1, 1), ("(२)", 2, -1), ("٣", 3, -1), ("it is [०]", None, 0), ("[𝟏𝟎]", 10, -1), ("[²]", None, -1), ("[一]", None, -1),
    ("(1]", 1, -1), ("007", 7, -1), ("[10]", 10, -1),
]


def test_parsers_golden(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(GOLDEN)], "i int, s string")
    got = {r.i: (r.strict, r.lenient) for r in df.select(
        "i", FL.parse_label_strict("s").alias("strict"), FL.parse_label_lenient("s").alias("lenient")).collect()}
    for i, (s, strict, lenient) in enumerate(GOLDEN):
        assert got[i] == (strict, lenient), (s, got[i])


def test_parsers_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(FL.parse_label_strict("s").alias("a"), FL.parse_label_lenient("s").alias("b")).first()
    assert r.a is None and r.b == -1


@pytest.mark.parametrize("text,expected", [
    ("prompt " + K.PROMPT_MARKER + "  user+hello\n", "user+hello"),
    ("no marker here", K.EXTRACT_FALLBACK),
    (K.PROMPT_MARKER + "a" + K.PROMPT_MARKER + "b", "a" + K.PROMPT_MARKER + "b"),  # first marker wins
    (K.PROMPT_MARKER + IDEO + "x y" + IDEO + "\n", "x y"),
    (K.PROMPT_MARKER, ""),
    ("line1\n" + K.PROMPT_MARKER + "multi\nline\n\n", "multi\nline"),
])
def test_extract_message(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(FT.extract_message("s").alias("m")).first().m == expected


def test_strip_matches_python(spark):
    samples = [" a ", "\t\nb\x0b\x0c\r", " c ", "　d　", "\x1ce\x1f", "​f", "g\u0085"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.x for r in df.select(FT.strip_ws("s").alias("x")).collect()]
    assert got == [s.strip() for s in samples]


def test_prompts(spark):
    df = spark.createDataFrame([("hi", 2)], "m string, c int")
    r = df.select(FT.prompt_infer("m", "SYS").alias("a"), FT.prompt_train("m", "c", "SYS").alias("b")).first()
    assert r.a == ("<|im_start|>system\nSYS<|im_end|>\n<|im_start|>user\nClassify this comment: \"hi\"<|im_end|>\n"
                   "<|im_start|>assistant\n")
    assert r.b == r.a + "[2]<|im_end|>"


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],), ([0.0, 0.0, 0.0, 0.0],)], "a array<double>")
    rows = df.select(V.softmax("a").alias("p"), V.argmax("a").alias("k")).collect()
    for r in rows:
        assert abs(sum(r.p) - 1.0) < 1e-12
    assert rows[0].k == 1 and rows[1].k == 0
