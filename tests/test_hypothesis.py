"""Parsers on generated strings: each string is built from a known answer and decoration, so the result follows from
how it was built."""

from hypothesis import HealthCheck, given, settings, strategies as st

from tagwright import constants as K
from tagwright.functions import labels as FL, text as FT

SPACE = st.text(alphabet=K.WS_CHARS, max_size=3)
NOISE = st.text(alphabet="abcxyz ,.!?中文é12]()", max_size=8)     # holds no opening bracket and spells no keyword
NUMBER = st.integers(0, 40)
FULL = str.maketrans(K.ASCII_DIGITS, K.FULLWIDTH_DIGITS)


@st.composite
def strict_answer(draw):
    """(text, class): a number alone, in brackets or with one of each kind; other text beside it makes it no answer."""
    n = draw(NUMBER)
    digits = draw(st.sampled_from([str(n), str(n).translate(FULL), "0" + str(n)]))
    core = draw(st.sampled_from(["{}", "[{}]", "({})", "[{})", "({}]"])).format(digits)
    spoil = draw(st.sampled_from(["", "", "", "x", "是", "[", "1 2", "-", "."]))
    return draw(SPACE) + core + draw(SPACE) + spoil, None if spoil else n


@st.composite
def model_output(draw):
    """(text, class): the first bracketed number decides, then the first keyword of the list, else nothing."""
    before, after = draw(NOISE), draw(NOISE)
    kind = draw(st.sampled_from(["number", "keyword", "both", "none"]))
    n = draw(NUMBER)
    bracket = "[" + draw(st.sampled_from([str(n), str(n).translate(FULL)])) + "]"
    word, cls = draw(st.sampled_from(K.LENIENT_KEYWORDS))
    word = draw(st.sampled_from([word, word.upper(), word.title()]))
    if kind == "number":
        return before + bracket + after + draw(st.sampled_from(["", "[2]", "[99]"])), n if n < K.NUM_CLASSES else -1
    if kind == "both":
        return draw(st.sampled_from([word + before + bracket, bracket + after + word])), n if n < K.NUM_CLASSES else -1
    if kind == "keyword":
        later = [w for w, _ in K.LENIENT_KEYWORDS[[w for w, _ in K.LENIENT_KEYWORDS].index(word.lower()):]]
        return before + draw(st.sampled_from(later)) * draw(st.integers(0, 1)) + " " + word + after, cls
    return before + draw(st.sampled_from(["", "[", "[]", "[x]"])), -1


@st.composite
def request_text(draw):
    """(text, message): what follows the first marker, without the white space around it."""
    message = draw(st.text(alphabet="abc中\n ", max_size=6)).strip() + draw(st.sampled_from(["", "x" + K.PROMPT_MARKER + "y"]))
    if draw(st.booleans()):
        return draw(NOISE) + K.PROMPT_MARKER + draw(SPACE) + message + draw(SPACE), message.strip()
    return draw(NOISE), K.EXTRACT_FALLBACK


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(strict_answer(), min_size=40, max_size=40), st.lists(model_output(), min_size=40, max_size=40),
       st.lists(request_text(), min_size=40, max_size=40))
def test_parsers_on_built_strings(spark, strict, lenient, messages):
    rows = [(i, s[0], o[0], m[0]) for i, (s, o, m) in enumerate(zip(strict, lenient, messages))]
    df = spark.createDataFrame(rows, "i int, s string, o string, m string")
    got = df.select("i", FL.parse_label_strict("s").alias("s"), FL.parse_label_lenient("o").alias("o"),
                    FT.extract_message("m").alias("m"), FT.clean_text("s").alias("c")).collect()
    for r in got:
        assert r.s == strict[r.i][1], strict[r.i]
        assert r.o == lenient[r.i][1], lenient[r.i]
        assert r.m == messages[r.i][1], messages[r.i]
        assert r.c == strict[r.i][0].strip().lower()
