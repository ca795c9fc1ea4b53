"""Fixed values that results depend on.

Everything in the first block is a fixed value that must stay exactly as
written for results to match the labelling/evaluation workflow this package
reproduces (class ids and names, request fields, prompt marker, chat
template pieces, keyword order of the lenient parser, split sizes).
"""

import sys
import unicodedata

# ---- fixed values -------------------------------------------------------
CLASS_NAMES = ["Positive", "Mild", "Negative", "Irrelevant"]  # ids 0, 1, 2, 3
UNLABELED = -1
PROMPT_MARKER = "现在请处理：\nInput:"
EXTRACT_FALLBACK = "Error: Could not extract message"
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"
REQUEST_MODEL = "deepseek-ai/DeepSeek-V3"
REQUEST_SYSTEM = "You are a highly advanced AI assistant that classifies comments."
REQUEST_STREAM = True
REQUEST_MAX_TOKENS = 20
ERROR_OUTPUT = "[ERROR]"
# lenient parser: keywords tried in this order on the lower-cased text
LENIENT_KEYWORDS = [("positive", 0), ("mild", 1), ("neutral", 1), ("negative", 2), ("irrelevant", 3)]
CHAT_SYSTEM_OPEN = "<|im_start|>system\n"
CHAT_USER_OPEN = "<|im_end|>\n<|im_start|>user\nClassify this comment: \""
CHAT_ASSISTANT_OPEN = "\"<|im_end|>\n<|im_start|>assistant\n"
CHAT_TURN_END = "<|im_end|>"
SPLIT_SEED = 42
TEST_FRACTION = (1, 5)        # test = ceil(N / 5)
VALIDATION_FRACTION = (1, 8)  # validation = ceil(rest / 8)
CLASSIFIER_MAX_LEN = 128
LLM_MAX_LEN = 512
CLASSIFIER_BATCH = 32
LLM_BATCH = 4
PATIENCE = 3
TOP_MISTAKES = 20
# ---- end of fixed values -------------------------------------------------

NUM_CLASSES = len(CLASS_NAMES)

# Our own default labelling prompt (the original prompt file is not public);
# only its tail, the marker, matters for message recovery.
DEFAULT_TEMPLATE = (
    "Classify the comment into one of four classes and answer with the class id "
    "in square brackets: [0] Positive, [1] Mild, [2] Negative, [3] Irrelevant.\n"
    + PROMPT_MARKER
)
DEFAULT_SYSTEM_MESSAGE = (
    "You label social-media comments. Classes: 0 Positive, 1 Mild, 2 Negative, "
    "3 Irrelevant. Answer with the class id in square brackets."
)

# Unicode whitespace exactly as CPython's str.strip / \s, written as an explicit
# class that Java regex and RE2 read the same way.
WS_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same 29 code points as a plain set, for trim(BOTH ... FROM s): strips only the ends, no regex scan.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
# Every decimal digit of Unicode (category Nd) beyond ASCII, and its value; each script has ten in a row.
OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
OTHER_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)
DIGIT_CLASS = "[0-9" + "".join(f"\\x{{{ord(c):x}}}-\\x{{{ord(c) + 9:x}}}" for c in OTHER_DIGITS if unicodedata.digit(c) == 0) + "]"

# Special ids of the character encoder.
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3
