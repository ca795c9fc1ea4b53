"""DuckDB SQL twins of the derived fixtures and functions, for the oracle check.

These strings are only ever run by DuckDB in the correctness check; the
library itself never parses or plans SQL.
"""

from __future__ import annotations

from tagwright import constants as K
from tagwright.functions.labels import BRACKET_PATTERN, STRICT_PATTERN
from tagwright.plans.fixtures import RESPONSE_CONTENT


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def U(tag: str, key: str = "doc_id") -> str:
    return f"(('0x'||substr(md5('{tag}:'||{key}),1,8))::UBIGINT::BIGINT / 4294967296.0::DOUBLE)"


def strip(x: str) -> str:
    return f"trim({x}, {lit(K.WS_CHARS)})"


def extract_message(x: str) -> str:
    m = lit(K.PROMPT_MARKER)
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN instr({x}, {m}) > 0 "
            f"THEN {strip(f'substring({x}, instr({x}, {m}) + {len(K.PROMPT_MARKER)})')} ELSE {lit(K.EXTRACT_FALLBACK)} END)")


def to_int(x: str) -> str:
    return f"TRY_CAST(translate({x}, {lit(K.OTHER_DIGITS)}, {lit(K.OTHER_DIGIT_VALUES)}) AS INTEGER)"


def strict(x: str) -> str:
    p = lit(STRICT_PATTERN)
    g = f"coalesce(nullif(regexp_extract({x}, {p}, 1), ''), nullif(regexp_extract({x}, {p}, 2), ''))"
    return f"(CASE WHEN regexp_matches({x}, {p}) THEN {to_int(g)} END)"


def lenient(x: str) -> str:
    p = lit(BRACKET_PATTERN)
    n = to_int(f"regexp_extract({x}, {p}, 1)")
    kws = " ".join(f"WHEN contains(lower({x}), {lit(w)}) THEN {c}" for w, c in K.LENIENT_KEYWORDS)
    return (f"CAST(CASE WHEN {x} IS NULL THEN -1 WHEN regexp_matches({x}, {p}) THEN "
            f"(CASE WHEN {n} BETWEEN 0 AND 3 THEN {n} ELSE -1 END) {kws} ELSE -1 END AS INTEGER)")


def prompt_infer(x: str, system: str = K.DEFAULT_SYSTEM_MESSAGE) -> str:
    return f"({lit(K.CHAT_SYSTEM_OPEN + system + K.CHAT_USER_OPEN)} || {x} || {lit(K.CHAT_ASSISTANT_OPEN)})"


def prompt_train(x: str, label: str, system: str = K.DEFAULT_SYSTEM_MESSAGE) -> str:
    return f"({prompt_infer(x, system)} || '[' || CAST({label} AS VARCHAR) || ']' || {lit(K.CHAT_TURN_END)})"


COMMENTS = ("SELECT doc_id, 'row-' || CAST(doc_id AS VARCHAR) AS custom_id, source AS username, "
            "text AS comment, source || '+' || text AS message FROM documents")

GOLD = (f"SELECT c.doc_id, c.custom_id, c.message, CAST(coalesce(2 * l.quality + l.toxic, -1) AS INTEGER) AS class "
        f"FROM ({COMMENTS}) c LEFT JOIN labels l ON c.doc_id = l.doc_id")

TRUTH = (f"SELECT doc_id, custom_id, message, CAST(CASE WHEN doc_id % 97 = 5 THEN 7 WHEN {U('y')} < 0.13 THEN 0 WHEN {U('y')} < 0.56 THEN 1 "
         f"WHEN {U('y')} < 0.65 THEN 2 ELSE 3 END AS INTEGER) AS true_label FROM ({COMMENTS}) c")

PREDS = (f"SELECT doc_id, custom_id, message, true_label, "
         f"CAST(CASE WHEN {U('v')} < 0.2 THEN -1 WHEN {U('b')} < 0.55 THEN true_label "
         f"ELSE CAST(floor(4 * {U('b2')}) AS INTEGER) END AS INTEGER) AS base_pred, "
         f"CAST(CASE WHEN doc_id % 89 = 3 THEN 7 WHEN {U('t')} < 0.8 THEN true_label ELSE CAST(floor(4 * {U('t2')}) AS INTEGER) END AS INTEGER) AS tuned_pred, "
         f"round(0.25 + 0.75 * {U('c')}, 6) AS confidence FROM ({TRUTH}) t")


def _json(cid: str, content: str) -> str:
    return (f"('{{\"custom_id\": \"' || {cid} || '\", \"response\": {{\"body\": {{\"choices\": "
            f"[{{\"message\": {{\"content\": \"' || {content} || '\"}}}}]}}}}}}')")


_CONTENTS = "[" + ", ".join(lit(c) for c in RESPONSE_CONTENT) + "]"
_CID = "('row-' || CAST(doc_id AS VARCHAR))"
_GOOD = f"CASE WHEN doc_id % 19 = 0 THEN '{{bad' ELSE {_json(_CID, f'{_CONTENTS}[doc_id % 12 + 1]')} END"
_NUMBER = f"""('{{"custom_id": "' || {_CID} || '", "response": {{"body": {{"choices": [{{"message": {{"content": 1}}}}]}}}}}}')"""
_NO_ID = """'{"response": {"body": {"choices": [{"message": {"content": "[1]"}}]}}}'"""
_DAMAGED = ("CASE doc_id % 29 WHEN 1 THEN good || ' done' WHEN 2 THEN good || good WHEN 3 THEN replace(good, '\"', chr(39)) "
            f"WHEN 4 THEN {_NUMBER} WHEN 5 THEN {_NO_ID} WHEN 6 THEN {_json(_CID, lit('[99999999999]'))} "
            "WHEN 7 THEN '' WHEN 8 THEN good || ', ' || good ELSE good END")
RESPONSES = (
    f"SELECT 2 * doc_id AS line_no, {_CID} AS custom_id, {_DAMAGED} AS raw FROM (SELECT doc_id, {_GOOD} AS good FROM documents) d "
    f"WHERE doc_id % 17 <> 0 "
    f"UNION ALL SELECT 2 * doc_id + 1 AS line_no, {_CID} AS custom_id, "
    f"{_json(_CID, 'CASE WHEN doc_id % 2 = 0 THEN ' + lit('[3]') + ' ELSE ' + lit('sorry') + ' END')} AS raw "
    f"FROM documents WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0"
)

_PATH = "'$.response.body.choices[0].message.content'"
PARSED = (
    "SELECT line_no, custom_id, content, class, ok, CASE WHEN NOT ok THEN 'bad_json' WHEN kind IS NULL OR kind = 'NULL' "
    f"THEN 'missing_content' WHEN content IS NULL THEN 'not_text' WHEN class IS NULL AND regexp_matches(content, {lit(STRICT_PATTERN)}) "
    "THEN 'out_of_range' WHEN class IS NULL THEN 'bad_format' WHEN custom_id IS NULL THEN 'missing_id' END AS reason FROM ("
    f"SELECT line_no, ok, custom_id, kind, content, {strict('content')} AS class FROM ("
    "SELECT line_no, ok, json_extract_string(raw, '$.custom_id') AS custom_id, "
    f"json_type(raw, {_PATH}) AS kind, "
    f"CASE WHEN json_type(raw, {_PATH}) = 'VARCHAR' THEN json_extract_string(raw, {_PATH}) END AS content "
    "FROM (SELECT line_no, coalesce(ok, false) AS ok, CASE WHEN ok THEN raw END AS raw FROM ("
    "SELECT line_no, CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END AS ok, raw "
    f"FROM ({RESPONSES}) r) r1) r2) a) b"
)

LAST_VALID = (f"SELECT custom_id, arg_max(class, line_no) AS class FROM ({PARSED}) p "
              "WHERE class IS NOT NULL AND custom_id IS NOT NULL GROUP BY custom_id")

_USER_MSG = f"({lit(K.DEFAULT_TEMPLATE)} || username || '+' || comment)"
UNLABELED = f"SELECT custom_id, {extract_message(_USER_MSG)} AS message, -1 AS class FROM ({COMMENTS}) c"

MERGED = (f"SELECT u.custom_id, u.message, CAST(coalesce(l.class, -1) AS INTEGER) AS class "
          f"FROM ({UNLABELED}) u LEFT JOIN ({LAST_VALID}) l ON u.custom_id = l.custom_id")

PURGED = f"SELECT * FROM ({MERGED}) m WHERE class <> -1"

HISTORY = ("SELECT run_id, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY day) AS INTEGER) AS epoch, m FROM ("
           "SELECT event_type AS run_id, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1, 2) e")

SPINE = "SELECT CAST(range AS INTEGER) AS class FROM range(4)"
