"""Registered queries: character vocabulary and fixed-length encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.functions import encode as E, text as FT
from tagwright.operators import subwords as SW
from tagwright.plans import oracle as O
from tagwright.plans.q_split import SPLIT, TRAIN, split_df
from tagwright.plans.registry import register


def vocab(split):
    return E.char_vocabulary(split.where(F.col("split") == "train"), "message")


VOCAB = (f"SELECT ch AS char, n, CAST(row_number() OVER (ORDER BY n DESC, ch) + {K.END_ID} AS INTEGER) AS id FROM ("
         f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(message, '')) AS ch FROM ({TRAIN}) t "
         f"WHERE message <> '') x GROUP BY 1) c")


def ids_sql(src: str, text: str, limit: int | None) -> str:
    """custom_id -> list of ids of the first `limit` characters (all when None)."""
    n = f"least(length({text}), {limit})" if limit is not None else f"length({text})"
    pos = f"SELECT custom_id, {text} AS txt, unnest(range(1, {n} + 1)) AS pos FROM ({src}) s WHERE {text} <> ''"
    return (f"SELECT s.custom_id, coalesce(x.ids, []) AS ids FROM ({src}) s LEFT JOIN ("
            f"SELECT p.custom_id, list(coalesce(v.id, {K.UNK_ID}) ORDER BY p.pos) AS ids FROM ({pos}) p "
            f"LEFT JOIN ({VOCAB}) v ON substring(p.txt, p.pos, 1) = v.char GROUP BY p.custom_id) x ON s.custom_id = x.custom_id")


TEST = f"SELECT custom_id, message, class FROM ({SPLIT}) s WHERE split = 'test'"
L = K.CLASSIFIER_MAX_LEN


@register("char_vocabulary", VOCAB)
def q_char_vocabulary(spark, sf):
    return vocab(split_df(spark, sf))


@register("encode_fixed_length", f"""
SELECT custom_id, array_to_string(list_concat([{K.START_ID}], ids, [{K.END_ID}]), ',') || repeat(',{K.PAD_ID}', {L} - 2 - len(ids)) AS input_ids,
  CAST(len(ids) + 2 AS BIGINT) AS mask_sum, CAST({L} AS INTEGER) AS n, CAST(list_sum(ids) + {K.START_ID + K.END_ID} AS BIGINT) AS id_sum
FROM ({ids_sql(TEST, 'message', L - 2)}) e
""")
def q_encode_fixed_length(spark, sf):
    split = split_df(spark, sf)   # one split for the vocabulary and the texts
    test = split.where(F.col("split") == "test").select("custom_id", "message")
    ids = E.token_ids("message", E.vocabulary_dict(vocab(split)), L - 2)
    enc = test.select("custom_id", E.encode_fixed_length(ids, L).alias("e"))
    ids = F.col("e.input_ids")
    return enc.select("custom_id", F.array_join(ids, ",").alias("input_ids"),
                      F.aggregate(F.col("e.attention_mask"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                      F.size(ids).cast("int").alias("n"),
                      F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


TRAIN_PROMPTS = f"SELECT custom_id, {O.prompt_train('message', 'class')} AS prompt FROM ({TRAIN}) t"


@register("causal_labels", f"""
SELECT custom_id, CAST(len(ids) + 2 AS BIGINT) AS n_tokens, array_to_string(list_concat([{K.START_ID}], ids, [{K.END_ID}]), ',')
  || repeat(',{K.PAD_ID}', {K.LLM_MAX_LEN} - 2 - len(ids)) AS labels
FROM ({ids_sql(TRAIN_PROMPTS, 'prompt', K.LLM_MAX_LEN - 2)}) e
""")
def q_causal_labels(spark, sf):
    split = split_df(spark, sf)
    p = split.where(F.col("split") == "train").select("custom_id", FT.prompt_train("message", "class").alias("prompt"))
    ids = E.token_ids("prompt", E.vocabulary_dict(vocab(split)), K.LLM_MAX_LEN - 2)
    enc = p.select("custom_id", E.encode_fixed_length(ids, K.LLM_MAX_LEN).alias("e"))
    return enc.select("custom_id", F.aggregate("e.attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
                      F.array_join(E.causal_labels("e.input_ids"), ",").alias("labels"))


ANSWERS = f"SELECT custom_id, '[' || CAST(class AS VARCHAR) || ']' || {O.lit(K.CHAT_TURN_END)} AS answer FROM ({TRAIN}) t"


@register("strip_prompt_tokens", f"SELECT custom_id, array_to_string(ids, ',') AS generated_ids FROM ({ids_sql(ANSWERS, 'answer', None)}) a")
def q_strip_prompt_tokens(spark, sf):
    split = split_df(spark, sf)
    t = split.where(F.col("split") == "train")
    # a generation output is the input ids followed by the generated ids (here: the answer of the train prompt)
    answer = F.concat(F.lit("["), F.col("class").cast("string"), F.lit("]" + K.CHAT_TURN_END))
    p = t.select("custom_id", FT.prompt_infer("message").alias("prompt_in"), answer.alias("answer"))
    v = E.vocabulary_dict(vocab(split))
    d = p.select("custom_id", E.token_ids("prompt_in", v).alias("inp"), E.token_ids("answer", v).alias("gen"))
    d = d.select("custom_id", "inp", F.concat("inp", "gen").alias("out"))
    return d.select("custom_id", F.array_join(E.strip_prompt_tokens("inp", "out"), ",").alias("generated_ids"))


VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"   # a public vocabulary; any other file may be given


@register("encode_subwords")
def q_encode_subwords(spark, sf, path=VOCABULARY):
    """Fixed-length subword ids of the test rows, with the mask's sum, the unknown words and the end of the last token."""
    v = SW.read_vocabulary(spark, path, "<|endoftext|>")
    start, end = v.pieces["<|startoftext|>"], v.pieces["<|endoftext|>"]
    test = split_df(spark, sf).where(F.col("split") == "test").select("custom_id", "message")
    d = SW.encode_subwords(test, v, "message", L - 2)
    e = d.select("custom_id", "ids", "ends", SW.fixed_length("ids", start, end, end, L).alias("e"))
    return e.select("custom_id", F.array_join("e.input_ids", ",").alias("input_ids"),
                    F.aggregate("e.attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.size(F.filter("ids", lambda i: i == v.unknown)).alias("n_unknown"),
                    F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("last_end"))
