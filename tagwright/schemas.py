"""Explicit schemas for every table the workflow reads or writes (no inference)."""

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


LABELED = T.StructType([_f("custom_id", S), _f("message", S), _f("class", I)])

MESSAGE = T.StructType([_f("role", S), _f("content", S)])
REQUEST = T.StructType([
    _f("custom_id", S), _f("method", S), _f("url", S),
    _f("body", T.StructType([
        _f("model", S), _f("messages", T.ArrayType(MESSAGE)), _f("stream", B), _f("max_tokens", I),
    ])),
])
