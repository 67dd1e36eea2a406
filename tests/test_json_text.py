"""JSON text columns against Python's own encoder, byte for byte."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.functions.json_text import indented_json, json_string

TEXTS = ["", "plain ~ text", 'a "quoted" \\ back', "tab\tline\nret\rff\fbs\b", "\x00\x01\x1f\x7f\x80", "é ü 日本 \u2028", "😀 mixed 𝔘 end", "/</"]


def test_strings(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(json_string(F.col("t"))).collect()] == [json.dumps(t) for t in TEXTS]


def test_nested_values(spark):
    ddl = ("n long, t string, flag boolean, words array<string>, m map<string,long>, "
           "s struct<a:string,inner:struct<x:int,l:array<string>>>, rows array<struct<k:string,v:long,z:array<int>>>")
    values = [
        (1, "x", True, ["a", None, "é"], {"k": 1, 'q"': 2}, ("a", (5, ["l"])), [("k", 2, [1, 2]), (None, None, [])]),
        (-9223372036854775808, None, False, [], {}, (None, (None, [])), []),
        (None, "", None, None, None, None, None),
        (7, "😀", True, [""], {"": 0}, ("", (0, ["a", "b"])), [("", 0, None)]),
    ]
    df = spark.createDataFrame(values, ddl)
    whole = df.select(F.struct("*").alias("v"))
    got = [r[0] for r in whole.select(indented_json(F.col("v"), whole.schema["v"].dataType)).collect()]
    want = [json.dumps(r.asDict(recursive=True), indent=2) for r in df.collect()]
    assert got == want


def test_other_types_are_refused():
    with pytest.raises(TypeError):
        indented_json(None, T.DoubleType())
