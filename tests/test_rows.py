"""Records as rows with their body: numbers and JSON."""

from __future__ import annotations

import json
import math
import random
import struct
from decimal import Decimal

from pyspark.sql import functions as F

from tracewright.functions import derive
from tracewright.functions.encoding import KINDS
from tracewright.plans import corpus


def test_plain_numbers(spark):
    r = random.Random(8)
    some = [0.0, -0.0, 1.0, 2.5, 1e21, 1e23, 2.82879384806159e17, 1e-7, 5e-324, 1.7976931348623157e308, -1234567.125, 0.1 + 0.2, 9007199254740993.0]
    some += [x for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(300)) if math.isfinite(x)]
    got = [x[0] for x in spark.createDataFrame(list(enumerate(some)), "i int, x double").orderBy("i").select(derive.plain_number(F.col("x"))).collect()]

    def want(x):
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text

    assert got == [want(x) for x in some] and got[:5] == ["0", "-0", "1", "2.5", "1" + "0" * 21]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(derive.plain_number(F.col("x")).alias("t"))
    assert {x["t"] for x in odd.collect()} == {"NaN", "inf", "-inf", None}


def test_body_json(spark):
    def body(kind, **fields):
        made = corpus.struct_of(kind, **fields)
        return F.struct(*[(made if k == kind else F.lit(None).cast(corpus.BODIES[k])).alias(k) for k in KINDS]).cast(corpus.BODY)

    told = lambda kind, b: json.loads(spark.range(1).select(derive.body_json(F.lit(kind), b)).first()[0])
    number = lambda x: F.lit(x).cast("double")
    none = F.lit(None).cast("string")
    text = 'a"b\\\n\t/é😀'
    assert told("file", body("file", path=F.lit(text), media_type=none)) == {"file": {"path": text, "media_type": None}}
    clip = body("clip", sources=F.array(F.lit("s")), in_point=number(float("nan")), out_point=number(float("inf")), duration=number(1e-7), path=F.lit("p"))
    assert told("clip", clip) == {"clip": {"sources": ["s"], "in_point": None, "out_point": None, "duration": 1e-7, "path": "p"}}
    assert told("event", body("event", when=F.lit("1"), where=F.lit("2"), who=F.lit("3"))) == {"event": {"when": "1", "where_": "2", "who": "3"}}
    steps = F.array(F.struct(F.lit("x").alias("text"), F.lit(True).alias("done")))
    assert told("procedure", body("procedure", steps=steps)) == {"procedure": {"steps": [{"text": "x", "done": True}]}}
    assert spark.range(1).select(derive.body_json(F.lit("unknown"), body("procedure", steps=steps))).first()[0] is None


def test_fields_are_those_of_the_records(spark):
    schema = spark.createDataFrame([], f"body {corpus.BODY}").schema["body"].dataType
    assert {k: set(v) for k, v in derive.BODY_FIELDS.items()} == {f.name: set(f.dataType.names) for f in schema.fields}
