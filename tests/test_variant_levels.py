"""VARIANT documents are walked without their text being made, as long as they are shallow."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.plans.variant import variant_values


def _nested(levels: int):
    doc = {"p": levels}
    for k in range(levels):
        doc = {"p": k, "a": [doc]} if k % 3 else [doc, "[{"]
    return doc


def _all(doc, name: str) -> list:
    below = list(doc.items()) if isinstance(doc, dict) else [(None, v) for v in doc] if isinstance(doc, list) else []
    return [v for k, v in below if k == name] + [x for _, v in below for x in _all(v, name)]


@pytest.mark.parametrize("levels", [0, 1, 2, 3, 4, 5, 6, 7, 25])
def test_documents_of_any_depth_are_walked_to_their_end(spark, levels):
    doc = _nested(levels)
    df = spark.createDataFrame([(json.dumps(doc),)], "json string").select(F.parse_json("json").alias("doc"))
    got = df.select(F.transform(variant_values("doc", "$..p"), lambda v: F.to_json(v)).alias("found")).first().found
    assert sorted(map(int, got)) == sorted(_all(doc, "p"))


def test_a_text_is_made_once_at_most_and_after_the_first_levels(spark):
    df = spark.createDataFrame([('{"a":{"p":1}}',)], "json string").select(F.parse_json("json").alias("doc"))
    plan = df.select(variant_values("doc", "$..a..p").alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("to_json(") == 1 and plan.index("to_json(") > plan.index("size(")
