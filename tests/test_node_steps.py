"""Steps over the node table: what they select, and how often they sort."""

import json
import random

import pytest

from pathloom.lang import parse
from pathloom.operators.nodes import node_table, select_nodes
from pathloom.operators.tree import Evaluator


def _value(r: random.Random, depth: int):
    kind = r.random() if depth else 1
    if kind < 0.45:
        return {k: _value(r, depth - 1) for k in r.sample("abc", r.randint(0, 3))}
    if kind < 0.8:
        return [_value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([1, "a", None, "\\"])


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [(i, json.dumps(_value(r, 5))) for i in range(200)]


@pytest.fixture(scope="module")
def nodes(spark, texts):
    return node_table(spark.createDataFrame(texts, "id int, json string").repartition(3), "id", "json").cache()


@pytest.mark.parametrize("query", ["$", "$.a", "$.a.b", "$.a[1:4:2].b", "$.*.*.*", "$.a..b.a", "$..a.b", "$.*..*.a..*", "$['a','b'][0,1]", "$..[0]..a.b"])
def test_steps_select_what_the_evaluator_does(nodes, texts, query):
    run = Evaluator(parse(query))
    want = {(i, k, *span) for i, text in texts for k, span in enumerate(run.spans(text.encode()))}
    assert {(r.doc, r.seq, r.start_idx, r.end_idx) for r in select_nodes(nodes, query).collect()} == want


@pytest.mark.parametrize("query", ["$.a[1:4:2].b", "$.*.*.*.*", "$..a..b", "$.a[0]..b..c"])
def test_steps_share_one_sort_of_the_candidates(spark, query):
    docs = spark.createDataFrame([(1, "{}")], "id int, json string")
    plan = select_nodes(node_table(docs, "id", "json"), query)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_descendants_over_plain_and_other_documents_together(spark):
    plain, other = '{"o":1,"lines":[{"n":1,"p":3},{"p":{"p":4}}]}', '{"o":"\\\\","lines":[{"p":3 4}]} x'
    docs = spark.createDataFrame([(k, (plain, other, None)[k % 3]) for k in range(12)], "id int, json string").coalesce(1)
    nodes, run = node_table(docs, "id", "json"), Evaluator(parse("$..lines..p"))
    want = {(r.id, k, *span) for r in docs.collect() if r.json for k, span in enumerate(run.spans(r.json.encode()))}
    assert {(r.doc, r.seq, r.start_idx, r.end_idx) for r in select_nodes(nodes, "$..lines..p").collect()} == want
    plan = select_nodes(nodes, "$..lines..p")._jdf.queryExecution().optimizedPlan().toString()
    assert "node_id#" in plan and "_step0" not in plan  # the first step is done as the nodes are read


def test_parts_of_the_candidates_are_not_merged(spark):
    docs = spark.createDataFrame([(k, '{"a":{"b":1}}') for k in range(50)], "id int, json string")
    found = select_nodes(node_table(docs, "id", "json"), "$.a.b")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
