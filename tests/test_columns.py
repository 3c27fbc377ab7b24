import io

import pytest
from pyspark.sql import functions as F

from pathloom.functions import JsonPath, jsonpath_count, jsonpath_indices, jsonpath_many, jsonpath_nodes, jsonpath_spans, register
from pathloom.operators.nodes import node_table, select_nodes
from pathloom.plans import jsonpath_table, jsonpath_values, parsed_values, typed_matches
from pathloom.plans.table import corpus_count
from pathloom.sources import collect, discard, from_stdin, from_strings, read_documents, write_matches
from pathloom.streaming import start_matches

DOCS = ['{"a":[1,{"b":2,"a":[3]}],"b":{"b":null}}', "[[0,1,2],[3]]", " 7 ", "", None, '{"b":"x","c":[{"b":1.50},{"d":[]}]}']
PATHS = ["$", "$.a", "$..b", "$..*", "$[0]", "$..[0]", "$.*[1:]", "$..a..b", "$.c[*].b", "$[2:1]", "$..[::2]"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, json string").repartition(3)


@pytest.mark.parametrize("query", PATHS)
def test_result_modes_agree(docs, query):
    q = JsonPath.compile(query)
    rows = docs.select("id", "json", q.count("json").alias("n"), q.indices("json").alias("i"), q.spans("json").alias("s"), q.nodes("json").alias("m")).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        if r.json is None:
            assert r.n is r.i is r.s is r.m is None
            continue
        spans, raw = q.spans_of(r.json), r.json.encode()
        assert (r.n, r.i, [tuple(x) for x in r.s]) == (len(spans), [a for a, _ in spans], spans)
        assert [(m.seq, m.start_idx, m.end_idx, m.value) for m in r.m] == [(k, a, b, raw[a:b].decode()) for k, (a, b) in enumerate(spans)]
        assert all(m.kind == ("complex" if m.value[0] in "[{" else "atomic") for m in r.m)


@pytest.mark.parametrize("query", PATHS)
def test_node_table_gives_what_the_scanner_gives(docs, query):
    nodes = node_table(docs, "id", "json")
    got = {(r.doc, r.seq, r.start_idx, r.end_idx) for r in select_nodes(nodes, query).collect()}
    want = {(i, k, a, b) for i, d in enumerate(DOCS) if d is not None for k, (a, b) in enumerate(JsonPath.compile(query).spans_of(d))}
    assert got == want


@pytest.mark.parametrize("query", ["$..a..a", "$.*.*", "$..*..*", "$[*][1]", "$..a[1].b", "$.a[1]..b", "$..*[0]", "$.a.a", "$.c[1].d"])
def test_steps_over_the_node_table(docs, query):
    got = {(r.doc, r.seq, r.start_idx, r.end_idx) for r in select_nodes(node_table(docs, "id", "json"), query).collect()}
    assert got == {(i, k, a, b) for i, d in enumerate(DOCS) if d is not None for k, (a, b) in enumerate(JsonPath.compile(query).spans_of(d))}


def test_nodes_are_read_and_shuffled_once(docs):
    plan = select_nodes(node_table(docs, "id", "json"), "$.a[*]..b.*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("query", [p for p in PATHS if p != "$"])
def test_variant_gives_the_same_values(spark, docs, query):
    parsed = docs.select("id", F.try_parse_json("json").alias("v"))
    text = sorted((r.id, r.v) for r in jsonpath_values(docs, "id", "json", query).select("id", F.to_json("value").alias("v")).collect())
    assert sorted((r.id, r.v) for r in jsonpath_values(parsed, "id", "v", query).select("id", F.to_json("value").alias("v")).collect()) == text


PARSED = [*DOCS, '{"a":1,"a":{"b":2}}', '{"\\u0062":1,"b":2}', '{"b":"\\"c\\": d","\\"b":{"b":3}}', '{"b" : [null, true, {}, []]}', "null", '{"b":{"b":{"b":{"b":0}}}}']


@pytest.mark.parametrize("query", [*PATHS, "$..b..b", "$..b..*", "$.b.b", "$..[0]..b", "$.b[1:3]", "$['']"])
def test_parsed_text_gives_the_same_values(spark, query):
    df = spark.createDataFrame(list(enumerate(PARSED)), "id int, json string")
    kept = lambda rows: sorted((r.id, r.v) for r in rows.select("id", F.coalesce(F.to_json("value"), F.lit("?")).alias("v")).collect())
    assert kept(parsed_values(df, "id", "json", query)) == kept(jsonpath_values(df, "id", "json", query))


def test_parsed_text_stays_in_the_jvm_where_variant_can_hold_it(spark):
    plan = parsed_values(spark.createDataFrame([(1, "{}")], "id int, json string"), "id", "json", "$..b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # of the two branches, that of the documents that it can't


def test_variant_paths_of_more_steps_than_a_word_of_states(spark):
    for depth in (61, 62, 63, 130):
        text = '{"a":' * depth + "1" + "}" * depth
        df = spark.createDataFrame([(1, text)], "id int, json string").select("id", F.parse_json("json").alias("v"))
        for query, n in (("$" + "[*]" * depth, 1), ("$" + "..a" * depth, 1), ("$..*" + "[*]" * (depth - 1), 1), ("$" + "[*]" * depth + "..*", 0)):
            assert jsonpath_values(df, "id", "v", query).count() == n, (depth, query)


TYPE = "struct<a:array<struct<b:int,c:array<int>>>,m:map<string,struct<b:int>>,b:int>"
TYPED = ['{"a":[{"b":1,"c":[1,2,3]},{"b":2,"c":[4]},{"b":3,"c":[5,6]}],"m":{"x":{"b":7}},"b":8}', '{"b":9}']


@pytest.mark.parametrize("query", ["$.a[1].b", "$..b", "$.a[*].c[::2]", "$..c[1:]", "$..[0]", "$.m.x.b", "$.m.*", "$.a[1:].c[0]", "$..a..*", "$.nothing", "$..[0][1]", "$..[1:]..[0]", "$"])
def test_typed_columns_give_the_same_values(spark, query):
    df = spark.createDataFrame(list(enumerate(TYPED)), "id int, json string").select("id", "json", F.from_json("json", TYPE).alias("doc"))
    want = {r.id: [x for x in r.v] for r in df.select("id", F.transform(JsonPath.compile(query).nodes("json"), lambda m: F.to_json(F.parse_json(m["value"]))).alias("v")).collect()}
    got = {r.id: r.v for r in df.select("id", F.transform(typed_matches(df, "doc", query), lambda v: F.to_json(v)).alias("v")).collect()}
    if query == "$":
        assert all(len(v) == 1 for v in got.values())
    else:
        assert got == want


def test_names_are_pushed_to_the_reader_and_nested_columns_pruned(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "t"))
    found = jsonpath_table(spark.read.parquet(str(tmp_path / "t")), "json", "$.c[*].b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 'StringContains(json,"c")' in plan and 'StringContains(json,"b")' in plan
    assert [r.value for r in found.collect()] == ["1.50"]
    docs.select("id", F.from_json("json", TYPE).alias("doc")).write.parquet(str(tmp_path / "typed"))
    typed = spark.read.parquet(str(tmp_path / "typed"))
    plan = typed.select(typed_matches(typed, "doc", "$.a[*].b").alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc:struct<a:array<struct<b:int>>>>" in plan and "Python" not in plan
    root = docs.select(JsonPath.compile("$").spans("json"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in root and "Python" not in root


def test_errors_raise_or_give_null(spark):
    df = from_strings(spark, ['{"a":[1', '{"a":1}', '{"a":"'])
    q = JsonPath.compile("$.a[*]", errors="null")
    assert [r[0] for r in df.orderBy("doc_id").select(q.count("json")).collect()] == [None, 0, None]
    assert [r[0] and r[0].split("(")[0] for r in df.orderBy("doc_id").select(q.error("json")).collect()] == ["MissingClosingCharacter", None, "MalformedStringQuotes"]
    assert collect(jsonpath_table(df, "json", q)) == []
    with pytest.raises(Exception, match="MissingClosingCharacter|MalformedStringQuotes"):
        df.select(JsonPath.compile("$.a[*]").count("json")).collect()


def test_functions_and_sql(spark, docs):
    r = docs.where("id = 0").select(jsonpath_count("json", "$..b").alias("c"), jsonpath_indices("json", "$.b").alias("i"), jsonpath_spans("json", "$.b").alias("s"), jsonpath_nodes("json", "$.a[-1].a", mode="rfc").alias("n"), jsonpath_many("json", {"x": "$..b", "y": "$.zz"}).alias("m")).first()
    assert (r.c, r.i, [tuple(x) for x in r.s], [x.value for x in r.n], tuple(r.m)) == (3, [29], [(29, 39)], ["[3]"], (3, 0))
    assert jsonpath_table(docs, "json", "$..b", what="spans").count() == jsonpath_table(docs, "json", "$..b", what="indices").count() == 5
    assert corpus_count(docs, "json", "$..b").first().matches == 5
    many = docs.select("id", jsonpath_many("json", {"x": "$..b"}, "spans").alias("m")).where("id = 0").first()
    assert len(many.m.x) == 3
    register(spark)
    docs.createOrReplaceTempView("docs")
    assert spark.sql("SELECT sum(jsonpath_count(json, '$..b')) FROM docs").first()[0] == 5
    assert spark.sql("SELECT jsonpath_values(json, '$..b') v, jsonpath_indices(json, '$.b') i, size(jsonpath_spans(json, '$.b')) n FROM docs WHERE id = 0").first() == (["2", '{"b":null}', "null"], [29], 1)
    rows = spark.sql("SELECT id, n.seq, n.value FROM docs, LATERAL jsonpath_nodes(json, '$.c[?@.b].b') n").collect()
    assert [tuple(r) for r in rows] == [(5, 0, "1.50")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text('{\n "a": 1}\n')
    (tmp_path / "in/two.json").write_text('{"a": [2,\r\n3]}')
    (tmp_path / "lines").write_text('{"a":1}\n\n{"a":2}\n')
    for layout in ("file", "binary"):
        got = jsonpath_table(read_documents(spark, str(tmp_path / "in"), layout, force_input="mmap"), "json", "$.a").orderBy("path")
        assert collect(got) == ["1", "[2,\r\n3]"]
    assert sorted(collect(jsonpath_table(read_documents(spark, str(tmp_path / "lines"), "lines"), "json", "$.a"))) == ["1", "2"]
    found = jsonpath_table(from_stdin(spark, io.BytesIO(b'{"a":[1,2]}')), "json", "$.a[*]")
    discard(found)
    write_matches(found, str(tmp_path / "out"), order_by=["doc_id", "start_idx"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="layout"):
        read_documents(spark, "x", "csv")
    with pytest.raises(ValueError, match="force_input"):
        read_documents(spark, "x", force_input="none")
    with pytest.raises(TypeError):
        jsonpath_values(spark.range(1), "id", "id", "$")


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(f'{{"a":[{i},{{"b":{i}}}]}}')
    got = []
    stream = start_matches(read_documents(spark, str(tmp_path / "in"), streaming=True), "$..b", lambda df, _: got.extend(collect(df)), str(tmp_path / "ckpt"), available_now=True)
    stream.awaitTermination(60)
    assert sorted(got) == sorted(collect(jsonpath_table(read_documents(spark, str(tmp_path / "in")), "json", "$..b"))) == ["0", "1", "2"]


@pytest.mark.parametrize(
    ("args", "code", "out", "err"),
    [
        (["$..a", "--json", '{"a":[1, {"a":2}]}'], 0, '[1, {"a":2}]\n2\n', ""),
        (["$..a", "--json", '{"a":1}', "-r", "count"], 0, "1", ""),
        ([" $..a ", "--json", '{"a":1}', "--result", "indices"], 0, "5\n", ""),
        (["$[", "--json", "1"], 1, "", "error parsing the query"),
        (["$[-1]", "--json", "[1]"], 1, "", "not supported"),
        (["$[-1]", "--json", "[1]", "--mode", "rfc"], 0, "1\n", ""),
        (["$.a.*", "--json", '{"a":['], 1, "", "MissingClosingCharacter"),
        (["$.a", "-c"], 0, "digraph", ""),
    ],
)
def test_command_line(capfdbinary, args, code, out, err):
    from pathloom.__main__ import main

    assert main(args) == code
    got = capfdbinary.readouterr()
    assert got.out.decode().startswith(out) and (out == "digraph" or got.out.decode() == out)
    assert err in got.err.decode()


def test_command_line_on_files(spark, tmp_path, capfd):
    from pathloom.__main__ import _spark, arguments, main

    (tmp_path / "x.json").write_text('{"a":[1,2]}')
    for result, out in (("count", "2"), ("nodes", "1\n2\n"), ("indices", "6\n8\n")):
        args = arguments().parse_args(["$.a[*]", str(tmp_path / "x.json"), "-r", result])
        assert _spark(spark, JsonPath.compile(args.query), args) == 0
        assert capfd.readouterr().out == out
    args = arguments().parse_args(["$.a[*]", str(tmp_path / "absent.json")])
    assert _spark(spark, JsonPath.compile(args.query), args) == 1
    for bad in ([], ["$", "x", "--json", "1"], ["$", "x", "-c"]):
        with pytest.raises(SystemExit) as e:
            main(bad)
        assert e.value.code == 2


def test_variant_descent_is_not_bounded_by_the_nodes_of_the_table(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")  # else the table would need a million nodes
    try:
        df = spark.range(500).select("id", F.parse_json(F.lit('{"a": {"p": 1}, "b": [{"p": 2}]}')).alias("doc"))
        assert jsonpath_values(df, "id", "doc", "$..p").count() == 1000
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
