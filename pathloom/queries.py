"""Queries over the test tables, one for each operator, and SQL that derives the same rows relationally.

Documents are built from the tables by joins: events.props as it is; orders with their line items; customers with their
orders and these' parts. The SQL never reads JSON paths: it answers from the tables the documents came from.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import JsonPath, jsonpath_many, register
from pathloom.lang import ParseError, PathBuilder, from_json, parse, to_json
from pathloom.operators.nodes import node_table, select_nodes
from pathloom.plans.table import corpus_count, jsonpath_table, jsonpath_values, parsed_values
from pathloom.sources import from_strings, read_documents, write_matches
from pathloom.streaming import start_matches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "props")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, json): {"a":{"a":{"a":<user_id>}}}."""
    text = F.concat(F.lit('{"a":{"a":{"a":'), F.col("user_id").cast("string"), F.lit("}}}"))
    return _table(spark, sf_dir, "events").select("event_id", text.alias("json"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, items): of each order its (n, p, s) in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(items.alias("items"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, json): {"o":1,"c":2,"lines":[{"n":1,"p":3},...]} of each order that has line items."""
    text = lambda x: F.concat(F.lit('{"n":'), x["n"].cast("string"), F.lit(',"p":'), x["p"].cast("string"), F.lit("}"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    json = F.concat(F.lit('{"o":'), F.col("o").cast("string"), F.lit(',"c":'), F.col("c").cast("string"), F.lit(',"lines":['), F.array_join(F.transform("items", text), ","), F.lit("]}"))
    return orders.join(_lines(spark, sf_dir), "o").select("o", json.alias("json"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, json): {"c":1,"os":[{"o":7,"ls":[<part>,...]},...]} of each customer that has such orders, in order of o."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    held = orders.join(_lines(spark, sf_dir), "o").select("c", "o", F.transform("items", lambda x: x["p"]).alias("ls"))
    text = lambda x: F.concat(F.lit('{"o":'), x["o"].cast("string"), F.lit(',"ls":['), F.array_join(F.transform(x["ls"], lambda p: p.cast("string")), ","), F.lit("]}"))
    per = held.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("o", "ls"))).alias("os"))
    json = F.concat(F.lit('{"c":'), F.col("c").cast("string"), F.lit(',"os":['), F.array_join(F.transform("os", text), ","), F.lit("]}"))
    return per.select("c", json.alias("json"))


def order_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, doc) with doc STRUCT<o, lines ARRAY<STRUCT<n, p>>, extra MAP>."""
    lines = F.transform("items", lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p")))
    extra = F.create_map(F.lit("n"), F.size("items"), F.lit("first"), F.col("items")[0]["n"])
    return _lines(spark, sf_dir).select("o", F.struct("o", lines.alias("lines"), extra.alias("extra")).alias("doc"))


def _matches(docs: DataFrame, key: str, query: str, column: str = "json", **options) -> DataFrame:
    """(key, seq, value) with value as a number."""
    return jsonpath_table(docs, column, query, [key], **options).select(key, "seq", F.col("value").cast("bigint").alias("value"))


Q: dict = {}
SQL: dict[str, str] = {}

#: Line items with their place in the order's list; customers' documents as (c, o, place of the order, place of the part).
_L = """l AS (SELECT l_orderkey o, l_linenumber n, l_partkey p,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 i,
  count(*) OVER (PARTITION BY l_orderkey) size FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_C = f"""{_L}, h AS (SELECT DISTINCT o_custkey c, o FROM l JOIN orders ON o = o_orderkey),
g AS (SELECT c, o, row_number() OVER (PARTITION BY c ORDER BY o) - 1 j FROM h),
cl AS (SELECT c, g.o, j, i, p FROM g JOIN l ON g.o = l.o)"""


def _q(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# result modes over events.props

_q("child_name", "SELECT event_id, 0::INT seq, strpos(props, '\"k\":') + 4 start_idx, strpos(props, '\"k\":') + 4 + length(props->>'k') end_idx, 'atomic' kind, props->>'k' AS value FROM events")(lambda s, d: jsonpath_table(events(s, d), "props", "$.k"))
_q("indices_child", "SELECT event_id, 0::INT seq, strpos(props, '\"k\":') + 4 start_idx FROM events")(lambda s, d: jsonpath_table(events(s, d), "props", "$.k", what="indices"))
_q("spans_child", "SELECT event_id, 0::INT seq, strpos(props, '\"k\":') + 4 start_idx, strpos(props, '\"k\":') + 4 + length(props->>'k') end_idx FROM events")(lambda s, d: jsonpath_table(events(s, d), "props", "$.k", what="spans"))
_q("approximate_spans", "SELECT event_id, strpos(props, '\"k\":') + 4 start_idx, strpos(props, '\"k\":') + 4 + length(props->>'k') <= end_idx ok FROM (SELECT *, length(props) end_idx FROM events)")(lambda s, d: events(s, d).select("event_id", F.inline(JsonPath.compile("$.k").approximate_spans("props")), "props").select("event_id", "start_idx", (F.col("end_idx") <= F.octet_length("props")).alias("ok")))
_q("root_count", "SELECT event_id, 1::BIGINT matches FROM events")(lambda s, d: events(s, d).select("event_id", JsonPath.compile("$").count("props").alias("matches")))
_q("root_nodes", "SELECT event_id, 0::INT seq, 1::BIGINT start_idx, (1 + length(props))::BIGINT end_idx, 'complex' kind, props AS value FROM events")(lambda s, d: jsonpath_table(events(s, d).withColumn("props", F.concat(F.lit("\n"), "props", F.lit(" \t"))), "props", "$"))
_q("empty_query", "SELECT event_id, 0::BIGINT matches FROM events")(lambda s, d: events(s, d).select("event_id", JsonPath.compile("$..[3:2]").count("props").alias("matches")))
_q("head_miss", "SELECT count(*) - count(*) AS matches FROM events")(lambda s, d: corpus_count(events(s, d), "props", "$..absent"))
_q("many", "SELECT event_id, 1::BIGINT root, 1::BIGINT k, 1::BIGINT everything, 0::BIGINT item FROM events")(lambda s, d: events(s, d).select("event_id", jsonpath_many("props", {"root": "$", "k": "$.k", "everything": "$..*", "item": "$[0]"}).alias("m")).select("event_id", "m.*"))
_q("nested_desc_set", "SELECT event_id, 0::INT seq, '{\"a\":' || user_id || '}' AS value FROM events UNION ALL SELECT event_id, 1, user_id::VARCHAR FROM events")(lambda s, d: jsonpath_table(chains(s, d), "json", "$..a..a").select("event_id", "seq", "value"))

# child steps over orders

_q("child_wildcard", f"WITH {_L} SELECT o, i::INT seq, p AS value FROM l")(lambda s, d: _matches(order_docs(s, d), "o", "$.lines[*].p"))
_q("child_index", f"WITH {_L} SELECT o, 0::INT seq, p AS value FROM l WHERE i = 0")(lambda s, d: _matches(order_docs(s, d), "o", "$.lines[0].p"))
_q("child_slice", f"WITH {_L} SELECT o, ((i - 1) // 2)::INT seq, p AS value FROM l WHERE i IN (1, 3)")(lambda s, d: _matches(order_docs(s, d), "o", "$.lines[1:4:2].p"))
_q("open_slice", f"WITH {_L} SELECT o, (i // 3)::INT seq, n::BIGINT AS value FROM l WHERE i % 3 = 0")(lambda s, d: _matches(order_docs(s, d), "o", "$.lines[::3].n"))
_q("desc_name", f"WITH {_L} SELECT o, i::INT seq, p AS value FROM l")(lambda s, d: _matches(order_docs(s, d), "o", "$..p"))
_q("count_by_doc", f"WITH {_L} SELECT o, (3 * count(*) + 3)::BIGINT matches FROM l GROUP BY o")(lambda s, d: order_docs(s, d).select("o", JsonPath.compile("$..*").count("json").alias("matches")))
_q("corpus_count", f"WITH {_L} SELECT count(*)::BIGINT matches FROM l WHERE i < 2")(lambda s, d: corpus_count(order_docs(s, d), "json", "$.lines[:2].n"))

# descendant steps over customers

_q("desc_wildcard", f"WITH {_C} SELECT c, kind, count(*) matches FROM (SELECT c, 'atomic' kind FROM cl UNION ALL SELECT c, 'atomic' FROM g UNION ALL SELECT DISTINCT c, 'atomic' FROM g UNION ALL SELECT c, 'complex' FROM g UNION ALL SELECT c, 'complex' FROM g UNION ALL SELECT DISTINCT c, 'complex' FROM g) GROUP BY ALL")(lambda s, d: jsonpath_table(customer_docs(s, d), "json", "$..*", ["c"]).groupBy("c", "kind").agg(F.count(F.lit(1)).alias("matches")))
_q("desc_index", f"WITH {_C} SELECT c, p AS value FROM cl WHERE i = 0")(lambda s, d: jsonpath_table(customer_docs(s, d), "json", "$..[0]", ["c"]).where("kind = 'atomic'").select("c", F.col("value").cast("bigint").alias("value")))
_q("desc_slice", f"WITH {_C} SELECT c, p AS value FROM cl WHERE i IN (1, 2)")(lambda s, d: jsonpath_table(customer_docs(s, d), "json", "$..[1:3]", ["c"]).where("kind = 'atomic'").select("c", F.col("value").cast("bigint").alias("value")))
_q("chained", f"WITH {_C} SELECT c, (row_number() OVER (PARTITION BY c ORDER BY j, i) - 1)::INT seq, p AS value FROM cl WHERE j IN (0, 2, 4) AND i = 1")(lambda s, d: _matches(customer_docs(s, d), "c", "$.os[:5:2]..ls[1]"))
_q("desc_after_desc", f"WITH {_C} SELECT c, (row_number() OVER (PARTITION BY c ORDER BY j, i) - 1)::INT seq, p AS value FROM cl")(lambda s, d: _matches(customer_docs(s, d), "c", "$..os..ls..*"))

# the node table

_q("node_table", f"WITH {_L} SELECT o, (4 + 3 * count(*))::BIGINT n, (4 + 3 * count(*) - 1)::INT last_id, 3::INT depth FROM l GROUP BY o")(lambda s, d: node_table(order_docs(s, d), "o", "json").groupBy(F.col("doc").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.max("last_desc_id").alias("last_id"), F.max("depth").alias("depth")))
_q("node_child", f"WITH {_L} SELECT o, ((i - 1) // 2)::INT seq, (4 + 3 * i + 2)::INT node_id FROM l WHERE i IN (1, 3)")(lambda s, d: select_nodes(node_table(order_docs(s, d), "o", "json"), "$.lines[1:4:2].p").select(F.col("doc").alias("o"), "seq", "node_id"))
_q("node_descendant", f"WITH {_L} SELECT o, i::INT seq, (4 + 3 * i + 2)::INT node_id FROM l")(lambda s, d: select_nodes(node_table(order_docs(s, d), "o", "json"), "$..lines..p").select(F.col("doc").alias("o"), "seq", "node_id"))

# VARIANT and typed columns


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return order_docs(s, d).select("o", F.parse_json("json").alias("doc"))


def _numbers(df: DataFrame) -> DataFrame:
    return df.select("o", F.try_variant_get("value", "$", "bigint").alias("value"))


_q("variant_child", f"WITH {_L} SELECT o, p AS value FROM l WHERE i = 1")(lambda s, d: _numbers(jsonpath_values(_parsed(s, d), "o", "doc", "$.lines[1].p")))
_q("variant_wildcard", f"WITH {_L} SELECT o, v AS value FROM (SELECT o, p v FROM l UNION ALL SELECT o, n FROM l)")(lambda s, d: _numbers(jsonpath_values(_parsed(s, d), "o", "doc", "$.lines[*].*")))
_q("variant_slice", f"WITH {_L} SELECT o, p AS value FROM l WHERE i IN (1, 3)")(lambda s, d: _numbers(jsonpath_values(_parsed(s, d), "o", "doc", "$.lines[1:4:2].p")))
_q("variant_descendant", f"WITH {_L} SELECT o, p AS value FROM l")(lambda s, d: _numbers(jsonpath_values(_parsed(s, d), "o", "doc", "$..lines..p")))
_q("parsed_descendant", f"WITH {_L} SELECT o, p AS value FROM l")(lambda s, d: _numbers(parsed_values(order_docs(s, d), "o", "json", "$..lines..p")))
_q("parsed_wildcard", f"WITH {_C} SELECT c, o AS value FROM g UNION ALL SELECT c, p FROM cl")(lambda s, d: parsed_values(customer_docs(s, d), "c", "json", "$.os[*]..*").select("c", F.try_variant_get("value", "$", "bigint").alias("value")).where("value IS NOT NULL"))
_q("typed_child", f"WITH {_L} SELECT o, p AS value FROM l WHERE i = 1")(lambda s, d: _numbers(jsonpath_values(order_structs(s, d), "o", "doc", "$.lines[1].p")))
_q("typed_slice", f"WITH {_L} SELECT o, n::BIGINT AS value FROM l WHERE i % 2 = 1")(lambda s, d: _numbers(jsonpath_values(order_structs(s, d), "o", "doc", "$.lines[1::2].n")))
_q("typed_descendant", f"WITH {_L} SELECT o, n::BIGINT AS value FROM l UNION ALL SELECT o, count(*) FROM l GROUP BY o")(lambda s, d: _numbers(jsonpath_values(order_structs(s, d), "o", "doc", "$..n")))
_q("typed_map", f"WITH {_L} SELECT o, v AS value FROM (SELECT o, count(*) v FROM l GROUP BY o UNION ALL SELECT o, n FROM l WHERE i = 0)")(lambda s, d: _numbers(jsonpath_values(order_structs(s, d), "o", "doc", "$.extra.*")))

# the whole language


def _rfc(name: str, query: str, where: str, value: str = "p") -> None:
    sql = f"WITH {_L} SELECT o, (row_number() OVER (PARTITION BY o ORDER BY i) - 1)::INT seq, {value}::BIGINT AS value FROM l WHERE {where}"
    _q(name, sql)(lambda s, d: _matches(order_docs(s, d), "o", query, mode="rfc"))


_rfc("rfc_index_from_end", "$.lines[-1].p", "i = size - 1")
_rfc("rfc_slice_from_end", "$.lines[-3:-1].p", "i >= size - 3 AND i < size - 1")
_rfc("rfc_slice_backward", "$.lines[3:0:-2].n", "i IN (SELECT unnest([least(3, size - 1), least(3, size - 1) - 2])) AND i > 0", "n")
_rfc("rfc_filter_compare", "$.lines[?@.p > 100 && @.n <= 3].p", "p > 100 AND n <= 3")
_rfc("rfc_filter_or_not", "$.lines[?@.n == 2 || !(@.p != 7 && @.p >= 50)].p", "n = 2 OR p = 7 OR p < 50")
_rfc("rfc_filter_exists", "$.lines[?@.p && !@.absent].n", "true", "n")
_rfc("rfc_filter_absolute", "$.lines[?@.p < $.c].p", "p < (SELECT o_custkey FROM orders WHERE o_orderkey = o)")
_rfc("rfc_filter_test_absolute", "$.lines[?$.lines[3]].p", "size > 3")
_rfc("rfc_filter_nested", "$[?@[?@.n == 4]][*].p", "o IN (SELECT o FROM l WHERE n = 4)")
_q("rfc_union", f"WITH {_L}, d AS (SELECT DISTINCT o, o_custkey c FROM l JOIN orders ON o = o_orderkey) SELECT o, 0::INT seq, o AS value FROM d UNION ALL SELECT o, 1, c FROM d")(lambda s, d: _matches(order_docs(s, d), "o", "$['c', 'o', 'o']", mode="rfc"))
_q("rfc_union_descendant", f"WITH {_L} SELECT o, (2 * i + k)::INT seq, CASE k WHEN 0 THEN n ELSE p END AS value FROM l, (SELECT unnest([0, 1]) k)")(lambda s, d: _matches(order_docs(s, d), "o", "$.lines..['p', 'n']", mode="rfc"))

# SQL


def _sql(s: SparkSession, d: str, text: str) -> DataFrame:
    register(s)
    return s.sql(text, docs=order_docs(s, d))


_q("sql_count", f"WITH {_L} SELECT o, count(*)::BIGINT matches FROM l GROUP BY o")(lambda s, d: _sql(s, d, "SELECT o, jsonpath_count(json, '$.lines[*]') AS matches FROM {docs}"))
_q("sql_udtf", f"WITH {_L} SELECT o, i::INT seq, p AS value FROM l")(lambda s, d: _sql(s, d, "SELECT o, n.seq, CAST(n.value AS bigint) AS value FROM {docs}, LATERAL jsonpath_nodes(json, '$..p') AS n"))
_q("sql_matches", f"WITH {_L} SELECT o, i::INT seq, p AS value FROM l")(lambda s, d: _sql(s, d, "SELECT o, seq, CAST(value AS bigint) AS value FROM {docs} LATERAL VIEW inline(jsonpath_matches(json, '$..p')) n AS seq, start_idx, end_idx, kind, value"))

# sources, sinks, streams and errors; what they store goes to the folder that all machines see


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, or in the warehouse where that is unset; deleted when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _lines_of_events(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "lines")
    events(spark, sf_dir).select("props").write.text(path)
    return path


def _files_of_regions(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The name of each region, from a file that holds its document and nothing else."""
    path = _folder(spark, "files")
    region = _table(spark, sf_dir, "region")
    text = F.concat(F.lit('{"r": {"key": '), F.col("r_regionkey").cast("string"), F.lit(', "name": "'), "r_name", F.lit('"}}'))
    region.select(text.alias("json"), F.col("r_regionkey").alias("file")).repartition("file").write.partitionBy("file").text(path)
    return jsonpath_table(read_documents(spark, f"{path}/file=*", layout), "json", "$..name", []).select("seq", "value")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "matches")
    write_matches(jsonpath_table(events(spark, sf_dir), "props", "$.k"), path)
    return spark.read.text(path)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, out = read_documents(spark, _lines_of_events(spark, sf_dir), "lines", streaming=True), _folder(spark, "streamed")
    put = lambda matches, batch: matches.select("seq", "value").write.mode("overwrite").parquet(f"{out}/batch={batch}")
    start_matches(documents, "$.k", put, _folder(spark, "progress"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("seq", "value")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with every third document cut before its last bracket."""
    whole = F.col("event_id") % 3 != 0
    return events(spark, sf_dir).withColumn("props", F.when(whole, F.col("props")).otherwise(F.expr("substring(props, 1, length(props) - 1)")))


_q("source_lines", "SELECT 0::INT seq, props->>'k' AS value FROM events")(lambda s, d: jsonpath_table(read_documents(s, _lines_of_events(s, d), "lines"), "json", "$.k", []).select("seq", "value"))
_q("source_files", "SELECT 0::INT seq, '\"' || r_name || '\"' AS value FROM region")(lambda s, d: _files_of_regions(s, d, "file"))
_q("source_binary", "SELECT 0::INT seq, '\"' || r_name || '\"' AS value FROM region")(lambda s, d: _files_of_regions(s, d, "binary"))
_q("source_strings", "SELECT * FROM (VALUES (0::BIGINT, 0::INT, '1'), (0::BIGINT, 1, '[2,{\"a\":3}]'), (0::BIGINT, 2, '3'), (1::BIGINT, 0, 'null')) t (doc_id, seq, value)")(lambda s, d: jsonpath_table(from_strings(s, ['{"a":1,"b":{"a":[2,{"a":3}]}}', b' {"a" : null} ', "[]"]), "json", "$..a").select("doc_id", "seq", "value"))
_q("sink_text", "SELECT props->>'k' AS value FROM events")(_written)
_q("stream_lines", "SELECT 0::INT seq, props->>'k' AS value FROM events")(_streamed)
_q("error_column", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'MissingClosingCharacter' END AS error FROM events")(lambda s, d: _broken(s, d).select("event_id", F.regexp_extract(JsonPath.compile("$..*").error("props"), r"^\w+", 0).alias("error")))
_q("errors_null", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 1::BIGINT END AS matches FROM events")(lambda s, d: _broken(s, d).select("event_id", JsonPath.compile("$..*", errors="null").count("props").alias("matches")))
_q("stored_query", f"WITH {_L} SELECT o, ((i - 1) // 2)::INT seq, p AS value FROM l WHERE i IN (1, 3)")(lambda s, d: _matches(order_docs(s, d), "o", JsonPath.compile(from_json(to_json(parse("$.lines[1:4:2].p"))))))

# the language itself: rows that the driver makes


def _values(rows: list[tuple], names: str) -> str:
    """SQL for rows of strings and integers."""
    text = ", ".join("(" + ", ".join(f"{v}::INT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) t ({names})"


#: Queries and their canonical text.
_TEXTS = [
    ("$", "$"),
    ("$.a", "$['a']"),
    ("$ ..b[ 'c' , * ]", "$..['b']['c', *]"),
    ("$[0:5:1]", "$[:5]"),
    ("$[::-1]", "$[::-1]"),
    ('$["it\'s"]', "$['it\\'s']"),
    ("$[?(@.a==1e2)]", "$[?@['a'] == 100]"),
    ("$[?!(@.a>1||$.b)&&@.c]", "$[?!(@['a'] > 1 || $['b']) && @['c']]"),
]
#: Queries with the kind of their error, its byte position and length.
_ERRORS = [
    ("a", "MISSING_ROOT_IDENTIFIER"),
    ("$[01]", "LEADING_ZEROS"),
    ("$[-0]", "NEGATIVE_ZERO_INTEGER"),
    ("$['a", "MISSING_CLOSING_SINGLE_QUOTE"),
    ("$[?!@.a == 1]", "INVALID_NEGATION"),
    ("$[?@.* == 1]", "NON_SINGULAR_QUERY_IN_COMPARISON"),
    (" $", "DISALLOWED_LEADING_WHITESPACE"),
]


def _kind_of_error(query: str) -> str:
    try:
        parse(query)
    except ParseError as e:
        return e.errors[0].kind.name
    return "none"


_q("canonical_text", _values(_TEXTS, "query, text"))(lambda s, d: s.createDataFrame([(q, str(parse(q))) for q, _ in _TEXTS], "query string, text string"))
_q("syntax_errors", _values(_ERRORS, "query, kind"))(lambda s, d: s.createDataFrame([(q, _kind_of_error(q)) for q, _ in _ERRORS], "query string, kind string"))
_q("built_query", f"WITH {_L} SELECT o, (row_number() OVER (PARTITION BY o ORDER BY i) - 1)::INT seq, n::BIGINT AS value FROM l WHERE i % 2 = 0")(lambda s, d: _matches(order_docs(s, d), "o", JsonPath(PathBuilder().child_name("lines").child(lambda b: b.slice(step=2)).child_name("n").to_query())))
