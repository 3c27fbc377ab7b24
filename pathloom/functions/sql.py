"""The same for SQL: scalar functions, and a table function to use in LATERAL."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pathloom.functions.columns import NODE, SPAN, JsonPath

_NODE = pa.struct([("seq", pa.int32()), ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


@lru_cache(maxsize=256)
def _compiled(query: str, mode: str) -> JsonPath:
    return JsonPath.compile(query, mode)


class _Nodes:
    """jsonpath_nodes(json, path): a row for each match. Spark allows no Arrow table function in LATERAL, so it goes by rows."""

    def eval(self, json: str, path: str):
        if json is None or path is None:
            return
        raw = json.encode("utf-8", "surrogatepass")
        for seq, (a, b) in enumerate(_compiled(path, "rfc").spans_of(raw)):
            yield seq, a, b, "complex" if raw[a] in (123, 91) else "atomic", raw[a:b].decode("utf-8", "replace")


def register(spark: SparkSession) -> None:
    """Registers jsonpath_count, jsonpath_indices, jsonpath_spans, jsonpath_values and jsonpath_matches (json, path), and jsonpath_nodes.

    jsonpath_matches gives the rows of jsonpath_nodes as an array, for LATERAL VIEW inline(...), in Arrow batches. They execute the whole language. The path may be any expression; constant ones are compiled once in a worker.
    """
    def each(kind, build):
        @F.arrow_udf(kind)
        def run(documents: pa.Array, paths: pa.Array) -> pa.Array:
            out = []
            for d, p in zip(documents, paths, strict=True):
                raw = d.as_py().encode("utf-8", "surrogatepass") if d.is_valid and p.is_valid else None
                out.append(None if raw is None else build(raw, _compiled(p.as_py(), "rfc").spans_of(raw)))
            return pa.array(out, {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}.get(kind) or pa.list_(_NODE if kind == NODE else pa.struct([("start_idx", pa.int64()), ("end_idx", pa.int64())])))

        return run

    spark.udf.register("jsonpath_count", each("bigint", lambda raw, s: len(s)))
    spark.udf.register("jsonpath_indices", each("array<bigint>", lambda raw, s: [a for a, _ in s]))
    spark.udf.register("jsonpath_spans", each(SPAN, lambda raw, s: [{"start_idx": a, "end_idx": b} for a, b in s]))
    spark.udf.register("jsonpath_values", each("array<string>", lambda raw, s: [raw[a:b].decode("utf-8", "replace") for a, b in s]))
    node = lambda raw, k, a, b: {"seq": k, "start_idx": a, "end_idx": b, "kind": "complex" if raw[a] in (123, 91) else "atomic", "value": raw[a:b].decode("utf-8", "replace")}
    spark.udf.register("jsonpath_matches", each(NODE, lambda raw, s: [node(raw, k, a, b) for k, (a, b) in enumerate(s)]))
    fields = NODE.removeprefix("array<struct<").removesuffix(">>").replace(":", " ")
    spark.udtf.register("jsonpath_nodes", F.udtf(_Nodes, returnType=fields))
