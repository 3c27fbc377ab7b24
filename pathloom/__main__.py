"""python -m pathloom QUERY [FILE]: runs a query on a file, on text given inline, or on standard input."""

from __future__ import annotations

import argparse
import sys

from pathloom import __version__
from pathloom.errors import CompilerError, JsonPathRuntimeError, QueryTooComplexError, UnsupportedFeatureError
from pathloom.functions.columns import JsonPath
from pathloom.lang import ParseError, RecursionLimitError


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description="Run a JSONPath query on JSON documents with Spark.")
    p.add_argument("query", metavar="QUERY", help="JSONPath query to run")
    p.add_argument("file_path", metavar="FILE_PATH", nargs="?", help="file, folder or glob to query; standard input if none is given")
    p.add_argument("--json", help="inline JSON to query")
    p.add_argument("-v", "--verbose", action="store_true", help="say on standard error how the query is executed")
    p.add_argument("-c", "--compile", action="store_true", help="print the automaton in the Graphviz language and end")
    p.add_argument("-r", "--result", choices=("count", "indices", "nodes"), default="nodes", help="what to print (default: nodes)")
    p.add_argument("--force-input", choices=("mmap", "eager", "buffered"), help="input strategy; accepted for compatibility")
    p.add_argument("--layout", choices=("file", "lines", "binary"), default="file", help="whether a file or a line is a document")
    p.add_argument("--mode", choices=("compat", "rfc"), default="compat", help="rfc executes the whole language")
    p.add_argument("-V", "--version", action="version", version=f"pathloom {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    args = parser.parse_args(argv)
    if args.json is not None and args.file_path is not None:
        parser.error("--json cannot be used with FILE_PATH")
    if args.compile and (args.file_path is not None or args.json is not None):
        parser.error("--compile cannot be used with an input")
    try:
        query = JsonPath.compile(args.query, args.mode, allow_surrounding_whitespace=True)
        if args.verbose:
            print(f"query: {query}; executed by {'the automaton' if query.automaton is not None else 'tree walk'}", file=sys.stderr)
        if args.compile:
            print(query.to_dot())
            return 0
    except (ParseError, RecursionLimitError) as e:
        print(f"error parsing the query:\n\n{e}", file=sys.stderr)
        return 1
    except QueryTooComplexError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (UnsupportedFeatureError, CompilerError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.file_path is None:
        return _local(query, args)
    from pyspark.sql import SparkSession

    return _spark(SparkSession.builder.appName("pathloom").getOrCreate(), query, args)


def _local(query: JsonPath, args: argparse.Namespace) -> int:
    """One document that the driver holds needs no cluster."""
    raw = args.json.encode("utf-8", "surrogateescape") if args.json is not None else sys.stdin.buffer.read()
    try:
        spans = query.spans_of(raw)
    except JsonPathRuntimeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    out = sys.stdout.buffer
    if args.result == "count":
        out.write(str(len(spans)).encode())
    else:
        for a, b in spans:
            out.write((raw[a:b] if args.result == "nodes" else str(a).encode()) + b"\n")
    out.flush()
    return 0


def _spark(spark, query: JsonPath, args: argparse.Namespace) -> int:
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from pathloom.plans.table import jsonpath_table
    from pathloom.sources.readers import read_documents

    try:
        docs = read_documents(spark, args.file_path, args.layout, args.force_input)
        if args.result == "count":
            total = docs.agg(F.coalesce(F.sum(query.count("json")), F.lit(0))).first()[0]
            print(total, end="")
        else:
            what, column = ("nodes", "value") if args.result == "nodes" else ("indices", "start_idx")
            for row in jsonpath_table(docs, "json", query, ["path"], what).select(column).toLocalIterator():
                print(row[0])
    except PySparkException as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
