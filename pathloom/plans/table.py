"""From a column to a table of matches; the way there is chosen by the column's type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

from pathloom.automaton import check_supported
from pathloom.functions.columns import JsonPath
from pathloom.lang import parse
from pathloom.lang.ast import Path
from pathloom.plans.typed import typed_matches
from pathloom.plans.variant import variant_matches


def jsonpath_table(df: DataFrame, column: str, query: str | Path | JsonPath, keep: list[str] | None = None, what: str = "nodes", **options) -> DataFrame:
    """A row for each match of query in a column of JSON text, after the columns in keep (all but column, if not named).

    what "nodes" adds seq, start_idx, end_idx, kind and value; "spans" seq, start_idx and end_idx; "indices" seq and
    start_idx. Documents without the names that the query needs are filtered before they are read by the scanner, and
    before they leave a Parquet reader where it can tell. Nothing is shuffled; rows of one document stay in order.
    """
    q = query if isinstance(query, JsonPath) else JsonPath.compile(query, **options)
    keep = [c for c in df.columns if c != column] if keep is None else keep
    if q.is_empty:
        df = df.where(F.lit(False))
    elif (must := q.prefilter(column)) is not None:
        df = df.where(must)
    if what == "nodes":
        return df.select(*keep, F.inline(q.nodes(column)))
    if what == "spans":
        return df.select(*keep, F.posexplode(q.spans(column)).alias("seq", "_s")).select(*keep, "seq", "_s.start_idx", "_s.end_idx")
    if what == "indices":
        return df.select(*keep, F.posexplode(q.indices(column)).alias("seq", "start_idx"))
    raise ValueError("what is nodes, spans or indices")


def jsonpath_values(df: DataFrame, id_col: str, column: str, query: str | Path) -> DataFrame:
    """(id_col, value): the matched values as VARIANT, from a typed, VARIANT or text column.

    Typed columns are unrolled over their schema, VARIANT columns queried by variant functions; text is scanned, and
    each matched text parsed (null where it is no valid JSON). parsed_values() is the way for text that stays in the JVM.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, VariantType):
        return variant_matches(df, id_col, column, query)
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return df.select(id_col, F.explode(typed_matches(df, column, query)).alias("value"))
    if isinstance(kind, StringType):
        return jsonpath_table(df, column, query, [id_col]).select(id_col, F.try_parse_json("value").alias("value"))
    raise TypeError(f"no JSON in a column of type {kind.simpleString()}")


def parsed_values(df: DataFrame, id_col: str, column: str, query: str | Path) -> DataFrame:
    """(id_col, value): the same from text that is parsed to VARIANT first, so that no document leaves the JVM.

    Documents that VARIANT can't hold (no valid JSON, or a key repeated) and those that write a key with an escape, which
    VARIANT decodes, go by the scanner in the same plan. So the rows are those of jsonpath_values(), in no order.
    """
    path = query if isinstance(query, Path) else parse(query)
    check_supported(path)
    must = JsonPath(path).prefilter(column)
    df = df.select(id_col, column).where(F.col(column).isNotNull() if must is None else must)
    # sound: after a key's last escape there is no quote but the one that ends it
    doc = F.when(~F.col(column).rlike(r'\\.[^"]*"\s*:'), F.try_parse_json(column))
    found = variant_matches(df.select(id_col, doc.alias("doc")), id_col, "doc", path)
    return found.unionByName(jsonpath_values(df.where(doc.isNull()), id_col, column, path))


def corpus_count(df: DataFrame, column: str, query: str | Path, **options) -> DataFrame:
    """One row, matches: over all documents. Counts are summed before the one shuffle."""
    q = JsonPath.compile(query, **options)
    if (must := q.prefilter(column)) is not None:
        df = df.where(must)
    return df.agg(F.coalesce(F.sum(q.count(column)), F.lit(0)).alias("matches"))
