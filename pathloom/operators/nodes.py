"""The node table: documents shredded to rows, and queries as window functions over them.

node(doc, node_id, parent_id, depth, key, idx, kind, start_idx, end_idx, last_desc_id): node_id counts in document order
from 0, and the nodes inside a node are those up to last_desc_id. A descendant step is a running maximum of interval ends
within the document. A child step compares a node's parent with the last selected node before it; after a descendant step
selected nodes may be nested, and a window over the family takes its place. Documents of plain JSON are shredded many at
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import takewhile
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.automaton import check_supported, statically_empty
from pathloom.errors import JsonPathRuntimeError
from pathloom.lang import parse
from pathloom.lang.ast import Index, Name, Path, Selector, Slice, Wildcard
from pathloom.operators.bulk import Nodes, chunks, shred_many, slices
from pathloom.operators.scanner import shred

_FIELDS = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("key", pa.string()), ("idx", pa.int32()), ("kind", pa.string()), ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("last_desc_id", pa.int32()), ("value", pa.string())]


def _columns(t: Nodes, bounds: np.ndarray) -> list[pa.Array]:
    """The columns of _FIELDS."""
    n, at = len(t), bounds[t.doc]
    first = np.searchsorted(t.doc, t.doc)
    has_key, child = t.key_end > 0, t.parent >= 0
    in_list = child & t.is_list[t.parent]

    def spread(some: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
        return slices(t.data, start[some], end[some]).take(pa.array(np.cumsum(some) - 1, mask=~some))

    cols = [np.arange(n) - first, np.where(child, t.parent - first, -1), t.depth, spread(has_key, t.key_start, t.key_end), pa.array(t.rank.astype(np.int32), mask=~in_list)]
    cols += [pa.array(["complex", "atomic"]).take(pa.array(t.atomic.astype(np.int8))), t.start - at, t.end - at, t.last - first, spread(t.atomic, t.start, t.end)]
    return [c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype())) for c, (_, k) in zip(cols, _FIELDS, strict=True)]


def node_table(docs: DataFrame, id_col: str, json_col: str, errors: str = "raise") -> DataFrame:
    """The nodes of all documents; id_col comes first, as doc. value is the text of atomic nodes, null for others.

    Null documents have no nodes. errors "null" leaves out documents that can't be read.
    """
    strict = errors == "raise"

    def one(raw: bytes) -> list[tuple]:
        try:
            rows = shred(raw)
        except JsonPathRuntimeError:
            if strict:
                raise
            return []
        full = []
        for row in rows:
            key, kind, a, b = row[3], row[5], row[6], row[7]
            full.append((*row[:3], None if key is None else key.decode("utf-8", "replace"), *row[4:], raw[a:b].decode("utf-8", "replace") if kind == "atomic" else None))
        return full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for first, data, bounds in chunks(batch.column(1)):
                nodes, plain = shred_many(data, bounds)
                if nodes is not None:
                    rows = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nodes.doc + first)), *_columns(nodes, bounds)], names)
                    yield rows.filter(pa.array(~missing[nodes.doc + first])) if missing.any() else rows
                for d in np.flatnonzero(~plain & ~missing[first : first + len(plain)]):
                    rows = one(data[bounds[d] : bounds[d + 1]].tobytes())
                    if rows:
                        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(rows), first + d))), *cols], names)

    names = ["doc", *(n for n, _ in _FIELDS)]
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string"}
    ident = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, json_col).mapInArrow(run, f"doc {ident}, " + ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS))


def _condition(s: Selector) -> Column:
    if isinstance(s, Wildcard):
        return F.lit(True)
    if isinstance(s, Name):
        return F.col("key") == s.quoted.decode()
    if isinstance(s, Index):
        return F.col("idx") == s.index
    assert isinstance(s, Slice)
    if statically_empty(s):
        return F.lit(False)
    start = s.start or 0
    inside = (F.col("idx") >= start) & ((F.col("idx") - start) % s.step == 0)
    return inside if s.end is None else inside & (F.col("idx") < s.end)


def select_nodes(nodes: DataFrame, query: str | Path) -> DataFrame:
    """(doc, node_id, start_idx, end_idx, kind, seq) of the nodes that a query selects; seq counts a document's matches.

    The nodes are read once and those that no step wants are dropped first, so only candidates are shuffled, once, by
    document; steps are window functions within a document, which find each node once. doc must tell documents apart.
    Executes what compat mode does, and unions.
    """
    path = query if isinstance(query, Path) else parse(query)
    for segment in path.segments:
        for s in segment.selectors:
            check_supported(Path((type(segment)((s,), segment.descendant),)))
    fixed = len(list(takewhile(lambda g: not g.descendant, path.segments)))  # steps that lead to one depth
    wanted = [F.coalesce(reduce(or_, map(_condition, g.selectors)), F.lit(False)) & (F.col("node_id") > 0) for g in path.segments]
    wanted = [w & (F.col("depth") == k + 1) if k < fixed else w for k, w in enumerate(wanted)]
    steps = [f"_step{k}" for k in range(1, len(wanted))]
    kept = ["doc", "node_id", "parent_id", "last_desc_id", "start_idx", "end_idx", "kind"]
    # a number keeps the parts from being merged again to one a core, whose sort would grow with the table
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one pass over the nodes and one exchange by document: each row carries which steps it would do for, and whether the
    # first one, which starts from the root, selects it
    first = wanted[0] if wanted else F.col("node_id") == 0
    at = nodes.where(reduce(or_, wanted, first)).select(*kept, *(w.alias(n) for w, n in zip(wanted[1:], steps, strict=True)), first.alias("_in")).repartition(parts, "doc")
    before = "OVER (PARTITION BY doc ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for k, (segment, step) in enumerate(zip(path.segments[1:], steps, strict=True), 1):
        if segment.descendant:
            # nodes are nested or apart, so a node is inside one of those above if the farthest end before it reaches it
            above = F.expr(f"max(IF(_in, last_desc_id, NULL)) {before} >= node_id")
        elif k < fixed:
            # those above are of one depth, so the last one before a node is its parent or none is
            above = F.expr(f"last(IF(_in, node_id, NULL), true) {before} = parent_id")
        else:
            # a selected node meets its children as one more row of their family
            at = at.withColumn("_family", F.explode(F.when(F.col("_in"), F.array("parent_id", "node_id")).otherwise(F.array("parent_id"))))
            above = F.expr("bool_or(_in AND _family = node_id) OVER (PARTITION BY doc, _family)")
        at = at.withColumn("_above", above)
        if "_family" in at.columns:
            at = at.where("_family = parent_id")
        later = steps[k:]
        at = at.select(*kept, *later, (F.col(step) & F.coalesce("_above", F.lit(False))).alias("_in")).where(reduce(or_, map(F.col, later), F.col("_in")))
    at = at.where("_in").select("doc", "node_id", "start_idx", "end_idx", "kind")
    return at.withColumn("seq", F.expr("row_number() OVER (PARTITION BY doc ORDER BY node_id) - 1"))
