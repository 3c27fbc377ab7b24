"""Queries over typed columns, unrolled over the schema at plan time.

The automaton runs over the type, not the data: what comes out are field accesses, higher-order functions and literals,
so that Catalyst prunes nested columns and everything stays in generated code. Recursion ends with the schema.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pathloom.automaton import Automaton, check_supported
from pathloom.lang import parse
from pathloom.lang.ast import Index, Path

_NONE = "array<variant>"


def _variant(x: Column, kind: DataType) -> Column:
    return F.to_variant_object(x) if isinstance(kind, (StructType, ArrayType, MapType)) else x.cast("variant")


def _concat(parts: list[Column]) -> Column | None:
    return None if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def _node(a: Automaton, x: Column, kind: DataType, state: int) -> Column | None:
    """array<variant> of the matches at a value of that state and below it, in document order; None if there are none."""
    parts = []
    if a.is_accepting(state):
        parts.append(F.array(_variant(x, kind)))
    if not a.is_rejecting(state) and (below := _below(a, x, kind, state)) is not None:
        parts.append(below)
    both = _concat(parts)
    return None if both is None else F.when(x.isNotNull(), both).otherwise(F.array().cast(_NONE))


def _below(a: Automaton, x: Column, kind: DataType, state: int) -> Column | None:
    if isinstance(kind, StructType):
        found = [_node(a, x.getField(f.name), f.dataType, a.on_name(state, b'"' + f.name.encode() + b'"')) for f in kind.fields]
        return _concat([c for c in found if c is not None])
    if isinstance(kind, MapType):
        names = [q for q in a._by_name if a.on_name(state, q) != a.on_other(state)]  # noqa: SLF001
        cases = [(q, a.on_name(state, q)) for q in names]

        def entry(e: Column) -> Column:
            out = _or_none(_node(a, e["value"], kind.valueType, a.on_other(state)))
            for q, t in cases:
                out = F.when(e["key"].cast("string") == q[1:-1].decode(), _or_none(_node(a, e["value"], kind.valueType, t))).otherwise(out)
            return out

        if all(_node(a, F.lit(None), kind.valueType, t) is None for t in [a.on_other(state), *(t for _, t in cases)]):
            return None
        return F.flatten(F.transform(F.map_entries(x), entry))
    if isinstance(kind, ArrayType):
        asked = [(bit, s) for bit, s in a._arrays if state & bit]  # noqa: SLF001
        # each combination of the selectors that hold for an index leads to one state
        cases = []
        for holds in product((True, False), repeat=len(asked)):
            moved = a._any  # noqa: SLF001
            for (bit, _), h in zip(asked, holds, strict=True):
                moved |= bit if h else 0
            cases.append((holds, a._next(state, moved)))  # noqa: SLF001
        if all(_node(a, F.lit(None), kind.elementType, t) is None for _, t in cases):
            return None
        element = kind.elementType
        if isinstance(element, StructType) and not any(a.is_accepting(t) for _, t in cases):
            # only the fields that can match are zipped, for Catalyst doesn't prune inside a lambda
            used = [f for f in element.fields if any(_node(a, F.lit(None), f.dataType, a.on_name(t, b'"' + f.name.encode() + b'"')) is not None for _, t in cases)]
            if len(used) < len(element.fields):
                x, element = F.arrays_zip(*(x.getField(f.name) for f in used)), StructType(used)

        def item(e: Column, i: Column) -> Column:
            tests = [i == s.index if isinstance(s, Index) else _in_slice(i, s) for _, s in asked]
            out = _or_none(_node(a, e, element, cases[-1][1]))
            for holds, t in reversed(cases[:-1]):
                when = F.lit(True)
                for test, h in zip(tests, holds, strict=True):
                    when = when & (test if h else ~test)
                out = F.when(when, _or_none(_node(a, e, element, t))).otherwise(out)
            return out

        return F.flatten(F.transform(x, item))
    return None


def _in_slice(i: Column, s) -> Column:
    start = s.start or 0
    inside = (i >= start) & ((i - start) % s.step == 0)
    return inside if s.end is None else inside & (i < s.end)


def _or_none(c: Column | None) -> Column:
    return F.array().cast(_NONE) if c is None else c


def typed_matches(df: DataFrame, column: str, query: str | Path) -> Column:
    """array<variant>: the matches of query in a struct, array or map column of df, in document order.

    Executes what compat mode does. A null field or item is taken as absent, for typed data don't tell JSON null from
    it; names match field names exactly.
    """
    path = query if isinstance(query, Path) else parse(query)
    check_supported(path)
    a = Automaton(path)
    found = None if a.is_empty else _node(a, F.col(column), df.schema[column].dataType, a.START)
    return _or_none(found)
