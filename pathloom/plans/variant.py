"""Queries over VARIANT columns: one expression a row, which walks a document level by level.

Values only: a VARIANT keeps neither offsets nor the order of keys as written, so results are rows without order.
"""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.automaton import check_supported, statically_empty
from pathloom.lang import parse
from pathloom.lang.ast import Index, Name, Path, Segment, Selector, Slice, Wildcard

#: States in one word of a node's set of states; it must fit a bigint.
_WORD = 62

#: Levels that are walked before a document is asked for its depth, which takes its whole text.
_SHALLOW = 6


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _test(s: Selector, member: bool) -> str:
    """Whether the child is selected, which is the member e of an object or the item i of a list; never null."""
    if isinstance(s, Wildcard):
        return "true"
    if isinstance(s, Name):
        return f"e.key = {_sql(s.name)}" if member else "false"
    if member:
        return "false"
    if isinstance(s, Index):
        return f"i = {s.index}"
    assert isinstance(s, Slice)
    if statically_empty(s):
        return "false"
    start = s.start or 0
    return f"(i >= {start} AND (i - {start}) % {s.step} = 0" + (f" AND i < {s.end}" if s.end is not None else "") + ")"


def _states_of_child(segments: tuple[Segment, ...], word: int, member: bool) -> str:
    """One word of the child's states: state k + 1 where x is in k and the step selects it; k too, if it is a descendant step."""
    lasting = sum(1 << k % _WORD for k, g in enumerate(segments) if g.descendant and k // _WORD == word)
    parts = [f"(x.s{word} & {lasting}L)"] if lasting else []
    for k, g in enumerate(segments):
        if (k + 1) // _WORD == word and (test := _test(g.only, member)) != "false":
            parts.append(f"IF((x.s{k // _WORD} & {1 << k % _WORD}L) <> 0L AND {test}, {1 << (k + 1) % _WORD}L, 0L)")
    return " | ".join(parts) or "0L"


def _is_plain(g: Segment) -> bool:
    """Whether variant_get can take the step: its paths have no way to quote some names."""
    s = g.only
    return not g.descendant and (isinstance(s, Index) or isinstance(s, Name) and bool(s.name) and "'" not in s.name and "\\" not in s.name)


def _step(g: Segment) -> str:
    s = g.only
    return f"[{s.index}]" if isinstance(s, Index) else f"['{s.name}']"


def variant_values(column: str, query: str | Path) -> Column:
    """array<variant>: the values of the nodes that query selects in the named column; each node once.

    Executes what compat mode does. The expression walks a document level by level with the set of states that each node
    is in, and follows those that are in any; a node that several steps reach is still one. Its work is that of its
    document: there are at most as many levels as the document has brackets, and only such as hold nodes cost much; the
    brackets are counted only in documents that go on after the first levels. The names and indices that a query begins
    with are taken by one variant_get.
    """
    path = query if isinstance(query, Path) else parse(query)
    check_supported(path)
    own = "`" + column.replace("`", "``") + "`"
    lead = list(takewhile(_is_plain, path.segments))
    doc = f"try_variant_get({own}, {_sql('$' + ''.join(map(_step, lead)))})" if lead else own
    segments = path.segments[len(lead) :]
    if not segments:
        return F.expr(f"CASE WHEN {own} IS NULL THEN NULL WHEN {doc} IS NULL THEN CAST(array() AS array<variant>) ELSE array({doc}) END")
    n = len(segments)
    words, last, bit = range(n // _WORD + 1), n // _WORD, 1 << n % _WORD
    any_state = " OR ".join(f"k.s{w} <> 0L" for w in words)
    more_to_come = " OR ".join(f"(k.s{w} & {~bit if w == last else -1}L) <> 0L" for w in words)
    sets = lambda member: ", ".join(f"{_states_of_child(segments, w, member)} AS s{w}" for w in words)
    members = f"transform(map_entries(try_variant_get(x.v, '$', 'map<string,variant>')), e -> struct({sets(True)}, e.value AS v))"
    items = f"transform(try_variant_get(x.v, '$', 'array<variant>'), (e, i) -> struct({sets(False)}, e AS v))"
    kids, here = f"flatten(transform(a.here, x -> coalesce({members}, {items}, array())))", "ks"
    if not segments[0].descendant:  # else every child stays in the first state
        kids, here = f"filter({kids}, k -> {any_state})", f"filter(ks, k -> {more_to_come})"
    kind = f"array<struct<{','.join(f's{w}:bigint' for w in words)},v:variant>>"
    root = ", ".join(f"{int(w == 0)}L AS s{w}" for w in words)
    start = f"struct(CAST(array(struct({root}, {doc} AS v)) AS {kind}) AS here, CAST(array() AS array<variant>) AS found)"
    level = f"""(a, level) -> transform(array({kids}), ks -> struct(
        {here} AS here,
        concat(a.found, transform(filter(ks, k -> (k.s{last} & {bit}L) <> 0L), k -> k.v)) AS found))[0]"""
    if any(g.descendant for g in segments):
        # brackets inside strings count too, which only makes the bound larger
        depth = f"transform(array(to_json({doc})), t -> length(t) - length(translate(t, '[{{', '')))[0]"
        rest = f"aggregate(sequence(1, greatest(1, {depth})), b, {level}, a -> a.found)"
        found = f"transform(array(aggregate(sequence(1, {_SHALLOW}), {start}, {level})), b -> IF(size(b.here) = 0, b.found, {rest}))[0]"
    else:
        found = f"aggregate(sequence(1, {n}), {start}, {level}, a -> a.found)"
    return F.expr(f"CASE WHEN {own} IS NULL THEN NULL WHEN {doc} IS NULL THEN CAST(array() AS array<variant>) ELSE {found} END")


def variant_matches(df: DataFrame, id_col: str, column: str, query: str | Path) -> DataFrame:
    """(id_col, value): a row for each node of the VARIANT column that query selects; each node once, in no order."""
    return df.select(id_col, F.explode(variant_values(column, query)).alias("value"))
