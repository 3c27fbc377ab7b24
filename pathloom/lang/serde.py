"""Queries as JSON, so that they can be stored and sent: to_json() and from_json(), which returns an equal tree."""

from __future__ import annotations

import json

from pathloom.lang.ast import And, Comparison, Expr, Filter, Index, Literal, Name, Not, Operand, Or, Path, Segment, Selector, SingularPath, Slice, Test, Wildcard

#: Of the form below; from_json() reads no other.
VERSION = 1


def to_json(path: Path) -> str:
    return json.dumps({"version": VERSION, "segments": _segments(path)}, separators=(",", ":"))


def from_json(text: str) -> Path:
    """The query that to_json() wrote; ValueError for anything else."""
    try:
        data = json.loads(text)
        if data["version"] != VERSION:
            raise ValueError(f"a query of version {data['version']}, not {VERSION}")
        return _path(data["segments"])
    except (KeyError, TypeError, IndexError) as e:
        raise ValueError("no query in JSON") from e


def _segments(path: Path) -> list:
    return [{"descendant": g.descendant, "selectors": [_selector(s) for s in g.selectors]} for g in path.segments]


def _selector(s: Selector) -> dict:
    if isinstance(s, Name):
        return {"name": s.name}
    if isinstance(s, Index):
        return {"index": s.index}
    if isinstance(s, Slice):
        return {"slice": [s.start, s.end, s.step]}
    if isinstance(s, Filter):
        return {"filter": _expr(s.expr)}
    return {"wildcard": True}


def _expr(e: Expr | Literal | Operand) -> dict:
    if isinstance(e, Or):
        return {"or": [_expr(e.left), _expr(e.right)]}
    if isinstance(e, And):
        return {"and": [_expr(e.left), _expr(e.right)]}
    if isinstance(e, Not):
        return {"not": _expr(e.expr)}
    if isinstance(e, Test):
        return {"test": _segments(e.path), "relative": e.relative}
    if isinstance(e, Comparison):
        return {"compare": [_expr(e.left), e.op, _expr(e.right)]}
    if isinstance(e, Operand):
        return {"steps": [_selector(s) for s in e.path.steps], "relative": e.relative}
    return {"literal": e.value}


def _path(segments: list) -> Path:
    return Path(tuple(Segment(tuple(_read_selector(s) for s in g["selectors"]), bool(g["descendant"])) for g in segments))


def _read_selector(d: dict) -> Selector:
    (kind, value), = d.items()
    if kind == "name" and isinstance(value, str):
        return Name(value)
    if kind == "index":
        return Index(value)
    if kind == "slice":
        start, end, step = value
        return Slice(start, end, step)
    if kind == "filter":
        return Filter(_read_expr(value))
    if kind == "wildcard":
        return Wildcard()
    raise ValueError(f"no selector: {kind}")


def _read_expr(d: dict) -> Expr | Literal | Operand:
    if "or" in d or "and" in d:
        kind = Or if "or" in d else And
        left, right = d["or" if kind is Or else "and"]
        return kind(_read_expr(left), _read_expr(right))
    if "not" in d:
        return Not(_read_expr(d["not"]))
    if "test" in d:
        return Test(_path(d["test"]), bool(d["relative"]))
    if "compare" in d:
        left, op, right = d["compare"]
        return Comparison(_read_expr(left), op, _read_expr(right))
    if "steps" in d:
        return Operand(SingularPath(tuple(_read_selector(s) for s in d["steps"])), bool(d["relative"]))
    return Literal(d["literal"])
