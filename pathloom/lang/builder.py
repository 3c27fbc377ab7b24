"""Fluent construction of queries without text."""

from __future__ import annotations

from collections.abc import Callable

from pathloom.lang.ast import And, Comparison, Expr, Filter, Index, Literal, Name, Not, Operand, Or, Path, Segment, Selector, SingularPath, Slice, Test, Wildcard


class SliceBuilder:
    def __init__(self) -> None:
        self._start: int | None = None
        self._end: int | None = None
        self._step = 1

    def with_start(self, start: int) -> SliceBuilder:
        self._start = start
        return self

    def with_end(self, end: int) -> SliceBuilder:
        self._end = end
        return self

    def with_step(self, step: int) -> SliceBuilder:
        self._step = step
        return self

    def to_slice(self) -> Slice:
        return Slice(self._start, self._end, self._step)


class SelectorsBuilder:
    """Gathers the selectors of one segment."""

    def __init__(self) -> None:
        self.selectors: list[Selector] = []

    def _add(self, selector: Selector) -> SelectorsBuilder:
        self.selectors.append(selector)
        return self

    def name(self, name: str) -> SelectorsBuilder:
        return self._add(Name(name))

    def index(self, index: int) -> SelectorsBuilder:
        return self._add(Index(index))

    def wildcard(self) -> SelectorsBuilder:
        return self._add(Wildcard())

    def slice(self, start: int | None = None, end: int | None = None, step: int = 1) -> SelectorsBuilder:
        return self._add(Slice(start, end, step))

    def filter(self, expr: Expr) -> SelectorsBuilder:
        return self._add(Filter(expr))


class PathBuilder:
    """PathBuilder().child_name("a").descendant_wildcard().to_query() is $['a']..[*]."""

    def __init__(self) -> None:
        self._segments: list[Segment] = []

    def _segment(self, selectors: tuple[Selector, ...], descendant: bool) -> PathBuilder:
        self._segments.append(Segment(selectors, descendant))
        return self

    def child(self, build: Callable[[SelectorsBuilder], object]) -> PathBuilder:
        build(s := SelectorsBuilder())
        return self._segment(tuple(s.selectors), False)

    def descendant(self, build: Callable[[SelectorsBuilder], object]) -> PathBuilder:
        build(s := SelectorsBuilder())
        return self._segment(tuple(s.selectors), True)

    def child_name(self, name: str) -> PathBuilder:
        return self._segment((Name(name),), False)

    def child_wildcard(self) -> PathBuilder:
        return self._segment((Wildcard(),), False)

    def child_index(self, index: int) -> PathBuilder:
        return self._segment((Index(index),), False)

    def child_slice(self, start: int | None = None, end: int | None = None, step: int = 1) -> PathBuilder:
        return self._segment((Slice(start, end, step),), False)

    def child_filter(self, expr: Expr) -> PathBuilder:
        return self._segment((Filter(expr),), False)

    def descendant_name(self, name: str) -> PathBuilder:
        return self._segment((Name(name),), True)

    def descendant_wildcard(self) -> PathBuilder:
        return self._segment((Wildcard(),), True)

    def descendant_index(self, index: int) -> PathBuilder:
        return self._segment((Index(index),), True)

    def descendant_slice(self, start: int | None = None, end: int | None = None, step: int = 1) -> PathBuilder:
        return self._segment((Slice(start, end, step),), True)

    def descendant_filter(self, expr: Expr) -> PathBuilder:
        return self._segment((Filter(expr),), True)

    def to_query(self) -> Path:
        """The query so far; the builder can go on."""
        return Path(tuple(self._segments))

    into_query = to_query


def literal(value: str | float | bool | None) -> Literal:
    return Literal(value)


def query_relative(*steps: str | int) -> Operand:
    """An operand from the item at hand: names and indices."""
    return Operand(SingularPath(tuple(Name(s) if isinstance(s, str) else Index(s) for s in steps)), True)


def query_absolute(*steps: str | int) -> Operand:
    """An operand from the root: names and indices."""
    return Operand(SingularPath(tuple(Name(s) if isinstance(s, str) else Index(s) for s in steps)), False)


def comparison(left: Literal | Operand, op: str, right: Literal | Operand) -> Comparison:
    return Comparison(left, op, right)


def equal_to(left, right) -> Comparison:
    return Comparison(left, "==", right)


def not_equal_to(left, right) -> Comparison:
    return Comparison(left, "!=", right)


def less_than(left, right) -> Comparison:
    return Comparison(left, "<", right)


def lesser_or_equal_to(left, right) -> Comparison:
    return Comparison(left, "<=", right)


def greater_than(left, right) -> Comparison:
    return Comparison(left, ">", right)


def greater_or_equal_to(left, right) -> Comparison:
    return Comparison(left, ">=", right)


def test_relative(path: Path) -> Test:
    return Test(path, True)


def test_absolute(path: Path) -> Test:
    return Test(path, False)


test_relative.__test__ = test_absolute.__test__ = False


def and_(left: Expr, right: Expr) -> And:
    return And(left, right)


def or_(left: Expr, right: Expr) -> Or:
    return Or(left, right)


def not_(expr: Expr) -> Not:
    return Not(expr)
