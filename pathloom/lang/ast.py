"""Syntax tree of a query. Nodes are immutable, hashable and picklable; str() gives a canonical text that parses back."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

#: Integers in queries lie within plus or minus this.
MAX_INT = 2**53 - 1

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", "\\": "\\\\"}


def escape(text: str, quote: str = "'") -> str:
    """text as it stands between two of that quote in a query."""
    return "".join(f"\\{quote}" if c == quote else _SHORT.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text)


def checked_int(value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{value!r} is no integer")
    if abs(value) > MAX_INT:
        raise ValueError(f"{value} is outside the range of -(2**53)+1 to (2**53)-1")
    return value


def normalize_number(value: float) -> int | float:
    """A float that is integral and in range as an int, so that 1e2 equals 100 and -0.0 equals 0."""
    if isinstance(value, int):
        return value
    if math.isnan(value) or math.isinf(value):
        raise ValueError("a number must be finite")
    return int(value) if value.is_integer() and abs(value) <= MAX_INT else value


class Selector:
    """One selector in a segment."""

    is_name = is_wildcard = is_index = is_slice = is_filter = False


@dataclass(frozen=True)
class Name(Selector):
    name: str
    is_name = True

    @property
    def quoted(self) -> bytes:
        """The name as it is compared with raw keys: decoded, in double quotes, as UTF-8."""
        return b'"' + self.name.encode("utf-8", "surrogatepass") + b'"'

    def __str__(self) -> str:
        return f"'{escape(self.name)}'"


@dataclass(frozen=True)
class Wildcard(Selector):
    is_wildcard = True

    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Index(Selector):
    """An array index; a negative one counts from the end."""

    index: int
    is_index = True

    def __post_init__(self) -> None:
        checked_int(self.index)

    @property
    def is_start_based(self) -> bool:
        return self.index >= 0

    @property
    def is_end_based(self) -> bool:
        return self.index < 0

    def __str__(self) -> str:
        return str(self.index)


@dataclass(frozen=True)
class Slice(Selector):
    """start:end:step. A bound of None is open; it then depends on the direction where the slice begins."""

    start: int | None = None
    end: int | None = None
    step: int = 1
    is_slice = True

    def __post_init__(self) -> None:
        for x in (self.start, self.end, self.step):
            if x is not None:
                checked_int(x)
        if self.start == (0 if self.step >= 0 else -1):  # the default, said aloud
            object.__setattr__(self, "start", None)

    @property
    def is_forward(self) -> bool:
        return self.step >= 0

    @property
    def is_backward(self) -> bool:
        return self.step < 0

    def contains(self, i: int) -> bool:
        """Whether a forward slice of bounds not below 0 selects index i."""
        start = self.start or 0
        return self.step > 0 and i >= start and (self.end is None or i < self.end) and (i - start) % self.step == 0

    def indices(self, n: int) -> range:
        """The indices that the slice selects of n items, in its order."""
        if self.step == 0:
            return range(0)
        at = lambda x: x if x >= 0 else n + x
        if self.step > 0:
            low = min(max(at(self.start or 0), 0), n)
            high = n if self.end is None else min(max(at(self.end), 0), n)
            return range(low, high, self.step)
        high = n - 1 if self.start is None else min(max(at(self.start), -1), n - 1)
        low = -1 if self.end is None else min(max(at(self.end), -1), n - 1)
        return range(high, low, self.step)

    def __str__(self) -> str:
        return f"{'' if self.start is None else self.start}:{'' if self.end is None else self.end}{'' if self.step == 1 else f':{self.step}'}"


@dataclass(frozen=True)
class Filter(Selector):
    expr: Expr
    is_filter = True

    def __str__(self) -> str:
        return f"?{self.expr}"


@dataclass(frozen=True)
class Segment:
    """A child or descendant step with one selector or more."""

    selectors: tuple[Selector, ...]
    descendant: bool = False

    def __post_init__(self) -> None:
        if not self.selectors:
            raise ValueError("a segment has at least one selector")

    @property
    def is_child(self) -> bool:
        return not self.descendant

    @property
    def is_descendant(self) -> bool:
        return self.descendant

    @property
    def only(self) -> Selector | None:
        """The selector, if there is just one."""
        return self.selectors[0] if len(self.selectors) == 1 else None

    def __str__(self) -> str:
        return f"{'..' * self.descendant}[{', '.join(map(str, self.selectors))}]"


@dataclass(frozen=True)
class Path:
    """A query: segments applied to the root."""

    segments: tuple[Segment, ...] = ()

    @property
    def is_root(self) -> bool:
        return not self.segments

    @property
    def singular(self) -> SingularPath | None:
        """The same as a singular path, if it has only child steps by one name or index each."""
        steps = [s.only for s in self.segments if s.is_child]
        if len(steps) != len(self.segments) or any(not isinstance(x, (Name, Index)) for x in steps):
            return None
        return SingularPath(tuple(steps))

    def __str__(self) -> str:
        return "$" + "".join(map(str, self.segments))


@dataclass(frozen=True)
class SingularPath:
    """Steps by name or index; they lead to one node at most."""

    steps: tuple[Name | Index, ...] = ()

    def __str__(self) -> str:
        return "".join(f"[{s}]" for s in self.steps)


class Expr:
    """A logical expression; precedence tells where parentheses are needed."""

    precedence = 10

    def _side(self, x: Expr, strict: bool) -> str:
        return f"({x})" if x.precedence < self.precedence or strict and x.precedence == self.precedence else str(x)


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr
    precedence = 1

    def __str__(self) -> str:
        return f"{self._side(self.left, True)} || {self._side(self.right, False)}"


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr
    precedence = 2

    def __str__(self) -> str:
        return f"{self._side(self.left, False)} && {self._side(self.right, True)}"


@dataclass(frozen=True)
class Not(Expr):
    expr: Expr
    precedence = 3

    def __str__(self) -> str:
        bare = isinstance(self.expr, Test)  # "!" can't stand before a comparison or another "!"
        return f"!{self.expr}" if bare else f"!({self.expr})"


@dataclass(frozen=True)
class Test(Expr):
    """Whether a path, from the item at hand or from the root, selects any node."""

    path: Path
    relative: bool = True
    __test__ = False

    def __str__(self) -> str:
        return ("@" if self.relative else "$") + "".join(map(str, self.path.segments))


@dataclass(frozen=True)
class Literal:
    value: str | int | float | bool | None

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return f'"{escape(self.value, chr(34))}"'
        return json.dumps(self.value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Literal) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Operand:
    """A singular path in a comparison."""

    path: SingularPath
    relative: bool = True

    def __str__(self) -> str:
        return ("@" if self.relative else "$") + str(self.path)


@dataclass(frozen=True)
class Comparison(Expr):
    left: Literal | Operand
    op: str = field()
    right: Literal | Operand = field()

    def __post_init__(self) -> None:
        if self.op not in ("==", "!=", "<=", ">=", "<", ">"):
            raise ValueError(f"{self.op!r} is no comparison operator")

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"
