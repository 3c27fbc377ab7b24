"""What can be wrong with a query, and how it is shown."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class SyntaxErrorKind(Enum):
    """Each kind with what is said of it."""

    DISALLOWED_LEADING_WHITESPACE = "query starts with whitespace"
    DISALLOWED_TRAILING_WHITESPACE = "query ends with whitespace"
    MISSING_ROOT_IDENTIFIER = "query does not begin with the root identifier '$'"
    INVALID_UNESCAPED_CHARACTER = "this character must be escaped"
    INVALID_ESCAPE_SEQUENCE = "no such escape sequence"
    UNPAIRED_HIGH_SURROGATE = "this high surrogate has no low surrogate after it"
    UNPAIRED_LOW_SURROGATE = "this low surrogate has no high surrogate before it"
    INVALID_HEX_DIGIT_IN_UNICODE_ESCAPE = "not a hexadecimal digit"
    MISSING_CLOSING_SINGLE_QUOTE = "a string that began with ' is not closed"
    MISSING_CLOSING_DOUBLE_QUOTE = 'a string that began with " is not closed'
    INVALID_SEGMENT_START = "not a segment"
    INVALID_SEGMENT_AFTER_TWO_PERIODS = "not a segment after '..'"
    EMPTY_SELECTOR = "a selector is empty"
    INVALID_SELECTOR = "not a selector"
    MISSING_SELECTOR_SEPARATOR = "selectors must be separated by commas"
    MISSING_CLOSING_BRACKET = "a bracketed selection is not closed"
    INVALID_NAME_SHORTHAND_AFTER_ONE_PERIOD = "not a name or wildcard after '.'"
    NEGATIVE_ZERO_INTEGER = "-0 is not allowed as an integer"
    LEADING_ZEROS = "an integer may not have leading zeros"
    NUMBER_PARSE_ERROR = "not a valid number"
    INDEX_PARSE_ERROR = "not a valid array index"
    SLICE_START_PARSE_ERROR = "not a valid slice start"
    SLICE_END_PARSE_ERROR = "not a valid slice end"
    SLICE_STEP_PARSE_ERROR = "not a valid slice step"
    MISSING_CLOSING_PARENTHESIS = "a parenthesis in a filter is not closed"
    INVALID_NEGATION = "a comparison cannot be negated without parentheses"
    MISSING_COMPARISON_OPERATOR = "a literal must be compared with something"
    INVALID_COMPARISON_OPERATOR = "not a comparison operator"
    INVALID_COMPARABLE = "not something that can be compared"
    NON_SINGULAR_QUERY_IN_COMPARISON = "only a query that selects one node at most can be compared"
    INVALID_FILTER = "not a filter expression"


_HINTS = {
    SyntaxErrorKind.DISALLOWED_LEADING_WHITESPACE: "remove the whitespace, or parse with allow_surrounding_whitespace=True",
    SyntaxErrorKind.DISALLOWED_TRAILING_WHITESPACE: "remove the whitespace, or parse with allow_surrounding_whitespace=True",
    SyntaxErrorKind.MISSING_ROOT_IDENTIFIER: "start the query with '$'",
    SyntaxErrorKind.INVALID_UNESCAPED_CHARACTER: "write it as \\uXXXX",
    SyntaxErrorKind.MISSING_CLOSING_BRACKET: "add ']'",
    SyntaxErrorKind.MISSING_SELECTOR_SEPARATOR: "add ','",
    SyntaxErrorKind.MISSING_CLOSING_SINGLE_QUOTE: "add \"'\"",
    SyntaxErrorKind.MISSING_CLOSING_DOUBLE_QUOTE: "add '\"'",
    SyntaxErrorKind.MISSING_CLOSING_PARENTHESIS: "add ')'",
    SyntaxErrorKind.INVALID_NEGATION: "write !(...) around the comparison",
    SyntaxErrorKind.NEGATIVE_ZERO_INTEGER: "write 0",
    SyntaxErrorKind.LEADING_ZEROS: "remove the zeros",
}


@dataclass(frozen=True)
class SyntaxErrorInfo:
    """kind, and where: byte position and length in the UTF-8 query. pos may be one past the end."""

    kind: SyntaxErrorKind
    pos: int
    length: int

    @property
    def message(self) -> str:
        return self.kind.value


class ParseError(ValueError):
    """All syntax errors of a query."""

    def __init__(self, query: str, errors: list[SyntaxErrorInfo]):
        self.query, self.errors = query, sorted(errors, key=lambda e: (e.pos, e.length))
        super().__init__(self.query, self.errors)

    def __str__(self) -> str:
        return self.pretty()

    def pretty(self, width: int = 100, color: bool = False) -> str:
        """Each error under the line it is in, with what may help. Long lines are cut around the error."""
        red, off = ("\x1b[31m", "\x1b[0m") if color else ("", "")
        raw, out = self.query.encode("utf-8", "surrogatepass"), []
        for e in self.errors:
            begin = raw.rfind(b"\n", 0, e.pos) + 1
            end = raw.find(b"\n", e.pos)
            end = len(raw) if end < 0 else end
            text = lambda a, b: raw[a:b].decode("utf-8", "replace")
            line, at = text(begin, end), len(text(begin, min(e.pos, end)))
            long = max(1, len(text(min(e.pos, end), min(e.pos + e.length, end))))
            if len(line) > width:
                first = max(0, min(at - width // 2, len(line) - width))
                line, at = ("..." if first else "") + line[first : first + width] + ("..." if first + width < len(line) else ""), at - first + (3 if first else 0)
            shown = line.expandtabs(1)
            out.append(f"error: {e.message}\n\n  {shown}\n  {' ' * at}{red}{'^' * min(long, max(1, width))}{off}\n  (bytes {e.pos}-{e.pos + max(e.length, 1) - 1})" + (f"\n  note: {_HINTS[e.kind]}" if e.kind in _HINTS else ""))
        fixed = self.suggestion()
        return "\n\n".join(out) + (f"\n\ndid you mean `{fixed}`?" if fixed else "")

    def suggestion(self) -> str | None:
        """The query with its errors mended, where each has an obvious remedy and the outcome parses."""
        from pathloom.lang.parser import Parser

        raw = self.query.encode("utf-8", "surrogatepass")
        insert = {SyntaxErrorKind.MISSING_ROOT_IDENTIFIER: b"$", SyntaxErrorKind.MISSING_CLOSING_BRACKET: b"]", SyntaxErrorKind.MISSING_SELECTOR_SEPARATOR: b",", SyntaxErrorKind.MISSING_CLOSING_SINGLE_QUOTE: b"']", SyntaxErrorKind.MISSING_CLOSING_DOUBLE_QUOTE: b'"]'}
        for e in reversed(self.errors):
            if e.kind in insert:
                raw = raw[: e.pos] + insert[e.kind] + raw[e.pos :]
            elif e.kind in (SyntaxErrorKind.DISALLOWED_LEADING_WHITESPACE, SyntaxErrorKind.DISALLOWED_TRAILING_WHITESPACE, SyntaxErrorKind.INVALID_SEGMENT_AFTER_TWO_PERIODS):
                raw = raw[: e.pos] + raw[e.pos + e.length :]
            elif e.kind is SyntaxErrorKind.NEGATIVE_ZERO_INTEGER:
                raw = raw[: e.pos] + b"0" + raw[e.pos + e.length :]
            elif e.kind is SyntaxErrorKind.LEADING_ZEROS:
                number = raw[e.pos : e.pos + e.length]
                raw = raw[: e.pos] + (b"-" if number[:1] == b"-" else b"") + (number.lstrip(b"-0") or b"0") + raw[e.pos + e.length :]
            else:
                return None
        fixed = raw.decode("utf-8", "surrogatepass")
        try:
            Parser().parse(fixed)
        except (ParseError, RecursionLimitError):
            return None
        return fixed


class RecursionLimitError(ValueError):
    """A filter is nested deeper than the parser was told to follow."""

    def __init__(self, query: str, limit: int):
        self.query, self.limit = query, limit
        super().__init__(query, limit)

    def __str__(self) -> str:
        return f"filters nest deeper than the limit of {self.limit}"
