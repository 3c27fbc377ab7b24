"""Errors of compilation and of runs over documents."""

from __future__ import annotations


class CompilerError(ValueError):
    """A query that parses but cannot be compiled."""


class QueryTooComplexError(CompilerError):
    """The query's automaton would be larger than the limit."""


class UnsupportedFeatureError(CompilerError):
    """A construct that compat mode does not execute; mode="rfc" does."""

    def __init__(self, feature: str):
        self.feature = feature
        super().__init__(f"{feature} is not supported in compat mode; compile with mode='rfc'")


class JsonPathRuntimeError(RuntimeError):
    """A document that cannot be read on at byte pos."""

    kind = "InternalError"

    def __init__(self, pos: int, detail: str):
        self.pos, self.detail = pos, detail
        super().__init__(pos, detail)

    def __str__(self) -> str:
        return f"{self.kind}({self.pos}): {self.detail}"


class DepthAboveLimitError(JsonPathRuntimeError):
    kind = "DepthAboveLimit"


class DepthBelowZeroError(JsonPathRuntimeError):
    kind = "DepthBelowZero"


class MissingClosingCharacterError(JsonPathRuntimeError):
    kind = "MissingClosingCharacter"


class MissingItemError(JsonPathRuntimeError):
    kind = "MissingItem"


class MalformedStringQuotesError(JsonPathRuntimeError):
    kind = "MalformedStringQuotes"
