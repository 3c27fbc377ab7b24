"""The query language: syntax tree, parser, builders and errors. Runs on the driver and needs no Spark."""

from pathloom.lang.ast import (
    MAX_INT,
    And,
    Comparison,
    Filter,
    Index,
    Name,
    Not,
    Or,
    Path,
    Segment,
    SingularPath,
    Slice,
    Test,
    Wildcard,
    escape,
)
from pathloom.lang.builder import PathBuilder, SelectorsBuilder, SliceBuilder
from pathloom.lang.errors import ParseError, RecursionLimitError, SyntaxErrorInfo, SyntaxErrorKind
from pathloom.lang.parser import Parser, parse
from pathloom.lang.serde import from_json, to_json

__all__ = ["from_json", "to_json","MAX_INT", "And", "Comparison", "Filter", "Index", "Name", "Not", "Or", "ParseError", "Parser", "Path", "PathBuilder", "RecursionLimitError", "Segment", "SelectorsBuilder", "SingularPath", "Slice", "SliceBuilder", "SyntaxErrorInfo", "SyntaxErrorKind", "Test", "Wildcard", "escape", "parse"]
