"""One pass over the bytes of a JSON document with an automaton.

The scanner is lenient: it needs brackets and quotes to match, and reads on where a strict parser would stop. Offsets
are bytes. Nodes come in document order, each once.
"""

from __future__ import annotations

import re

from pathloom.automaton import Automaton
from pathloom.errors import DepthAboveLimitError, DepthBelowZeroError, MalformedStringQuotesError, MissingClosingCharacterError, MissingItemError

MAX_DEPTH = 255
WHITESPACE = b" \t\n\r"
_BLANK = re.compile(rb"[ \t\n\r]*+")
_TO_VALUE = re.compile(rb"[ \t\n\r]*+:[ \t\n\r]*+")
_QUOTED = rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BARE = rb'[^ \t\n\r,:\[\]{}"]++(?:[ \t]++[^ \t\n\r,:\[\]{}"]++)*+'
_STRING = re.compile(_QUOTED, re.S)
_ATOM = re.compile(_BARE)
# what stands before an item or member, then the member's key, and the value if it is atomic
_ITEM = re.compile(rb"[ \t\n\r,]*+(" + _QUOTED + b"|" + _BARE + b")?+", re.S)
_MEMBER = re.compile(rb"[ \t\n\r,]*+(?:(" + _QUOTED + rb")[ \t\n\r]*+:[ \t\n\r]*+(" + _QUOTED + b"|" + _BARE + b")?+)?+", re.S)
_NEXT_BRACKET = re.compile(rb'[^"{}\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{}\[\]]*+)*+([{}\[\]])', re.S)
_OPEN = {123, 91}


def end_of_value(buf: bytes, at: int) -> int:
    """The byte after the value that starts at at. What is inside is not looked at; depth is unlimited."""
    c = buf[at]
    if c == 34:
        m = _STRING.match(buf, at)
        if m is None:
            raise MalformedStringQuotesError(at, "a string is not closed")
        return m.end()
    if c in _OPEN:
        depth, pos = 1, at + 1
        while depth:
            m = _NEXT_BRACKET.match(buf, pos)
            if m is None:
                raise MissingClosingCharacterError(at, "an object or list is not closed")
            pos = m.end()
            depth += 1 if buf[pos - 1] in _OPEN else -1
        return pos
    m = _ATOM.match(buf, at)
    if m is None:
        raise MissingItemError(at, "a value is missing")
    return m.end()


def root_span(buf: bytes) -> tuple[int, int] | None:
    """The document without the white space around it; None if that is all there is."""
    start = _BLANK.match(buf).end()
    return (start, len(buf.rstrip(WHITESPACE))) if start < len(buf) else None


class Scan:
    """Runs an automaton over documents; spans() gives (start, end) of each match."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def spans(self, buf: bytes) -> list[tuple[int, int]]:
        a = self.automaton
        if a.is_root:
            span = root_span(buf)
            return [span] if span else []
        if a.is_empty:
            return []
        starts: list[int] = []
        ends: list[int] = []
        if a.head is not None:
            self._by_head(buf, a.head, starts, ends)
        else:
            at = _BLANK.match(buf).end()
            if at < len(buf):
                if buf[at] in (93, 125):
                    raise DepthBelowZeroError(at, "a closing bracket without an opening one")
                if buf[at] in _OPEN:
                    self._run(buf, at, a.START, starts, ends)
        return list(zip(starts, ends, strict=True))

    def count(self, buf: bytes) -> int:
        return len(self.spans(buf))

    def _by_head(self, buf: bytes, head: bytes, starts: list[int], ends: list[int]) -> None:
        """Searches for the name as bytes, and runs the automaton only below it."""
        a, pos = self.automaton, 0
        below = a.on_name(a.START, head)
        while (pos := buf.find(head, pos)) >= 0:
            after = _TO_VALUE.match(buf, pos + len(head))
            if after is None or buf[pos - 1 : pos] == b"\\":
                pos += len(head)
                continue
            pos = self._value(buf, after.end(), below, starts, ends)

    def _value(self, buf: bytes, at: int, state: int, starts: list[int], ends: list[int]) -> int:
        """Records the value at at if its state accepts, runs below it if that can match, and returns its end."""
        a = self.automaton
        if at >= len(buf):
            raise MissingItemError(at, "a value is missing")
        if buf[at] not in _OPEN or a.is_rejecting(state):
            end = end_of_value(buf, at)
            if a.is_accepting(state):
                starts.append(at)
                ends.append(end)
            return end
        place = len(starts)
        if a.is_accepting(state):
            starts.append(at)
            ends.append(-1)
        end = self._run(buf, at, state, starts, ends)
        if a.is_accepting(state):
            ends[place] = end
        return end

    def _run(self, buf: bytes, at: int, state: int, starts: list[int], ends: list[int]) -> int:
        """Runs below the object or list that starts at at, and returns its end."""
        a = self.automaton
        on_name, on_other, on_index, accept = a.on_name, a.on_other, a.on_index, a.accept
        stack: list[tuple[int, bool, int, int]] = []  # of the containers around: state, is a list, next index, its place in starts
        is_list, index, place = buf[at] == 91, 0, -1
        pos, size, unitary = at + 1, len(buf), a.is_unitary(state)
        while True:
            m = _ITEM.match(buf, pos) if is_list else _MEMBER.match(buf, pos)
            pos, got = m.end(), m.lastindex
            if got is None:
                if pos >= size:
                    raise MissingClosingCharacterError(at, "an object or list is not closed")
                c = buf[pos]
                if c == 125 or c == 93:
                    pos += 1
                    if place >= 0:
                        ends[place] = pos
                    if not stack:
                        return pos
                    state, is_list, index, place = stack.pop()
                    unitary = a.is_unitary(state)
                    if unitary and not is_list:
                        pos = self._tail(buf, pos)
                    continue
            if is_list:
                below = on_index(state, index)
                index += 1
                if got:  # an atomic item
                    if below & accept:
                        starts.append(m.start(1))
                        ends.append(pos)
                    continue
            elif got is None:
                if c != 34:
                    pos = end_of_value(buf, pos) if c != 58 else pos + 1  # no key: read over it
                    continue
                m = _STRING.match(buf, pos)
                if m is None:
                    raise MalformedStringQuotesError(pos, "a string is not closed")
                pos = m.end()  # no value belongs to this string
                continue
            else:
                key = m[1]
                below = on_name(state, key) if not unitary or key in a._by_name else on_other(state)  # noqa: SLF001
                if got == 2:  # an atomic member
                    if below & accept:
                        starts.append(m.start(2))
                        ends.append(pos)
                        if unitary:
                            pos = self._tail(buf, pos)
                    continue
                if pos >= size or buf[pos] in (44, 125, 93):
                    continue
                c = buf[pos]
            if (c == 123 or c == 91) and below & ~accept:
                if len(stack) + 2 > MAX_DEPTH:
                    raise DepthAboveLimitError(pos, f"more than {MAX_DEPTH} levels")
                stack.append((state, is_list, index, place))
                place = -1
                if below & accept:
                    place = len(starts)
                    starts.append(pos)
                    ends.append(-1)
                state, is_list, index = below, c == 91, 0
                unitary = a.is_unitary(state)
                pos += 1
                continue
            if c == 58:
                pos += 1
                continue
            end = end_of_value(buf, pos)
            if below & accept:
                starts.append(pos)
                ends.append(end)
                if unitary and not is_list:
                    end = self._tail(buf, end)
            elif unitary and not is_list and below and (c == 123 or c == 91):
                end = self._tail(buf, end)
            pos = end

    @staticmethod
    def _tail(buf: bytes, pos: int) -> int:
        """The place of the bracket that closes the container pos is in."""
        depth = 1
        while True:
            m = _NEXT_BRACKET.match(buf, pos)
            if m is None:
                raise MissingClosingCharacterError(pos, "an object or list is not closed")
            pos = m.end()
            depth += 1 if buf[pos - 1] in _OPEN else -1
            if not depth:
                return pos - 1


def kind_of(first: int) -> str:
    """"complex" or "atomic", by a value's first byte."""
    return "complex" if first in _OPEN else "atomic"


def shred(buf: bytes) -> list[tuple]:
    """All nodes of a document: (node_id, parent_id, depth, key, idx, kind, start_idx, end_idx, last_desc_id).

    node_id counts in document order from 0, the root's. key is the raw key with both quotes, as bytes; last_desc_id is
    the greatest node_id inside the node.
    """
    span = root_span(buf)
    if span is None:
        return []
    at = span[0]
    if buf[at] not in _OPEN:
        return [(0, -1, 0, None, None, "atomic", *span, 0)]
    rows: list[list] = [[0, -1, 0, None, None, "complex", at, -1, 0]]
    stack: list[tuple[int, bool, int]] = []
    node, is_list, index, pos, size = 0, buf[at] == 91, 0, at + 1, len(buf)
    while True:
        m = _ITEM.match(buf, pos) if is_list else _MEMBER.match(buf, pos)
        pos, got, key = m.end(), m.lastindex, None
        if got is None:
            if pos >= size:
                raise MissingClosingCharacterError(rows[node][6], "an object or list is not closed")
            c = buf[pos]
            if c == 125 or c == 93:
                pos += 1
                rows[node][7], rows[node][8] = pos, len(rows) - 1
                if not stack:
                    return [tuple(r) for r in rows]
                node, is_list, index = stack.pop()
                continue
            if not is_list:
                if c != 34:
                    pos = end_of_value(buf, pos) if c != 58 else pos + 1
                    continue
                m = _STRING.match(buf, pos)
                if m is None:
                    raise MalformedStringQuotesError(pos, "a string is not closed")
                pos = m.end()
                continue
        elif not is_list:
            key = m[1]
            if got == 1:
                if pos >= size or buf[pos] in (44, 125, 93):
                    continue
                c = buf[pos]
        if got == 2 or got and is_list:
            new = len(rows)
            rows.append([new, node, len(stack) + 1, key, index if is_list else None, "atomic", m.start(got), pos, new])
            index += 1
            continue
        if c == 58:
            pos += 1
            continue
        new = len(rows)
        row = [new, node, len(stack) + 1, key, index if is_list else None, kind_of(c), pos, -1, new]
        rows.append(row)
        index += 1
        if c == 123 or c == 91:
            if len(stack) + 2 > MAX_DEPTH:
                raise DepthAboveLimitError(pos, f"more than {MAX_DEPTH} levels")
            stack.append((node, is_list, index))
            node, is_list, index, pos = new, c == 91, 0, pos + 1
            continue
        pos = row[7] = end_of_value(buf, pos)
