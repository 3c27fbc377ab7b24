"""Many documents at once: nodes as NumPy arrays, and the standard's semantics as masks over them.

Documents of plain JSON are shredded together, a fixed number of array operations for all of them. What is not plain
(escapes, a root that is no object or list, white space inside an atom, whatever a strict parser would stop at, more than
250 levels) is told apart and left to the scanner, so results are those of scanner.shred() and tree.Evaluator.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pathloom.lang.ast import And, Comparison, Expr, Filter, Index, Literal, Name, Not, Operand, Or, Path, Segment, Selector, Slice, Wildcard
from pathloom.operators.tree import compare

#: Bytes of documents that are shredded together; a larger one is alone. It bounds the arrays, not what is read.
BYTES = 1 << 20
_DEEP = 250
_OBJECT, _LIST, _END_OBJECT, _END_LIST, _COMMA, _COLON, _QUOTE, _ESCAPE, _BLANK = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b'{[}],:"\\')] = range(1, 9)
_CLASS[list(b" \t\n\r")] = _BLANK
_STEP = np.array([0, 1, 1, -1, -1, 0, 0], np.int32)
_NONE, _STRING, _BARE, _OTHER = range(4)
#: Which mark may follow which, by what stands between them; 0 is the document's end.
_FOLLOWS = np.zeros((7, 4, 7), bool)
_FOLLOWS[_OBJECT, _NONE, _END_OBJECT] = True
_FOLLOWS[[_OBJECT, _COMMA], _STRING, _COLON] = True
_FOLLOWS[_LIST, _NONE, _END_LIST] = True
for _before in (_LIST, _COMMA, _COLON):
    _FOLLOWS[_before, _NONE, [_OBJECT, _LIST]] = True
    for _atom in (_STRING, _BARE):
        _FOLLOWS[_before, _atom, [_COMMA, _END_OBJECT if _before == _COLON else _END_LIST]] = True
for _before in (_END_OBJECT, _END_LIST):
    _FOLLOWS[_before, _NONE, [0, _COMMA, _END_OBJECT, _END_LIST]] = True


@dataclass(eq=False)
class Nodes:
    """Nodes of several documents in document order; parent and last are places in these arrays, offsets are in data."""

    data: np.ndarray
    doc: np.ndarray
    parent: np.ndarray  # -1 of roots
    depth: np.ndarray
    rank: np.ndarray  # place among the parent's children
    last: np.ndarray  # the last node inside
    atomic: np.ndarray
    is_list: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray  # with both quotes; 0 to 0 of nodes without key
    key_end: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts from start to end; they must stand in order and apart."""
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    if not len(start):
        return pa.array([], pa.string())
    all_parts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    return all_parts.take(pa.array(np.arange(0, len(bounds), 2))).cast(pa.string())


def _bytes(documents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and the bounds of each text in them."""
    raw = documents.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    if not len(raw):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8), np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]


def texts_of(documents: pa.Array, counts: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(kinds, texts) of matches, of which each document has so many, by their places in it."""
    data, bounds = _bytes(documents)
    at = np.repeat(bounds[:-1], counts)
    low, high = at + start, at + end
    kinds = pa.array(["atomic", "complex"]).take(pa.array(np.isin(data[low], (123, 91)).astype(np.int8)))
    if (low[1:] >= high[:-1]).all():
        return kinds, slices(data, low, high)
    return kinds, pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.string())


def chunks(documents: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, bounds of the documents in them) of parts of an array of texts."""
    data, bounds = _bytes(documents)
    first = 0
    while first < len(documents):
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BYTES, "right")) - 1)
        yield first, data[bounds[first] : bounds[stop]], bounds[first : stop + 1] - bounds[first]
        first = stop


def shred_many(data: np.ndarray, bounds: np.ndarray) -> tuple[Nodes | None, np.ndarray]:
    """The nodes of the plain documents, and which documents are plain."""
    cls = _CLASS[data]
    plain = np.ones(len(bounds) - 1, bool)
    bad = np.diff(np.searchsorted(np.flatnonzero(cls == _QUOTE), bounds)) % 2 == 1
    bad[np.searchsorted(bounds, np.flatnonzero(cls == _ESCAPE), "right") - 1] = True
    while True:
        for d in np.flatnonzero(bad):
            cls[bounds[d] : bounds[d + 1]] = _BLANK
        plain &= ~bad
        if not plain.any():
            return None, plain
        nodes, bad = _shred(data, cls, bounds, plain)
        if nodes is not None:
            return nodes, plain


def _shred(data: np.ndarray, cls: np.ndarray, bounds: np.ndarray, plain: np.ndarray) -> tuple[Nodes | None, np.ndarray]:
    """The nodes, or None and the documents that turn out not to be plain. Others are blank in cls, quotes are in pairs."""
    bad = np.zeros(len(plain), bool)
    quote = cls == _QUOTE
    inside = np.bitwise_xor.accumulate(quote.view(np.uint8)).view(bool)  # from the first quote to before the second
    marks = np.flatnonzero(quote | ((cls - np.uint8(1) < 6) & ~inside))
    kind = cls[marks]
    place = np.flatnonzero(kind != _QUOTE)
    at, kind = marks[place], kind[place]
    count = np.searchsorted(at, bounds)
    bad = plain & (count[1:] == count[:-1])
    if bad.any():
        return None, bad
    # what stands between a mark and the next one
    quotes = np.diff(np.append(place, len(marks))) - 1
    low, high = at + 1, np.append(at[1:], len(data))
    size = high - low
    together = True
    outside = (cls == _BLANK) & ~inside
    if outside.any():
        dark = np.append(np.flatnonzero(~outside), len(data))
        a, b = np.searchsorted(dark, low), np.searchsorted(dark, high)
        size = b - a
        low, high = np.where(size > 0, dark[a], low), np.where(size > 0, dark[b - 1] + 1, low)
        together = high - low == size
        lead = dark[0] < at[0]
    else:
        lead = at[0] > 0
    quoted = (quotes == 2) & (size > 1) & quote[np.minimum(low, len(data) - 1)] & quote[high - 1]
    between = np.where(size == 0, _NONE, np.where(quoted & together, _STRING, np.where((quotes == 0) & together, _BARE, _OTHER)))
    doc = np.repeat(np.arange(len(plain)), np.diff(count))
    first, final = count[:-1][plain], count[1:][plain] - 1
    follows = np.append(kind[1:], np.uint8(0))
    follows[final] = 0
    depth = np.cumsum(_STEP[kind])
    inner = depth - np.repeat(np.where(first > 0, depth[first - 1], 0), final - first + 1)  # each document's own
    is_final = np.zeros(len(at), bool)
    is_final[final] = True
    wrong = ~_FOLLOWS[kind, between, follows] | ((inner <= 0) != is_final) | (inner > _DEEP) | (is_final & (inner != 0))
    wrong[first] |= kind[first] > _LIST
    wrong[0] |= lead
    if wrong.any():
        bad[doc[wrong]] = True
        after = np.flatnonzero(wrong & is_final) + 1  # may be the next one's text
        bad[doc[after[after < len(doc)]]] = True
        return None, bad
    # brackets in pairs: sorted by level, the n-th that opens goes with the n-th that closes
    opens, closes = np.flatnonzero(kind <= _LIST), np.flatnonzero((kind == _END_OBJECT) | (kind == _END_LIST))
    opens = opens[np.argsort(depth[opens].astype(np.uint8), kind="stable")]
    closes = closes[np.argsort(depth[closes].astype(np.uint8), kind="stable")]
    unlike = kind[closes] != kind[opens] + 2
    if unlike.any():
        bad[doc[opens[unlike]]] = True
        return None, bad
    close = np.zeros(len(at), np.int64)
    close[opens] = closes
    # nodes: marks that open, and atoms after marks
    flags = np.empty(2 * len(at), bool)
    flags[0::2], flags[1::2] = kind <= _LIST, (between != _NONE) & (follows != _COLON)
    order = np.flatnonzero(flags)
    mark, atomic = order >> 1, (order & 1).astype(bool)
    n = len(order)
    level = depth[mark] - ~atomic
    colon = mark - ~atomic  # the mark before the value
    has_key = kind[colon] == _COLON  # before a root stands another document's end
    has_key[0] = False
    by_level = np.argsort(level.astype(np.uint8), kind="stable")
    above = by_level[~atomic[by_level]]
    found = np.searchsorted(level[above] * n + above, (level[by_level] - 1) * n + by_level) - 1
    parents = np.where(level[by_level] > 0, above[found], -1)
    family = np.append(0, np.flatnonzero(parents[1:] != parents[:-1]) + 1)
    parent, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    parent[by_level] = parents
    rank[by_level] = np.arange(n) - np.repeat(family, np.diff(np.append(family, n)))
    is_list = ~atomic & (kind[mark] == _LIST)
    stray = (parent >= 0) & (has_key == is_list[parent])
    if stray.any():
        bad[doc[mark[stray]]] = True
        return None, bad
    last = np.where(atomic, np.arange(n), np.searchsorted(order, 2 * close[mark]) - 1)
    start, end = np.where(atomic, low[mark], at[mark]), np.where(atomic, high[mark], at[close[mark]] + 1)
    key = colon - 1
    return Nodes(data, doc[mark], parent, level, rank, last, atomic, is_list, start, end, np.where(has_key, low[key], 0), np.where(has_key, high[key], 0)), bad


_OPERATORS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Masks:
    """A path over the nodes of many documents; names match keys by their raw bytes."""

    def __init__(self, path: Path):
        self.path = path

    def select(self, nodes: Nodes) -> np.ndarray:
        """The places of the nodes that the path selects."""
        walk = _Walk(nodes)
        at = nodes.parent < 0
        for g in self.path.segments:
            if g.descendant:
                at = np.maximum.accumulate(np.where(at, nodes.last, -1)) >= np.arange(len(nodes))
            at = walk.fits(g) & (nodes.parent >= 0) & at[nodes.parent]
        return np.flatnonzero(at)


class _Walk:
    def __init__(self, nodes: Nodes):
        self.nodes = nodes
        self.child = nodes.parent >= 0
        self.size = np.bincount(nodes.parent[self.child], minlength=len(nodes))[nodes.parent]  # of the family
        self.in_list = self.child & nodes.is_list[nodes.parent]
        roots = np.flatnonzero(~self.child)
        self.root = np.repeat(roots, np.diff(np.append(roots, len(nodes))))

    def fits(self, g: Segment) -> np.ndarray:
        """Which nodes a step's selectors select from their parents."""
        out = self._fits(g.selectors[0])
        for s in g.selectors[1:]:
            out = out | self._fits(s)
        return out

    def _fits(self, s: Selector) -> np.ndarray:
        t = self.nodes
        if isinstance(s, Wildcard):
            return self.child
        if isinstance(s, Filter):
            return self.child & self.holds(s.expr)
        if isinstance(s, Name):
            out = np.zeros(len(t), bool)
            found = np.flatnonzero(t.key_end - t.key_start == len(s.quoted))
            for k, c in enumerate(s.quoted):
                found = found[t.data[t.key_start[found] + k] == c]
            out[found] = True
            return out
        if isinstance(s, Index):
            return self.in_list & (t.rank == (s.index if s.index >= 0 else self.size + s.index))
        assert isinstance(s, Slice)
        out = np.zeros(len(t), bool)
        for n in np.unique(self.size[self.in_list]):  # lists of equal length have equal indices
            wanted = np.zeros(n, bool)
            wanted[list(s.indices(int(n)))] = True
            some = np.flatnonzero(self.in_list & (self.size == n))
            out[some] = wanted[t.rank[some]]
        return out

    def holds(self, e: Expr) -> np.ndarray:
        """Of which nodes the expression is true."""
        if isinstance(e, Or):
            return self.holds(e.left) | self.holds(e.right)
        if isinstance(e, And):
            return self.holds(e.left) & self.holds(e.right)
        if isinstance(e, Not):
            return ~self.holds(e.expr)
        if isinstance(e, Comparison):
            return self._compare(e)
        found = self._selects(e.path)
        return found if e.relative else found[self.root]

    def _selects(self, path: Path) -> np.ndarray:
        """From which nodes the path selects anything, told from its last step to its first."""
        t, n = self.nodes, len(self.nodes)
        some = np.ones(n, bool)
        for g in reversed(path.segments):
            hit = self.fits(g) & some & self.child
            if g.descendant:
                upto = np.cumsum(hit)
                some = upto[t.last] > upto
            else:
                some = np.zeros(n, bool)
                some[t.parent[hit]] = True
        return some

    def _operand(self, x: Operand) -> np.ndarray:
        """The node that the operand selects from each node, -1 if none; of keys that repeat, the first."""
        t, n = self.nodes, len(self.nodes)
        at = np.arange(n) if x.relative else self.root
        for step in x.path.steps:
            hit = np.flatnonzero(self._fits(step))[::-1]
            below = np.full(n, -1)
            below[t.parent[hit]] = hit
            at = np.where(at >= 0, below[at], -1)
        return at

    def _compare(self, e: Comparison) -> np.ndarray:
        t, n, op = self.nodes, len(self.nodes), _OPERATORS[e.op]
        sides = [None if isinstance(x, Literal) else self._operand(x) for x in (e.left, e.right)]
        there = [np.ones(n, bool) if s is None else s >= 0 for s in sides]
        out = np.full(n, e.op == "!=")  # one operand selects nothing
        out[~there[0] & ~there[1]] = e.op in ("==", "<=", ">=")
        both = np.flatnonzero(there[0] & there[1])
        values, numeric = [], np.ones(len(both), bool)
        for x, side in zip((e.left, e.right), sides, strict=True):
            if side is None:
                is_number = isinstance(x.value, (int, float)) and not isinstance(x.value, bool) and abs(x.value) < 1 << 53
                values.append(x.value)
                numeric &= is_number
            else:
                number, sure = self._integers(side[both])
                values.append(number)
                numeric &= sure
        if numeric.any():
            a, b = (v if s is None else v[numeric] for v, s in zip(values, sides, strict=True))
            out[both[numeric]] = op(a, b)
        for i in both[~numeric]:
            a, b = (x.value if s is None else self._value(s[i]) for x, s in zip((e.left, e.right), sides, strict=True))
            out[i] = compare(a, e.op, b)
        return out

    def _integers(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of nodes that are integers of at most 15 digits, which floats hold exactly, and which nodes are that."""
        t = self.nodes
        used, back = np.unique(places, return_inverse=True)
        number, sure = np.zeros(len(used), np.int64), np.zeros(len(used), bool)
        atoms = np.flatnonzero(t.atomic[used])
        texts = slices(t.data, t.start[used[atoms]], t.end[used[atoms]])
        fits = pc.match_substring_regex(texts, r"^-?(0|[1-9][0-9]{0,14})$")
        whole = atoms[fits.to_numpy(zero_copy_only=False)] if len(atoms) else atoms
        number[whole], sure[whole] = texts.filter(fits).cast(pa.int64()).to_numpy(), True
        return number[back], sure[back]

    def _value(self, place: int):
        raw = self.nodes.data[self.nodes.start[place] : self.nodes.end[place]].tobytes()
        try:
            return json.loads(raw)
        except ValueError:
            return raw.decode("utf-8", "replace")


def select_many(documents: pa.Array, path: Path, one: Callable[[bytes], list[tuple[int, int]] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, nulls, starts, ends) of the matches in an array of texts; one() does for a document that is not plain."""
    doc, start, end = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    nulls = np.array(documents.is_null().to_numpy(zero_copy_only=False), bool)
    masks, mixed = Masks(path), False
    for first, data, bounds in chunks(documents):
        nodes, plain = shred_many(data, bounds)
        if nodes is not None:
            at = masks.select(nodes)
            at = at[~nulls[nodes.doc[at] + first]]
            owner = nodes.doc[at]
            doc.append(owner + first)
            start.append(nodes.start[at] - bounds[owner])
            end.append(nodes.end[at] - bounds[owner])
        for d in np.flatnonzero(~plain & ~nulls[first : first + len(plain)]):
            found = one(data[bounds[d] : bounds[d + 1]].tobytes())
            nulls[first + d] = found is None
            if found:
                mixed = True
                doc.append(np.full(len(found), first + d))
                start.append(np.array([a for a, _ in found], np.int64))
                end.append(np.array([b for _, b in found], np.int64))
    doc, start, end = np.concatenate(doc), np.concatenate(start), np.concatenate(end)
    if mixed:
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
    return np.bincount(doc, minlength=len(documents)), nulls, start, end
