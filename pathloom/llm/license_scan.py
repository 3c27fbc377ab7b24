"""Licence scanning: an Aho-Corasick automaton over words, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.common import ALNUM, extended

#: Phrases of the base scan and the label each gives.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in words as the scan sees them, with label and weight as evidence.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.6),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "isc license": ("isc", 0.6),
    "creative commons attribution": ("cc-by", 0.7),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "all rights reserved": ("proprietary", 0.3),
}
#: The words that an identifier tag becomes; an expression follows it on its line.
TAGS = ("spdx license identifier", "license expression")
_TAG = re.compile(rb"(?:spdx-license-identifier|license-expression)[ \t]*:")
_END = re.compile(rb"[\r\n]")
_PART = re.compile(rb"\(|\)|[a-z0-9.+:-]+")
_KNOWN = re.compile(r"(mit|apache|gpl|lgpl|agpl|mpl|epl|bsd|isc|cc-by|cc0|unlicense|zlib|bsl|artistic|python|postgresql)(-[a-z0-9.]+)*\+?")
_ORDER = {"or": 1, "and": 2, "with": 3}


def parse_expression(parts: Iterable[str]) -> tuple[list | None, int]:
    """The tree of the longest prefix of parts that is an expression, and that prefix's length; (None, 0) if none is.

    with binds tighter than and, and tighter than or. A leaf is ["id", name]; an inner node is [operator, left, right].
    """
    best: tuple[list | None, int] = (None, 0)
    output: list = []
    pending: list[str] = []
    operand, unclosed = True, 0  # whether an operand must come next, and how many parentheses are open

    def fold(output: list, pending: list[str]) -> None:
        op, right, left = pending.pop(), output.pop(), output.pop()
        output.append([op, left, right])

    for k, part in enumerate(parts):
        if operand:
            if part == "(":
                pending.append(part)
                unclosed += 1
                continue
            if part in _ORDER or part == ")":
                break
            output.append(["id", part])
            operand = False
        elif part in _ORDER:
            while pending and pending[-1] != "(" and _ORDER[pending[-1]] >= _ORDER[part]:
                fold(output, pending)
            pending.append(part)
            operand = True
            continue
        elif part == ")" and unclosed:
            while pending[-1] != "(":
                fold(output, pending)
            pending.pop()
            unclosed -= 1
        else:
            break
        if not unclosed:  # what is read so far is whole
            o, p = output[:], pending[:]
            while p:
                fold(o, p)
            best = (o[0], k + 1)
    return best


def evaluate(tree: list) -> tuple[set[str], float]:
    """The licences an expression names, and how sure it is: or takes the surer side, and the less sure one.

    An identifier of a known family counts 1, any other 0.5; an exception after with doesn't count.
    """
    todo, done = [(tree, False)], []
    while todo:  # no recursion, for a tree is as deep as its expression is long
        node, ready = todo.pop()
        op = node[0]
        if op == "id":
            done.append(({node[1]}, 1.0 if _KNOWN.fullmatch(node[1]) else 0.5))
        elif op == "with":
            todo.append((node[1], False))
        elif not ready:
            todo += (node, True), (node[2], False), (node[1], False)
        else:
            right, left = done.pop(), done.pop()
            small, large = sorted((left[0], right[0]), key=len)
            large |= small
            done.append((large, (max if op == "or" else min)(left[1], right[1])))
    return done[0]


def expressions(low: bytes) -> Iterator[list]:
    """The tree of each tagged expression of a lower-cased text; one ends with its line or at the next tag, at the latest."""
    tags = list(_TAG.finditer(low))
    for k, tag in enumerate(tags):
        stop = tags[k + 1].start() if k + 1 < len(tags) else len(low)
        if line := _END.search(low, tag.end(), stop):
            stop = line.start()
        tree, _ = parse_expression(p[0].decode() for p in _PART.finditer(low, tag.end(), stop))
        if tree:
            yield tree


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, *TAGS}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        raw = (text or "").encode("utf-8", "replace")
        words = raw.translate(ALNUM).split()
        # one character for each byte; with a space on either side every phrase stands between spaces
        line = f" {b' '.join(words).decode('latin-1')} "
        base: set[str] = set()
        more: set[str] = set()
        n_base, first, last, doubt, tagged = 0, None, None, 1.0, False
        counted, upto = 0, 0  # spaces before place upto
        for end, phrase in self.automaton.iter(line):
            if phrase in BASE:
                start = end - len(phrase) - 1
                if start >= upto:
                    counted, upto = counted + line.count(" ", upto, start), start
                    at = counted
                else:
                    at = counted - line.count(" ", start, upto)
                n_base += 1
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                base.add(BASE[phrase])
                if BASE[phrase] not in more:
                    doubt *= 0.5
                    more.add(BASE[phrase])
            elif phrase in NOTICES:
                label, weight = NOTICES[phrase]
                if (phrase, label) not in more:
                    doubt *= 1 - weight
                    more |= {label, (phrase, label)}
            else:
                tagged = True
        if tagged:
            for tree in expressions(raw.lower()):
                names, sure = evaluate(tree)
                more |= names
                doubt *= 1 - sure
        labels = sorted(base | {x for x in more if isinstance(x, str)})
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(labels), round(1 - doubt, 6)


_SCANNER: list[Scanner] = []
_FRESH = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()), ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64())]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word, base_labels, labels and score, for every row.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Base columns tell of the phrases of BASE.
    labels adds those of further notices and of identifiers in tagged expressions. score is 1 minus the product of the
    doubts that each distinct piece of evidence leaves. A null or empty text has 0 words, no labels ("") and score 0.
    Other columns pass through; columns of docs that bear the new names are replaced. Nothing is shuffled.
    """
    docs = docs.drop(*(n for n, _, _ in _FRESH if n != text_col))
    at, names = docs.columns.index(text_col), [*docs.columns, *(n for n, _, _ in _FRESH)]
    schema = extended(docs, _FRESH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            rows = [_SCANNER[0].scan(t.as_py()) for t in batch.column(at)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _FRESH]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, _, t) in zip(cols, _FRESH, strict=True))], names)

    return docs.mapInArrow(run, schema)
